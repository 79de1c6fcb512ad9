"""Substring dedup against all windows of all documents."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lapsegrid.llm import queries, repeats

SF = "/root/testdata/sf0.01"


def plain(docs):
    """Rows of the contract from a table of every window."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    key = lambda d: repeats.LAST if d is None else d
    first = {}
    for (d, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - 12):
            own = tuple(w[k : k + 13])
            first[own] = min(first.get(own, key(d)), key(d))
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key(d):
                gone[k : k + 13] = [True] * 13
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def same(frame, docs):
    found = [tuple(r) for r in frame.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    order = lambda r: (r[0] is None, r)
    assert sorted(found, key=order) == sorted(plain(docs), key=order)


def made(seed, n=120):
    """Documents with shared passages, copies, overlaps, repeats in themselves, odd white space."""
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(30)}" for _ in range(rng.choice([12, 13, 14, 40]))] for _ in range(8)]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]
        text = "".join(p + rng.choice([" ", "\n", "  ", "\t\x0b"]) for p in parts)
        docs.append((rng.choice([None, *range(60)]) if rng.random() < 0.2 else rng.randrange(10**6), text))
    docs += [(7, "same words " * 20), (5, "same words " * 20), (5, "same words " * 20), (9, None), (8, ""), (4, "é\xa0ü " * 15), (3, "é\xa0ü " * 14), (6, "ab " * 40)]
    return docs + [(10**7 + k, docs[k][1]) for k in range(5)]


def test_query_equals_all_windows(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(queries.op12_repeats(spark, SF), docs)


@pytest.mark.parametrize("seed", range(2))
def test_shared_passages_nulls_repeats_and_clashing_columns(spark, seed, monkeypatch):
    """Prefixes are lengthened from two suffixes on, so that all lengths occur."""
    monkeypatch.setattr(repeats, "GROUP", 2)
    monkeypatch.setattr(repeats, "SEEN", 1)
    docs = made(seed)
    frame = spark.createDataFrame([(d, t, 1, "x", 3) for d, t in docs], "doc_id long, text string, own int, chunk string, d0 int").repartition(3)
    same(repeats.dedup(frame), docs)


def test_long_text_and_empty_table(spark):
    docs = [(2, " ".join(f"t{k % 5000}" for k in range(300_000))), (1, " ".join(f"t{k}" for k in range(100, 120))), (3, "short text")]
    same(repeats.dedup(spark.createDataFrame(docs, "doc_id int, text string")), docs)
    assert repeats.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_of_all_lengths_and_subtrees_over_batches():
    """Suffixes of one chunk under prefixes of each length, read in batches of any size, give the nodes of all windows."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(20)]
    own = repeats.Texts(pa.array(texts), repeats.Words())
    everything = repeats.Bloom(np.full(64, (1 << 64) - 1, dtype=np.uint64))
    suffixes = repeats.Suffixes(own, np.arange(20), everything)
    long = {k: np.unique(repeats.run_keys(own.hashes, k))[:: 2 if k < 11 else 3] for k in repeats.LENGTHS[:-1]}
    key, tail = suffixes.prefixes(long)
    tail = tail.to_pylist()
    assert {len(t) for t in tail} == {2 * (13 - k) for k in repeats.LENGTHS}
    rows = sorted(zip(key.view(np.int64).tolist(), tail, suffixes.whole.view(np.int64).tolist(), [5] * len(tail), strict=True))
    rows = sorted(rows + [(*r[:3], 7) for r in rows[::3]])
    for size in (1, 7, 10**6):
        trees, found = repeats.Subtrees(), []
        for k in range(0, len(rows), size):
            p, t, w, low = zip(*rows[k : k + size], strict=True)
            batch = pa.record_batch({"prefix": pa.array(p), "tail": pa.array(t, pa.binary()), "whole": pa.array(w), "low": pa.array(low)})
            found += trees.repeats(batch).tolist()
        assert found == [r[3] == 7 for r in rows]


def test_frequent_keys_are_found_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(repeats, "PREFIXES", 50)
    rng, own, true = np.random.default_rng(1), repeats.Frequent(), {}
    for _ in range(40):
        keys, n = np.unique(np.concatenate((rng.integers(100, 10**6, 300), rng.integers(0, 10, 100))).astype(np.uint64), return_counts=True)
        own.add(keys, n)
        for k, c in zip(keys.tolist(), n.tolist(), strict=True):
            true[k] = true.get(k, 0) + c
    assert len(own.keys) <= 50
    held = dict(zip(own.keys.tolist(), own.counts.tolist(), strict=True))
    assert all(true[k] - sum(true.values()) / 50 <= held.get(k, 0) <= true[k] for k in range(10))


def test_a_row_group_holds_one_chunk(spark, monkeypatch):
    """Whoever writes or reads the chunks holds one of them, not a hundred."""
    import pyarrow.dataset as ds

    paths, made = [], repeats.new_path
    monkeypatch.setattr(repeats, "new_path", lambda *a: paths.append(made(*a)) or paths[-1])
    docs = [(k, f"text {k}") for k in range(2500)]
    repeats.dedup(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    groups = [g.num_rows for f in ds.dataset(paths[-1].removeprefix("file:"), format="parquet").get_fragments() for g in f.row_groups]
    assert len(groups) > 1 and set(groups) == {1}
