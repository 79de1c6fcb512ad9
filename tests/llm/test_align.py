"""Token alignment against a plain walk over whole texts."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lapsegrid.llm import align, queries

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoders():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def spelled(first, second, text):
    """(ids, bytes) of each token of both, or None where they don't spell the text."""
    if not text:
        return None
    raw, a, b = (" " + text).encode(), first.encode(" " + text, add_special_tokens=False), second.encode(text)
    ends, at = [], 0
    for k in a.ids:
        name = first.id_to_token(k)
        at += len(name)  # a letter of the name is a byte
        ends.append(at)
    if at != len(raw):
        return None
    one = [(k, y - x) for k, x, y in zip(a.ids, [0, *ends], ends, strict=False)]
    two = []
    for k in b:
        piece = second.id_to_piece(k)
        two.append((k, bytes([int(piece[3:5], 16)]) if second.is_byte(k) else piece.replace("▁", " ").encode()))
    return (one, [(k, len(x)) for k, x in two]) if b"".join(x for _, x in two) == raw else None


def plain(first, second, docs):
    """Rows of the contract, in the order of docs, by two pointers over each text."""
    rows, total = [], Counter()
    for doc, text in docs:
        found = spelled(first, second, text)
        links, groups, left, right, i, j, x, y = [], [], [], [], 0, 0, 0, 0
        one, two = found or ([], [])
        while i < len(one):
            links.append((one[i][0], two[j][0]))
            x2, y2 = x + one[i][1], y + two[j][1]
            if x2 <= y2:
                left.append(str(one[i][0]))
                i, x = i + 1, x2
            if y2 <= x2:
                right.append(str(two[j][0]))
                j, y = j + 1, y2
            if x == y:
                groups.append(",".join(left) + "|" + ",".join(right))
                left, right = [], []
        total.update(links)
        rows.append((doc, len(one), len(two), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if found else ""))
    best = Counter()
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    return [(d, a, b, g, len(x), sum(total[p] == best[p[1]] for p in x), sum(total[p] for p in x), s) for d, a, b, g, x, s in rows]


def result(frame):
    return [tuple(r) for r in frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


def same(found, docs, encoders):
    key = lambda r: (r[0] is None, r)
    assert sorted(found, key=key) == sorted(plain(*encoders, docs), key=key)


def test_query_equals_a_plain_walk(spark, encoders):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(result(queries.op13_align(spark, SF)), docs, encoders)


ODD = [
    None, "", " ", "  two  runs   of spaces ", "\n", "a\nb\n\n c\t d", "tab\tand space", "<|endoftext|> and <s> </s> <0x41>", "▁ mark", "a ▁ b", "naïve café 中文 \U0001f600 x",
    " no-break 　wide", "it's we'll 12345 don't", "é combined", "\x1c sep \x85 next", "nul \x00 in", "word " * 50, "x" * 5000, "...!!! ???", "กำ ก", "A" + " " * 40 + "B",
]


def test_odd_texts_nulls_repeats_and_clashing_columns(spark, encoders):
    docs = [(k if k % 7 else None, t) for k, t in enumerate(ODD)] + [(1, "same text"), (1, "same text"), (2, "same text")]
    frame = spark.createDataFrame([(d, t, 5, "p") for d, t in docs], "doc_id long, text string, chunk int, code string").repartition(3)
    same(result(align.align(frame, A, B)), docs, encoders)


def test_chunks_and_forgetting(spark, encoders, monkeypatch):
    """Small chunks and a short memory change nothing."""
    own, held = align.Aligner(A, B), []
    monkeypatch.setattr(align, "aligner", lambda *_: own)
    monkeypatch.setattr(align, "CHUNK_BYTES", 1)
    monkeypatch.setattr(align, "UNITS", 10)
    import pyarrow as pa
    from pyspark import TaskContext

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 3})()))
    docs = [(k, f"{t or ''} tail {k}") for k, t in enumerate(ODD)]
    batches = [pa.record_batch({"doc_id": pa.array([d]), "text": pa.array([t])}) for d, t in docs]
    held = list(align._chunks(A, B)(batches))
    assert [b.column("chunk")[0].as_py() for b in held] == [(3 << 32) + k for k in range(len(docs))]
    expected = plain(*encoders, docs)
    assert [(b.column("n_a")[0].as_py()[0], b.column("groups_sha256")[0].as_py()[0]) for b in held] == [(r[1], r[7]) for r in expected]


def test_text_ids_long_text_and_empty_table(spark, encoders):
    docs = [("a", "some words, " * 200_000), (None, "x y"), ("b", "y x")]
    same(result(align.align(spark.createDataFrame(docs, "doc_id string, text string"), A, B)), docs, encoders)
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_units_equal_whole_texts(spark, encoders):
    """Cutting at spaces gives what whole texts give."""
    own = align.Aligner(A, B)
    assert own.both.apart
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(100).collect()] + [t for t in ODD if t]
    import pyarrow as pa

    cut = [";".join(own.groups[k] for k in x.tolist()) for x in own.texts(pa.array(docs))]
    own.both.apart = False
    whole = [";".join(own.groups[k] for k in x.tolist()) for x in own.texts(pa.array(docs))]
    assert cut == whole


def test_a_row_group_holds_one_chunk(spark):
    """Whoever writes or reads the chunks holds one of them, not a hundred."""
    import pyarrow.parquet as pq

    frame = spark.createDataFrame([(k, "some words " * 130_000) for k in range(9)], "doc_id long, text string").coalesce(1)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in align.chunks(frame, A, B).inputFiles()]
    assert sum(f.num_rows for f in files) > 1
    assert all(f.row_group(k).num_rows == 1 for f in files for k in range(f.num_row_groups))


def test_scoring_forgets_the_tokenizers(monkeypatch):
    """Workers that score have aligned before."""
    monkeypatch.setattr(align, "_aligners", {("a", "b"): object()})
    assert list(align._scores([])) == [] and not align._aligners
