"""Cross-tokenizer alignment: which tokens of two tokenizers overlap, and how often each pair does.

Tokens are byte intervals on one axis. In each Arrow partition DuckDB joins the interval tables: a range join
finds the overlaps (links), window sums over the common ends number the groups of the first tokenizer's
tokens, and an ASOF join puts the second's into them. Partial pair counts are merged in Spark.

Both tokenizers cut a text at a single space between two other characters, if their files say so (``apart``):
no token goes on beyond such a space. A text is then cut there into units; a unit is aligned once per worker, and
a text's alignment is that of its units in turn. Texts that can't be cut, or of which some unit doesn't come
back as it was, are encoded and aligned whole.

Texts are read once. A chunk of texts is written with its units and its distinct pairs; only pairs
are counted and joined, and their counts go back to the chunk.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsegrid.llm.common import bounded_batches, new_path, row_by_row

#: Bytes of text of a chunk (it ends with the batch that reaches this), and units that a worker remembers.
CHUNK_BYTES, UNITS = 4 << 20, 400_000
#: Units that are encoded and joined at once.
LEARNT = 1 << 14
_CUT = re.compile(r"(?<=\S) (?=\S)")
MARK = "▁"

LINKS = "SELECT a.u, a.id AS a, b.id AS b FROM a JOIN b ON b.lo < a.hi AND b.hi > a.lo"
GROUPS = """
WITH ends AS (SELECT a.*, (b.hi IS NOT NULL)::BIGINT AS cut FROM a LEFT JOIN b ON a.hi = b.hi),
ag AS (SELECT *, coalesce(sum(cut) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM ends)
SELECT u, g, 0 AS side, lo, id FROM ag UNION ALL SELECT b.u, g, 1, b.lo, b.id FROM b ASOF JOIN ag ON ag.lo <= b.lo
ORDER BY g, side, lo"""


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies and the bytes they stand for: printable Latin-1 stands for
    itself, the others are numbered from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_alphabet()
        names = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            self.bytes_a[k] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.apart = self._apart(path_a, path_b, pieces)

    def _apart(self, path_a: str, path_b: str, pieces: list[str]) -> bool:
        """Whether no token of either goes on beyond a single space between other characters."""
        from sentencepiece import sentencepiece_model_pb2

        with open(path_a, encoding="utf-8") as file:
            said = json.load(file)
        pre, plain = said["pre_tokenizer"] or {}, all(t["special"] and not t["normalized"] for t in said["added_tokens"])
        first = plain and said["normalizer"] is None and (pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space")) == ("ByteLevel", True, False)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path_b, "rb") as file:
            model.ParseFromString(file.read())
        rule = model.normalizer_spec
        second = rule.add_dummy_prefix and not rule.remove_extra_whitespaces and rule.escape_whitespaces and not rule.precompiled_charsmap
        second = second and model.trainer_spec.model_type == model.trainer_spec.BPE and not model.trainer_spec.treat_whitespace_as_suffix
        return first and second and not any(MARK in p.lstrip(MARK) for p in pieces)

    def encode(self, texts: list[str]) -> tuple[list, list, list[bool]]:
        """Ids of both for each text, and whether the tokens' bytes are a space and the text."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        same = []
        for t, x, y in zip(texts, a, b, strict=True):
            raw = b" " + t.encode("utf-8", "surrogatepass")
            same.append(b"".join(map(of_a, x)) == raw == b"".join(map(of_b, y)))
        return a, b, same


def _table(ids: list[list[int]], sizes: np.ndarray) -> pa.Table:
    """Token intervals of texts that follow each other on one axis."""
    flat = np.fromiter((k for x in ids for k in x), dtype=np.int64)
    hi = np.cumsum(sizes[flat])
    unit = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    return pa.table({"u": unit, "lo": hi - sizes[flat], "hi": hi, "id": flat})


class Aligner:
    """Alignments of units. ``slot`` numbers the units that are remembered; the lists hold what is known of each."""

    def __init__(self, path_a: str, path_b: str):
        self.both = Tokenizers(path_a, path_b)
        self.names = [str(k) for k in range(max(len(self.both.bytes_a), len(self.both.bytes_b)))]
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.groups: list[str] = []
        self.stats: list[np.ndarray] = [np.zeros((0, 4), dtype=np.int64)]
        self.pairs: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]

    def learn(self, texts: list[str]) -> np.ndarray:
        """New numbers of texts; -1 for those whose tokens don't spell them."""
        a, b, same = self.both.encode(texts)
        keep = [k for k, s in enumerate(same) if s and a[k]]
        out = np.full(len(texts), -1, dtype=np.int64)
        if not keep:
            return out
        out[keep] = len(self.groups) + np.arange(len(keep))
        tables = [_table([ids[k] for k in keep], sizes) for ids, sizes in ((a, self.both.sizes_a), (b, self.both.sizes_b))]
        for name, table in zip("ab", tables, strict=True):
            self.duck.register(name, table)
        links, tokens = self.duck.sql(LINKS).to_arrow_table(), self.duck.sql(GROUPS).to_arrow_table()
        for name in "ab":
            self.duck.unregister(name)
        unit = links["u"].to_numpy()
        order = np.argsort(unit, kind="stable")
        self.pairs.append((links["a"].to_numpy()[order] << 32) | links["b"].to_numpy()[order])
        n = len(keep)
        u, g, side, ids = (tokens[c].to_numpy() for c in ("u", "g", "side", "id"))
        new_group, last = np.r_[True, g[1:] != g[:-1]], np.r_[u[1:] != u[:-1], True]
        ends = np.r_[new_group[1:], True]
        marks = np.where(last, "", np.where(ends, ";", np.where(np.r_[side[1:] != side[:-1], True], "|", ","))).tolist()
        parts = list(map("".join, zip(map(self.names.__getitem__, ids.tolist()), marks, strict=True)))
        bounds = np.searchsorted(u, np.arange(n + 1)).tolist()
        self.groups += ["".join(parts[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        count = lambda x: np.bincount(x, minlength=n)
        self.stats.append(np.stack([count(u[side == 0]), count(u[side == 1]), count(u[new_group]), count(unit)], axis=1))
        return out

    def numbers(self, units: list[str]) -> np.ndarray:
        """Numbers of distinct units, -1 for those that can't stand for themselves."""
        new = [x for x in units if x not in self.slot]
        plain = [x for x in new if x and not x[0].isspace() and not x[-1].isspace()]
        self.slot.update(dict.fromkeys(new, -1))
        for at in range(0, len(plain), LEARNT):
            part = plain[at : at + LEARNT]
            self.slot.update(zip(part, self.learn(part).tolist(), strict=True))
        return np.array([self.slot[x] for x in units], dtype=np.int64)

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text the numbers of its units; none for texts without tokens."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
        if self.both.apart:
            lists = pc.split_pattern(texts.fill_null(""), " ")
            coded = lists.flatten().dictionary_encode()
            known = self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            ends = np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))
            out = np.split(known, ends[:-1])
        for k, text in enumerate(texts.to_pylist()):
            if not text:
                out[k] = np.zeros(0, dtype=np.int64)
            elif not self.both.apart or out[k].min() < 0:
                out[k] = self.odd(text)
        return out

    def odd(self, text: str) -> np.ndarray:
        """A text with runs of white space, or whose tokens may not spell it."""
        if self.both.apart:
            units = _CUT.split(text)
            new = list(dict.fromkeys(x for x in units if self.slot.get(x, -1) < 0))
            known = dict(zip(new, self.learn(new).tolist(), strict=True)) if new else {}
            found = np.array([known.get(x, self.slot.get(x, -1)) for x in units], dtype=np.int64)
            if found.min() >= 0:
                return found
        found = self.learn([text])
        return found if found[0] >= 0 else np.zeros(0, dtype=np.int64)

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        """(statistics of each number, pairs of all in turn)."""
        self.stats, self.pairs = [np.concatenate(self.stats)], [np.concatenate(self.pairs)]
        return self.stats[0], self.pairs[0]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per worker process."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over runs of the given sizes."""
    ends = np.cumsum(sizes)
    total = np.concatenate(([0], np.cumsum(values)))
    return total[ends] - total[ends - sizes]


def _packed(values: np.ndarray) -> bytes:
    """Small numbers by byte planes, which compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Chunk:
    """Texts, as numbers of units, until there are enough of them."""

    def __init__(self):
        self.ids, self.texts, self.bytes = [], [], 0

    def row(self, number: int, own: Aligner, kind: pa.DataType) -> pa.RecordBatch:
        """The chunk as one row: what is known of each document, units by document, pairs by unit, counts of distinct pairs."""
        stats, links = own.known()
        begin = np.cumsum(stats[:, 3]) - stats[:, 3]
        sizes = np.array([len(x) for x in self.texts], dtype=np.int64)
        flat = np.concatenate(self.texts)
        units, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent units get small numbers
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        units, place, times = units[order], rank[place.ravel()], times[order]
        n_links = stats[units, 3]
        inside = np.arange(n_links.sum()) - np.repeat(np.cumsum(n_links) - n_links, n_links)
        codes, where = np.unique(links[np.repeat(begin[units], n_links) + inside], return_inverse=True)
        counts = np.bincount(where.ravel(), weights=np.repeat(times, n_links), minlength=len(codes)).astype(np.int64)
        sums = [_sums(stats[flat, k], sizes) for k in range(4)]
        digest = [hashlib.sha256(";".join(map(own.groups.__getitem__, x.tolist())).encode()).hexdigest() if len(x) else "" for x in self.texts]
        long = lambda x: pa.array([x], pa.list_(pa.int64()))
        blob = lambda x: pa.array([_packed(x)], pa.binary())
        return pa.record_batch(
            {
                "chunk": pa.array([number], pa.int64()), "code": long(codes), "n": long(counts), "doc_id": pa.array([self.ids], pa.list_(kind)),
                "n_a": long(sums[0]), "n_b": long(sums[1]), "n_groups": long(sums[2]), "n_links": long(sums[3]), "groups_sha256": pa.array([digest], pa.list_(pa.string())),
                "sizes": blob(sizes), "units": blob(place), "unit_links": blob(n_links), "pairs": blob(where.ravel()),
            }
        )


def _chunks(path_a: str, path_b: str):
    def align(batches) -> Iterator[pa.RecordBatch]:
        own, number, held = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, Chunk()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            if not held.ids and len(own.groups) > UNITS:
                own.forget()
            held.texts += own.texts(batch.column("text"))
            held.ids += batch.column("doc_id").to_pylist()
            held.bytes += batch.column("text").nbytes
            if held.bytes >= CHUNK_BYTES:
                yield held.row(number, own, kind)
                number, held = number + 1, Chunk()
        if held.ids:
            yield held.row(number, own, kind)

    return align


def chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents by chunk, aligned, as a table in the shared folder."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    bounded_batches(spark)
    each = ", ".join(f"{c} array<long>" for c in ("code", "n", "n_a", "n_b", "n_groups", "n_links"))
    schema = f"chunk long, doc_id array<{kind}>, {each}, groups_sha256 array<string>, sizes binary, units binary, unit_links binary, pairs binary"
    names = ["chunk", "code", "n", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "sizes", "units", "unit_links", "pairs"]
    types = dict(x.rsplit(" ", 1) for x in schema.split(", "))
    made = docs.select("doc_id", "text").mapInArrow(_chunks(path_a, path_b), ", ".join(f"{c} {types[c]}" for c in names))
    path = new_path(spark, "aligned")
    row_by_row(made.write).parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(code, n, best): links that hold each pair, over the corpus, and whether its second token has no pair with more.
    ``code`` holds the first token's id above the second's 32 bits."""
    counts = parts.select(F.explode(F.arrays_zip("code", "n")).alias("x")).groupBy(F.col("x.code").alias("code")).agg(F.sum("x.n").alias("n"))
    of_b = Window.partitionBy(F.col("code").bitwiseAND((1 << 32) - 1))  # as many rows as the first has ids, at most
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_b))


def _scores(batches) -> Iterator[pa.RecordBatch]:
    _aligners.clear()  # workers are used again: all chunks are written by now
    kept = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            flat = lambda c: row.column(c).flatten()  # noqa: B023, E731
            place, count, best = (flat(c).to_numpy(zero_copy_only=False) for c in ("place", "count", "best"))
            order = np.argsort(place)
            sizes, units, unit_links, pairs = (_unpacked(row.column(c)[0].as_py()) for c in ("sizes", "units", "unit_links", "pairs"))
            out = {"doc_id": flat("doc_id")} | {c: flat(c) for c in kept}
            for name, values in (("n_best", best.astype(np.int64)), ("count_sum", count)):
                out[name] = pa.array(_sums(_sums(values[order][pairs], unit_links)[units], sizes))
            yield pa.record_batch(out)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Align the tokens of a byte-level tokenizer file (A) and a sentencepiece file (B) over ``docs`` (doc_id, text): doc_id, n_a, n_b,
    n_groups, n_links, n_best, count_sum, groups_sha256.

    Each text is encoded after a space, without special tokens. Null and empty texts, and texts whose tokens' bytes don't spell
    them, have no tokens: zeros and an empty string. Repeated rows and null ids are documents like any other; ties
    for the best are all best. Texts of any length are one document; ids are of any type. Other columns are ignored; an
    empty table gives an empty result.
    """
    parts = chunks(docs, path_a, path_b)
    counts = pair_counts(parts)
    own = parts.select("chunk", F.posexplode("code").alias("place", "code")).join(counts, "code")
    gathered = own.groupBy("chunk").agg(F.collect_list(F.struct("place", F.col("n").alias("count"), "best")).alias("x"))
    found = gathered.select(F.col("chunk").alias("of"), *(F.col(f"x.{c}").alias(c) for c in ("place", "count", "best")))
    rows = parts.drop("code", "n").join(found, F.col("chunk") == F.col("of"), "left")
    none = lambda c: F.coalesce(c, F.array().cast(dict(found.dtypes)[c])).alias(c)
    rows = rows.select(*(c for c in parts.columns if c not in ("code", "n", "chunk")), none("place"), none("count"), none("best"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(_scores, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
