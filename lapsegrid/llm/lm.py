"""Deleted interpolation language model (Jelinek-Mercer), bigram order.

Texts are read once into chunks of token numbers. Each chunk offers its distinct word and
bigram keys with their training counts, cut by key range; a range adds up what the chunks
offer and answers each of them with the totals. Neither ranges nor chunks of one sum grow
with the input: beyond RANGES ranges, chunks are summed by groups of FAN per range, the sums are cut into
finer ranges and summed in turn, and totals come down the same tree. So offers are linear in the tokens, every
group is of bounded size, and a very common word or pair is one entry per chunk or sum, never a hot row. With the
totals in place two map-only passes follow: one gathers a bounded histogram of leave-one-out (deleted) relative
frequencies of all training tokens, from which expectation-maximisation learns the mixture weights
of each context-frequency bucket; the other scores the documents.

Keys are 64-bit hashes of words and of word pairs. Among 10^10 distinct keys about three pairs are
expected to share a hash, whose counts then add up.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lapsegrid.llm.common import bounded_batches, columns, lower_bytes, remove, staged

#: Tokens of a chunk (it ends with the document that reaches this), and tokens whose keys make a range.
CHUNK_TOKENS = 1_000_000
RANGE_TOKENS = 2_000_000
#: Ranges that a chunk is cut into, and chunks or sums added up at once, at most: 32 GB of text in one
#: level, 250 TB in two.
RANGES, FAN = 8192, 16384
BUCKETS = 40
STEPS = 4  # cells of the histogram per factor of two
FLOOR2, FLOOR1 = 24, 48  # factors of two
EM_ROUNDS = 200
LEAST_WEIGHT = 1e-6
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CHUNK = "chunk long, doc_ids array<{kind}>, lengths array<int>, held_out array<boolean>, words binary, ids binary"


def squeeze(values: np.ndarray) -> bytes:
    """Compress an integer array byte plane by byte plane."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """64-bit keys of ordered pairs of word hashes."""
    with np.errstate(over="ignore"):
        x = before * np.uint64(0x9E3779B185EBCA87) + (after ^ (after >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x165667B19E3779F9)
        return x ^ (x >> np.uint64(29))


def _chunks(kind: pa.DataType):
    """Documents (doc_id, text, held_out) -> chunks."""

    def cut(batches) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), count()
        fresh = lambda: (defaultdict(count(1).__next__), [], [], [], [])
        vocabulary, ids, doc_ids, lengths, held = fresh()
        tokens = 0

        def close():
            hashes = np.array([END, *(xxhash.xxh64_intdigest(w) for w in vocabulary)], dtype=np.uint64)
            row = [(part << 24) + next(number), doc_ids, lengths, held, squeeze(hashes), squeeze(np.concatenate(ids))]
            kinds = [pa.int64(), pa.list_(kind), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
            names = ["chunk", "doc_ids", "lengths", "held_out", "words", "ids"]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for doc, text, out in columns(batch, "doc_id", "text", "held_out"):
                words = lower_bytes(text).split()
                own = np.zeros(len(words) + 1, dtype=np.uint32)
                own[:-1] = list(map(vocabulary.__getitem__, words))
                ids.append(own)
                doc_ids.append(doc)
                lengths.append(len(own))
                held.append(out)
                tokens += len(own)
                if tokens >= CHUNK_TOKENS:
                    yield close()
                    vocabulary, ids, doc_ids, lengths, held = fresh()
                    tokens = 0
        if ids:
            yield close()

    return cut


class Chunk:
    """A chunk with its token arrays."""

    def __init__(self, row: dict):
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~np.array(row["held_out"], dtype=bool), self.lengths)
        self.words, self.ids = expand(row["words"], np.uint64), expand(row["ids"], np.uint32)

    def pairs(self) -> np.ndarray:
        own = self.words[self.ids]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[self.starts] = START
        return pair_keys(before, own)

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys of words (1) or pairs (2), their training counts, and the
        place of each word or token among the keys."""
        if kind == 1:
            n = np.bincount(self.ids[self.train], minlength=len(self.words))
            keys, place = np.unique(self.words, return_inverse=True)
            return keys, np.bincount(place, weights=n, minlength=len(keys)).astype(np.uint64), place
        keys, place = np.unique(self.pairs(), return_inverse=True)
        return keys, np.bincount(place[self.train], minlength=len(keys)).astype(np.uint64), place


_OFFER = "range long, kind int, node long, keys binary, counts binary"
_ANSWER = "range long, kind int, node long, totals binary, known long"


def narrow(counts: np.ndarray) -> bytes:
    """Counts in the least width that holds them, told by the first byte."""
    width = 4 if not len(counts) or counts.max() < 1 << 32 else 8
    return bytes([width]) + squeeze(counts.astype(f"<u{width}"))


def widen(data: bytes) -> np.ndarray:
    return expand(data[1:], f"<u{data[0]}").astype(np.uint64)


def _edges(first: int, many: int, ranges: int) -> np.ndarray:
    """Lower bounds of the ranges first + 1, ..., first + many - 1 of ``ranges`` equal ones."""
    return np.array([(k << 64) // ranges for k in range(first + 1, first + many)], dtype=np.uint64)


def _cut(first: int, many: int, ranges: int, kind: int, node: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Offers of sorted keys, by range; ranges without keys have none."""
    cuts = [0, *np.searchsorted(keys, _edges(first, many, ranges)).tolist(), len(keys)]
    return [
        (first + k, kind, node, squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), narrow(counts[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a
    ]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns_ = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(x, kinds[kind]) for x, (name, kind) in zip(columns_, fields, strict=True)})


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with numbers from 0 without gaps: those of a task follow each other."""
    parts = chunks.groupBy(F.shiftrightunsigned("chunk", 24).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row per task
    sums = np.cumsum([0, *(r.n for r in parts)]).tolist()
    ahead = chunks.sparkSession.createDataFrame([(r.part, n) for r, n in zip(parts, sums, strict=False)], "part long, ahead long")
    own = chunks.withColumn("part", F.shiftrightunsigned("chunk", 24)).join(F.broadcast(ahead), "part")
    return own.withColumn("chunk", F.col("chunk").bitwiseAND((1 << 24) - 1) + F.col("ahead")).select(*chunks.columns)


def _offers(ranges: int):
    """Chunk rows -> offers."""

    def offer(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                for kind in (1, 2):
                    keys, counts, _ = chunk.keys(kind)
                    made = _cut(0, ranges, ranges, kind, row["chunk"], keys, counts)
                    for at in range(0, len(made), 1024):
                        yield from _table(made[at : at + 1024], _OFFER).to_batches()

    return offer


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of a group of offers, their sums, each offered key's place and each offer's length."""
    parts = [(expand(k, np.uint64).cumsum(dtype=np.uint64), widen(c)) for k, c in columns(table, "keys", "counts")]
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.zeros(len(keys), dtype=np.uint64)
    np.add.at(total, place, np.concatenate([c for _, c in parts]))
    return keys, total, place, [len(k) for k, _ in parts]


def _told(table: pa.Table, total: np.ndarray, place: np.ndarray, lengths: list[int], known: int) -> pa.Table:
    """The answer to each offer; known: distinct keys with training counts, told once."""
    out, at = [], 0
    for n in lengths:
        out.append(narrow(total[place[at : at + n]]))
        at += n
    rows = zip(table["range"].to_pylist(), table["kind"].to_pylist(), table["node"].to_pylist(), out, [known] + [0] * (len(out) - 1), strict=True)
    return _table(list(rows), _ANSWER)


def _answer(table: pa.Table) -> pa.Table:
    """Totals of one range, as each node asked."""
    _, total, place, lengths = _summed(table)
    return _told(table, total, place, lengths, int((total > 0).sum()))


def _sum_up(fan: int, split: int, ranges: int):
    """A group of offers of one range -> the offers of their sum, by finer ranges."""

    def merge(table: pa.Table) -> pa.Table:
        keys, total, _, _ = _summed(table)
        first, kind, node = (table[c][0].as_py() for c in ("range", "kind", "node"))
        return _table(_cut(first * split, split, ranges * split, kind, node // fan, keys, total), _OFFER)

    return merge


def _hand_down(left: pa.Table, right: pa.Table) -> pa.Table:
    """A group of offers and the totals of its sum, by finer range -> the answers to the offers."""
    if not left.num_rows:
        return _table([], _ANSWER)
    _, _, place, lengths = _summed(left)
    total = np.concatenate([widen(t) for _, t in sorted(columns(right, "range", "totals"))])
    return _told(left, total, place, lengths, 0)


def answers(offers: DataFrame, ranges: int, nodes: int, fan: int = FAN, split: int = RANGES) -> tuple[DataFrame, int]:
    """Answers to all offers of nodes 0 to ``nodes`` - 1, and the number of distinct words with training counts."""
    if nodes <= fan:
        found = staged(offers.groupBy("range", "kind").applyInArrow(_answer, _ANSWER), "lm-answers", "none")
        return found, found.where("kind = 1").agg(F.sum("known")).first()[0] or 0
    offers = staged(offers, "lm-offers", "none")
    group = F.floor(F.col("node") / fan).cast("long")
    merged = offers.groupBy("range", "kind", group.alias("sum")).applyInArrow(_sum_up(fan, split, ranges), _OFFER)
    above, known = answers(merged, ranges * split, -(-nodes // fan), fan, split)
    down = above.groupBy(F.floor(F.col("range") / split).cast("long").alias("range_"), "kind", F.col("node").alias("sum"))
    found = offers.groupBy(F.col("range").alias("range_"), "kind", group.alias("sum")).cogroup(down).applyInArrow(_hand_down, _ANSWER)
    found = staged(found, "lm-answers", "none")
    remove(offers)
    remove(above)
    return found, known


_COUNTED = "doc_ids array<{kind}>, lengths array<int>, held_out array<boolean>, ids binary, word_totals binary, pair_totals binary"


def _align(kind: pa.DataType):
    """A chunk and the answers to it -> the chunk with the totals of its words, and of its pairs in token order."""
    schema = pa.schema([("doc_ids", pa.list_(kind)), ("lengths", pa.list_(pa.int32())), ("held_out", pa.list_(pa.bool_())), ("ids", pa.binary()), ("word_totals", pa.binary()), ("pair_totals", pa.binary())])

    def align(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for row in left.to_pylist():  # one, or none
            chunk, told = Chunk(row), sorted(columns(right, "kind", "range", "totals"))
            found = [squeeze(np.concatenate([widen(t) for k, _, t in told if k == kind])[chunk.keys(kind)[2]]) for kind in (1, 2)]
            made.append((row["doc_ids"], row["lengths"], row["held_out"], row["ids"], *found))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema) if made else schema.empty_table()

    return align


class Counted:
    """Token-level totals of a chunk: c (word), before (its context), pair. The end token has
    number 0 in every chunk; its total, the number of training documents, is also that of the
    context at the start of a text."""

    def __init__(self, row: dict):
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.held_out = np.array(row["held_out"], dtype=bool)
        self.doc_ids = row["doc_ids"]
        words = expand(row["word_totals"], np.uint64).astype(np.float64)
        self.c = words[expand(row["ids"], np.uint32)]
        self.before = np.empty_like(self.c)
        self.before[1:] = self.c[:-1]
        self.before[self.starts] = words[0]
        self.pair = expand(row["pair_totals"], np.uint64).astype(np.float64)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + whole log2 of its count."""
    return np.where(context > 0, np.minimum(BUCKETS - 1, 1 + np.floor(np.log2(np.maximum(context, 1)))), 0).astype(np.int64)


def _cells(p: np.ndarray, floor: int) -> np.ndarray:
    """Histogram cell of probabilities: 0 for zero, else by quarter powers of two."""
    return np.where(p > 0, 1 + np.minimum(floor * STEPS - 1, np.floor(-STEPS * np.log2(np.where(p > 0, p, 1)))), 0).astype(np.int64)


def _histogram(n: int):
    """Leave-one-out frequencies of training tokens -> (cell, n, p2, p1)."""

    def gather(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = Counted(row)
                train = np.repeat(~x.held_out, x.lengths)
                c, before, pair = x.c[train] - 1, x.before[train] - 1, x.pair[train] - 1
                p2 = np.where(before > 0, pair / np.maximum(before, 1), 0.0)
                p1 = c / max(n - 1, 1)
                cell = (bucket_of(before) * (FLOOR2 * STEPS + 1) + _cells(p2, FLOOR2)) * (FLOOR1 * STEPS + 1) + _cells(p1, FLOOR1)
                own, place = np.unique(cell, return_inverse=True)
                made = [np.bincount(place, minlength=len(own)), np.bincount(place, p2, len(own)), np.bincount(place, p1, len(own))]
                yield pa.record_batch([pa.array(own), *(pa.array(m.astype(np.float64)) for m in made)], names=["cell", "n", "p2", "p1"])

    return gather


def learn_weights(bucket: np.ndarray, n: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float) -> np.ndarray:
    """Mixture weights (pair, word, uniform) of each bucket, by EM on deleted frequencies.

    Buckets without data take the weights of the nearest smaller one; an unseen context
    gives its pair weight to the word."""
    out = np.zeros((BUCKETS, 3))
    last = np.array([0.0, 0.9, 0.1])
    for b in range(BUCKETS):
        own = bucket == b
        if own.any():
            p = np.stack([p2[own], p1[own], np.full(own.sum(), p0)], axis=1)
            w = np.array([0.0, 0.5, 0.5]) if b == 0 else np.full(3, 1 / 3)
            for _ in range(EM_ROUNDS):
                share = w * p
                share /= share.sum(axis=1, keepdims=True)
                new = n[own] @ share / n[own].sum()
                done = np.abs(new - w).max() < 1e-9
                w = new
                if done:
                    break
            last = w
        out[b] = last
    out = np.maximum(out, [0, LEAST_WEIGHT, LEAST_WEIGHT])
    out[0] = [0, *out[0][1:]]
    return out / out.sum(axis=1, keepdims=True)


def _score(n: int, v: int, weights: np.ndarray, kind: pa.DataType):
    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = Counted(row)
                w = weights[bucket_of(x.before)]
                pair = np.where(x.before > 0, x.pair / np.maximum(x.before, 1), 0.0)
                p = w[:, 0] * pair + w[:, 1] * x.c / max(n, 1) + w[:, 2] / (v + 1)
                base = np.log10((x.c + 1) / (n + v + 1))
                sums = [np.add.reduceat(y, x.starts) for y in (base, np.log10(p))]
                known = np.add.reduceat((x.c > 0).astype(np.int64), x.starts)
                yield pa.record_batch(
                    [pa.array(x.doc_ids, kind), pa.array(x.held_out), pa.array(x.lengths), pa.array(known), pa.array(np.full(len(known), n)), *map(pa.array, sums)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score


SCHEMA = "doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty: their one token is the end. A null doc_id has the remainder of
    the empty string. Repeated rows are repeated documents, in the counts too. Texts of any length
    are counted and scored whole. Other columns are ignored; an empty table gives an empty result.
    A text's score is the log10 of its probability under weights that sum to one over the known
    words and one unknown word.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind, arrow = dict(docs.dtypes)["doc_id"], to_arrow_type(docs.schema["doc_id"].dataType)
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    chunks = staged(docs.select("doc_id", "text", out.alias("held_out")).mapInArrow(_chunks(arrow), _CHUNK.format(kind=kind)), "lm-chunks", "none")
    per_doc = F.arrays_zip("lengths", "held_out")
    train = F.aggregate(per_doc, F.lit(0).cast("long"), lambda a, x: a + F.when(x["held_out"], 0).otherwise(x["lengths"]))
    size, n, many = chunks.select(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"), train.alias("train")).agg(F.sum("all"), F.sum("train"), F.count("*")).first()
    if not many:
        return spark.createDataFrame([], SCHEMA.format(kind=kind))
    chunks = numbered(chunks)
    ranges = min(RANGES, max(1, -(-size // RANGE_TOKENS)))
    told, v = answers(chunks.mapInArrow(_offers(ranges), _OFFER), ranges, many)
    aligned = chunks.groupBy("chunk").cogroup(told.groupBy(F.col("node").alias("chunk"))).applyInArrow(_align(arrow), _COUNTED.format(kind=kind))
    counted = staged(aligned, "lm-counted", "none")
    remove(chunks)
    remove(told)
    cells = counted.mapInArrow(_histogram(n), "cell long, n double, p2 double, p1 double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1"))
    rows = np.array([tuple(r) for r in cells.collect()], dtype=np.float64).reshape(-1, 4)  # at most BUCKETS * cells, whatever the input
    bucket = rows[:, 0].astype(np.int64) // ((FLOOR2 * STEPS + 1) * (FLOOR1 * STEPS + 1))
    weights = learn_weights(bucket, rows[:, 1], rows[:, 2] / np.maximum(rows[:, 1], 1), rows[:, 3] / np.maximum(rows[:, 1], 1), 1 / (v + 1))
    return counted.mapInArrow(_score(n, v, weights, arrow), SCHEMA.format(kind=kind))
