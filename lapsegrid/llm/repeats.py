"""Substring dedup: windows of words that a document with a smaller id has too, by prefix-partitioned suffix trees.

Suffixes are dealt to groups by a prefix. Its length varies: seven words, and two more wherever the corpus
has more suffixes with the prefix than a group may hold, up to the whole window. The suffixes of a group
are sorted, which is their subtree from left to right; common prefixes of neighbours are its internal nodes. Nodes as
deep as a window are repeats, and their smallest document keeps the words. Runs of repeats in a document,
put together, are the maximal ones.

Only suffixes that may repeat are dealt. The least of the hashes of a window's runs of six words stands for the window;
windows with equal words have equal ones, so a window whose least hash is nowhere else is no repeat. The hashes are
counted over all documents; a Bloom filter of bounded size holds those met twice, and what it lets through wrongly
is a leaf of its own.

Exact copies of a text are told by digests, and only that with the smallest id is looked at. Documents are worked on in
chunks; a chunk sends each of its windows once, so that a passage found everywhere is one suffix per chunk, and
it is the chunk that decides among its own documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsegrid.llm.common import Bloom, bounded_batches, new_path, remove, row_by_row, staged, text_digests, without

WINDOW = 13
#: Words of a run whose hash may stand for a window; lengths of prefixes.
GRAM, LENGTHS = 6, (7, 9, 11, 13)
#: Suffixes that a group may hold before its prefix is lengthened. At most this many prefixes are, per length: beyond, the
#: bound rises to the share of all suffixes that so many can have.
GROUP, PREFIXES = 1 << 20, 1 << 16
#: A task reports prefixes that it has met so often.
SEEN = 32
#: Suffixes answered at once.
ANSWERS = 1 << 18
#: Sorted suffixes looked at together.
SORTED = 1 << 16
#: Word hashes that a worker remembers.
CACHE = 400_000
#: What null ids are compared as: the largest.
LAST = (1 << 63) - 1
GRAMS, TOTAL = 0, -1


class Words(dict):
    """64-bit hashes of words, remembered up to CACHE words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def run_keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit keys of the runs of ``size`` words; those of different sizes have nothing in common."""
    n = max(0, len(hashes) - size + 1)
    key = np.full(n, 0x9E3779B97F4A7C15 * (2 * size + 1) & (1 << 64) - 1, dtype=np.uint64)
    for k in range(size):
        key ^= hashes[k : k + n]
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key


class Texts:
    """Words of several texts in one run: ``flat`` (Arrow), their ``hashes``, ``ends`` and ``sizes`` by text."""

    def __init__(self, texts: pa.Array, known: Words):
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        some = pc.greater(pc.binary_length(flat), 0)
        full = some.to_numpy(zero_copy_only=False)
        if not full.all():
            owner = np.repeat(np.arange(len(sizes)), sizes)[full]
            flat, sizes = flat.filter(some), np.bincount(owner, minlength=len(sizes))
        self.flat, self.sizes, self.ends = flat, sizes, np.cumsum(sizes)
        coded = flat.dictionary_encode()
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        self.hashes = np.array([known[w] for w in names], dtype=np.uint64)[coded.indices.to_numpy()] if names else np.zeros(0, dtype=np.uint64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of each window, the hash that stands for it)."""
        n = len(self.hashes) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        least = run_keys(self.hashes, GRAM)
        reach, have = WINDOW - GRAM + 1, 1
        while have < reach:
            step = min(have, reach - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        inside = np.flatnonzero(self.owner[:n] == self.owner[WINDOW - 1 :])
        return inside, least[inside]

    def kept(self, gone: np.ndarray | None = None, among: np.ndarray | None = None) -> list[str | None]:
        """SHA-256 of the words of each text (of those ``among``, else None) joined by single spaces, but for those that are gone."""
        left = ~gone if gone is not None else np.repeat(among, self.sizes) if among is not None else np.ones(len(self.owner), dtype=bool)
        flat, sizes = self.flat.filter(pa.array(left)), np.bincount(self.owner[left], minlength=len(self.sizes))
        bounds = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int64())
        joined = pc.binary_join(pa.LargeListArray.from_arrays(bounds, flat).cast(pa.list_(flat.type)), " ").cast(pa.binary())
        wanted = np.ones(len(sizes), dtype=bool) if among is None else among
        return [hashlib.sha256(t).hexdigest() if w else None for t, w in zip(joined.to_pylist(), wanted.tolist(), strict=True)]


# -- counts ---------------------------------------------------------------
class Frequent:
    """The frequent among many keys in bounded memory: counts of at most PREFIXES keys, too small by no more than
    the PREFIXES-th part of all that was added (Misra and Gries, 1982)."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, where = np.unique(np.concatenate((self.keys, keys)), return_inverse=True)
        self.counts = np.bincount(where.ravel(), weights=np.concatenate((self.counts, counts)), minlength=len(self.keys)).astype(np.int64)
        if len(self.keys) > PREFIXES:
            self.counts -= np.partition(self.counts, -PREFIXES - 1)[-PREFIXES - 1]
            self.keys, self.counts = self.keys[self.counts > 0], self.counts[self.counts > 0]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys, and how often each occurs."""
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.diff(np.r_[at, len(keys)])


def _counts(batches) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): hashes that stand for windows, with the number of texts; frequent prefixes by length; all windows."""
    known, total, frequent = Words(), 0, {k: Frequent() for k in LENGTHS[:-1]}

    def rows(kind, keys, n):
        return pa.record_batch({"kind": pa.array(np.full(len(keys), kind, dtype=np.int32)), "key": pa.array(keys.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    for batch in batches:
        own = Texts(batch.column("text"), known)
        at, least = own.windows()
        total += len(at)
        if not len(at):
            continue
        owner = own.owner[at]
        new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])
        order = new[np.argsort(least[new], kind="stable")]  # texts stay in order
        key = least[order]
        first = np.r_[True, (key[1:] != key[:-1]) | (owner[order][1:] != owner[order][:-1])]
        keys, n = _counted(key[first])
        yield rows(GRAMS, keys, np.minimum(n, 2))
        for size in LENGTHS[:-1]:  # a prefix is not more frequent than a shorter one of it
            key = run_keys(own.hashes, size)[at]
            keys, n = _counted(np.sort(key))
            keys, n = keys[n > 1], n[n > 1]
            if not len(keys):
                break
            frequent[size].add(keys, n)
            at = at[keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key]
    for size, found in frequent.items():
        yield rows(size, found.keys[found.counts >= SEEN], found.counts[found.counts >= SEEN])
    yield rows(TOTAL, np.zeros(1, dtype=np.uint64), np.array([total]))


def long_prefixes(counted: DataFrame) -> dict[int, np.ndarray]:
    """By length, the prefixes (at most PREFIXES) that more suffixes have than a group may hold."""
    total = counted.where(F.col("kind") == TOTAL).agg(F.sum("n")).first()[0] or 0
    bound = max(GROUP, -(-total // PREFIXES))
    found = counted.where(F.col("kind").isin(*LENGTHS[:-1]) & (F.col("n") >= bound)).select("kind", "key").toArrow()
    kind, key = found["kind"].to_numpy(), found["key"].to_numpy().view(np.uint64)
    return {k: np.sort(key[kind == k]) for k in LENGTHS[:-1]}


# -- chunks ---------------------------------------------------------------
def _chunks(words):
    def cut(batches) -> Iterator[pa.RecordBatch]:
        known, number, bloom = Words(), TaskContext.get().partitionId() << 32, Bloom(words.value)
        for batch in batches:
            own = Texts(batch.column("text"), known)
            at, least = own.windows()
            open_ = np.zeros(batch.num_rows, dtype=bool)
            open_[own.owner[at[bloom.might(least)]]] = True
            digest = own.kept(among=~open_)
            texts = pc.if_else(pa.array(open_), batch.column("text"), pa.scalar(None, pa.string()))
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            yield pa.record_batch(
                {
                    "chunk": pa.array([number], pa.int64()), **{c: one(batch.column(c).to_numpy(), pa.int64()) for c in ("own", "d0", "d1")}, "n_words": one(own.sizes, pa.int64()),
                    "kept_sha256": one(digest, pa.string()), "text": one(texts.to_pylist(), pa.string()),
                }
            )
            number += 1

    return cut


class Suffixes:
    """The distinct windows of a chunk that may repeat, numbered, with the smallest id that has them."""

    def __init__(self, texts: Texts, owners: np.ndarray, bloom: Bloom):
        at, least = texts.windows()
        self.at = at[bloom.might(least)]
        self.hashes = texts.hashes
        whole = run_keys(texts.hashes, WINDOW)[self.at] if len(self.at) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(whole, kind="stable")
        new = np.r_[True, whole[order][1:] != whole[order][:-1]][: len(order)]
        self.number = np.empty(len(order), dtype=np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.first = self.at[order[new]]
        self.whole = whole[order[new]]
        self.owner = owners[texts.owner[self.at]]
        self.low = np.minimum.reduceat(self.owner[order], np.flatnonzero(new)) if len(order) else np.zeros(0, dtype=np.int64)

    def prefixes(self, long: dict[int, np.ndarray]) -> tuple[np.ndarray, pa.Array]:
        """(key of the prefix, what follows it at two bytes a word) of each window."""
        n = len(self.first)
        key, length = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int64)
        left = np.arange(n)
        for size in LENGTHS:
            own = run_keys(self.hashes, size)[self.first[left]]
            key[left], length[left] = own, size
            if size < WINDOW:
                left = left[np.isin(own, long[size])]
            if not len(left):
                break
        symbols = (self.hashes >> np.uint64(48)).astype(">u2")
        rest = np.arange(WINDOW) >= length[:, None]
        data = symbols[(self.first[:, None] + np.arange(WINDOW))[rest]].tobytes()
        bounds = np.concatenate(([0], np.cumsum(2 * (WINDOW - length)))).astype(np.int32)
        return key, pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def _row(batch: pa.RecordBatch, k: int, known: Words, bloom: Bloom) -> tuple[np.ndarray, Texts, Suffixes]:
    """Of a chunk: the texts that may lose words, their words and windows."""
    texts = batch.column("text").slice(k, 1).flatten()
    open_ = np.flatnonzero(pc.is_valid(texts).to_numpy(zero_copy_only=False))
    own = Texts(texts.take(pa.array(open_)), known)
    owners = batch.column("own").slice(k, 1).flatten().to_numpy(zero_copy_only=False)[open_]
    return open_, own, Suffixes(own, owners, bloom)


def _suffixes(words, long: dict[int, np.ndarray]):
    def send(batches) -> Iterator[pa.RecordBatch]:
        known, bloom = Words(), Bloom(words.value)
        for batch in batches:
            for k in range(batch.num_rows):
                _, _, own = _row(batch, k, known, bloom)
                n = len(own.first)
                key, tail = own.prefixes(long)
                yield pa.record_batch(
                    {
                        "prefix": pa.array(key.view(np.int64)), "tail": tail, "whole": pa.array(own.whole.view(np.int64)), "low": pa.array(own.low),
                        "chunk": pa.array(np.full(n, batch.column("chunk")[k].as_py())), "number": pa.array(np.arange(n)),
                    }
                )

    return send


# -- subtrees -------------------------------------------------------------
def _data(values: pa.Array) -> bytes:
    """The bytes of binary values end to end."""
    _, bounds, data = values.buffers()
    ends = np.frombuffer(bounds, dtype=np.int32)[values.offset : values.offset + len(values) + 1]
    return data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data is not None and len(values) else b""


class Subtrees:
    """Sorted suffixes, read a batch after the other: the deep nodes, and the suffixes in them that a smaller id has too."""

    def __init__(self):
        self.last: tuple | None = None
        self.low = 0

    def depths(self, prefix: np.ndarray, tail: pa.Array, whole: np.ndarray) -> np.ndarray:
        """Words that each suffix has in common with the one before it, as far as that is a prefix or more; else 0."""
        before = self.last or (None, None, None)
        sizes = pc.binary_length(tail).to_numpy().astype(np.int64)
        table = np.zeros((len(sizes), WINDOW), dtype=">u2")
        table[np.arange(WINDOW) < sizes[:, None] // 2] = np.frombuffer(_data(tail), dtype=">u2")
        same = np.r_[before[0] == prefix[0], prefix[1:] == prefix[:-1]]
        depth = np.where(same, WINDOW - sizes // 2, 0)
        above = np.frombuffer((before[1] or b"").ljust(2 * WINDOW, b"\0"), dtype=">u2")[None, :]
        agree = np.logical_and.accumulate(table == np.concatenate((above, table[:-1])), axis=1).sum(axis=1)
        depth += np.where(same, np.minimum(agree, sizes // 2), 0)
        alike = np.r_[before[2] == whole[0], whole[1:] == whole[:-1]]
        depth[(depth == WINDOW) & ~alike] = WINDOW - 1  # symbols are short: the whole window's key decides
        self.last = (prefix[-1], tail[-1].as_py(), whole[-1])
        return depth

    def repeats(self, batch: pa.RecordBatch) -> np.ndarray:
        """Which suffixes of the batch are in a node as deep as a window whose smallest id is smaller than theirs."""
        prefix, whole, low = (batch.column(c).to_numpy() for c in ("prefix", "whole", "low"))
        starts = self.depths(prefix, batch.column("tail"), whole) < WINDOW
        lows = np.where(starts, low, self.low)
        at = np.maximum.accumulate(np.where(starts, np.arange(len(low)), -1))  # sorted by id too: a node's first is its smallest
        lows = np.where(at >= 0, low[np.maximum(at, 0)], self.low)
        self.low = int(lows[-1])
        return lows < low


def _larger(batches) -> Iterator[pa.RecordBatch]:
    """Batches of about SORTED rows in place of smaller ones."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= SORTED:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _repeats(batches) -> Iterator[pa.RecordBatch]:
    """Numbers of repeated suffixes by chunk."""
    trees, held, n = Subtrees(), [], 0

    def packed():
        chunk, number = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        order = np.argsort(chunk, kind="stable")
        chunk, number = chunk[order], number[order]
        at = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        return pa.record_batch({"chunk": pa.array(chunk[at]), "numbers": pa.ListArray.from_arrays(pa.array(np.r_[at, len(chunk)], pa.int32()), pa.array(number))})

    for batch in _larger(batches):
        if batch.num_rows:
            found = trees.repeats(batch)
            held.append((batch.column("chunk").to_numpy()[found], batch.column("number").to_numpy()[found]))
            n += int(found.sum())
        if n >= ANSWERS:
            yield packed()
            held, n = [], 0
    if n:
        yield packed()


def _remove(words):
    def apply(batches) -> Iterator[pa.RecordBatch]:
        known, bloom = Words(), Bloom(words.value)
        for batch in batches:
            for k in range(batch.num_rows):
                open_, texts, own = _row(batch, k, known, bloom)
                repeated = np.zeros(len(own.first), dtype=bool)
                repeated[batch.column("numbers").slice(k, 1).flatten().flatten().to_numpy(zero_copy_only=False)] = True
                lost = own.at[repeated[own.number] | (own.owner > own.low[own.number])]
                edges = np.bincount(lost, minlength=len(texts.hashes) + WINDOW) - np.bincount(lost + WINDOW, minlength=len(texts.hashes) + WINDOW)
                gone = np.cumsum(edges)[: len(texts.hashes)] > 0
                flat = {c: batch.column(c).slice(k, 1).flatten() for c in ("d0", "d1", "n_words", "kept_sha256")}
                removed = np.zeros(len(flat["d0"]), dtype=np.int64)
                removed[open_] = np.bincount(texts.owner[gone], minlength=len(open_))
                digest = np.array(flat["kept_sha256"].to_pylist(), dtype=object)
                if len(open_):
                    digest[open_] = texts.kept(gone)
                yield pa.record_batch({c: flat[c] for c in ("d0", "d1", "n_words")} | {"n_removed": pa.array(removed), "kept_sha256": pa.array(digest.tolist(), pa.string())})

    return apply


def judged(texts: DataFrame) -> DataFrame:
    """(d0, d1, n_words, n_removed, kept_sha256) of ``texts`` (own, d0, d1, text): the words of windows that also start in a
    text with a smaller ``own`` (long) are removed. Rows are told apart by ``own`` and the digests d0, d1."""
    spark = texts.sparkSession
    bounded_batches(spark)
    sums = texts.select("text").mapInArrow(_counts, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = staged(sums.where((F.col("kind") != GRAMS) | (F.col("n") > 1)), "window-counts")
    long = long_prefixes(counted)
    twice = counted.where(F.col("kind") == GRAMS)
    words = spark.sparkContext.broadcast(Bloom.of(twice.select("key"), twice.count()).words)
    remove(counted)
    lists = ", ".join(f"{c} array<long>" for c in ("own", "d0", "d1", "n_words"))
    made = texts.select("own", "d0", "d1", "text").mapInArrow(_chunks(words), f"chunk long, {lists}, kept_sha256 array<string>, text array<string>")
    path = new_path(spark, "window-chunks")
    row_by_row(made.write).parquet(path)
    parts = spark.read.schema(made.schema).parquet(path)
    sent = parts.select("chunk", "own", "text").mapInArrow(_suffixes(words, long), "prefix long, tail binary, whole long, low long, chunk long, number long")
    groups = sent.repartition("prefix").sortWithinPartitions("prefix", "tail", "whole", "low")
    found = groups.mapInArrow(_repeats, "chunk long, numbers array<long>").groupBy(F.col("chunk").alias("of")).agg(F.collect_list("numbers").alias("numbers"))
    rows = parts.join(found, F.col("chunk") == F.col("of"), "left").withColumn("numbers", F.coalesce("numbers", F.array().cast("array<array<long>>")))
    return rows.drop("chunk", "of").mapInArrow(_remove(words), "d0 long, d1 long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """Remove from each document of ``docs`` (doc_id, text) the words covered by a window of 13 words that also starts in a document
    with a smaller doc_id: doc_id, n_words, n_removed, kept_sha256.

    doc_ids are integers; a null id counts as the largest, so its words go wherever another document has them, and rows
    with null ids keep what only they have. Rows with equal ids are one document: they take nothing from each other. Null
    and empty texts have no words; texts under 13 words lose none. Texts of any length are one row. Other columns are
    ignored; an empty table gives an empty result.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    d0, d1 = text_digests(F.col("text"))
    keyed = docs.select("doc_id", own.alias("own"), d0.alias("d0"), d1.alias("d1"), "text")
    keys = keyed.drop("text")
    least = keys.groupBy("d0", "d1").agg(F.min("own").alias("low"))
    named = keys.join(least, ["d0", "d1"])
    row = [F.xxhash64("d0", "d1", "own"), F.xxhash64(F.lit(1), "d0", "d1", "own")]
    lost = staged(named.where("own > low").select(row[0].alias("d0"), row[1].alias("d1")).distinct(), "copies")
    firsts = without(keyed.select("own", "d0", "d1", "text"), row, lost)
    found = judged(firsts).dropDuplicates(["d0", "d1"])
    copy = (F.col("own") > F.col("low")) & (F.col("n_words") >= WINDOW)
    nothing = hashlib.sha256(b"").hexdigest()
    return named.join(found, ["d0", "d1"]).select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256")
    )


#: Every window of every document, and the smallest document of each, as DuckDB SQL.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS MATERIALIZED (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, i + j AS i FROM win JOIN low USING (k), unnest(range(13)) AS t(j) WHERE m < doc_id),
one AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT one.r, string_agg(word, ' ' ORDER BY i) AS text FROM one ANTI JOIN gone USING (r, i) GROUP BY one.r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)"""
