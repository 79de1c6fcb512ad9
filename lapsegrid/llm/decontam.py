"""Benchmark decontamination: prefix-filtered containment join of item windows.

Every window of an item is a set of word shingles. Shingles are ordered by how often the
corpus has them (counted over all documents); for containment of a whole window the
necessary prefix is one shingle, its rarest, under which the window is filed. A window of
which some shingle is nowhere in the corpus is dropped. Document shingles that may be in
the prefix table are joined to it by equality, with the words around them; length and
positional bounds drop proposals that overrun the document, the rest are compared word by word.

The corpus is scanned twice, whatever the size of the benchmark: once for the frequencies,
once for the proposals. All that is sent to the workers is a Bloom filter of bounded size;
windows, frequencies and proposals are distributed tables. A text is known by two 64-bit
digests, so copies of a text are decided once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lapsegrid.llm.common import Bloom, bounded_batches, columns, staged, text_digests, without

WINDOW = 10
#: Words of a shingle; a shorter window is one shingle.
SHINGLE = 5
#: Word hashes and digests of texts that a worker remembers.
CACHE = 500_000
_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and code points from U+0080 on."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All distinct runs of ``size`` words; a shorter, non-empty text is one window."""
    if not words:
        return []
    return list(dict.fromkeys(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))))


class Hashes(dict):
    """64-bit hashes of words, remembered up to CACHE words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words)), dtype=np.uint64)


def shingle_keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """Keys of the runs of ``size`` words. Equal runs have equal keys."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    key = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        key = (key ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key * np.uint64(0xC2B2AE3D27D4EB4F) ^ (key >> np.uint64(29))


def _windows(size: int):
    """item rows -> (item, window, n, width, keys): windows with the keys of their shingles of ``width`` words."""

    def cut(batches) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for item, text in columns(batch, "item", "text"):
                found = windows_of(words_of(text), size)
                for at in range(0, len(found), 1 << 14):
                    part = found[at : at + (1 << 14)]
                    widths = [min(SHINGLE, len(w)) for w in part]
                    keys = [shingle_keys(hashes.of(list(w)), k).view(np.int64) for w, k in zip(part, widths, strict=True)]
                    yield pa.record_batch(
                        {
                            "item": pa.array([item] * len(part), pa.string()), "window": pa.array([b" ".join(w).decode("utf-8", "surrogatepass") for w in part], pa.string()),
                            "n": pa.array([len(w) for w in part], pa.int32()), "width": pa.array(widths, pa.int32()), "keys": pa.array(keys, pa.list_(pa.int64())),
                        }
                    )

    return cut


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, window, n, width, keys) of ``items`` (item_id, text); a null item_id is the item ""."""
    bounded_batches(items.sparkSession)
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return rows.mapInArrow(_windows(size), "item string, window string, n int, width int, keys array<long>")


class _Batch:
    """Words of all texts of a batch in one run, with the bounds of each text."""

    def __init__(self, texts, hashes: Hashes):
        split = [words_of(t) for t in texts]
        self.sizes = np.array([len(w) for w in split], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.words = list(chain.from_iterable(split))
        self.hashes = hashes.of(self.words)

    def among(self, bloom: Bloom, widths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, place in all words, key) of the shingles that may be in the filter, by width."""
        for width in widths:
            keys = shingle_keys(self.hashes, width)
            at = np.flatnonzero(bloom.might(keys))
            text = np.searchsorted(self.ends, at, side="right")
            inside = at + width <= self.ends[text] if len(at) else np.zeros(0, dtype=bool)
            yield text[inside], at[inside], keys[at[inside]]


def frequencies(docs: DataFrame, keys: DataFrame, n: int, widths: list[int]) -> DataFrame:
    """(key, n): how often the shingles with these keys, and perhaps some others, occur in all documents."""
    words = docs.sparkSession.sparkContext.broadcast(Bloom.of(keys, n).words)

    def count(batches) -> Iterator[pa.RecordBatch]:
        hashes, bloom = Hashes(), Bloom(words.value)
        for batch in batches:
            own = _Batch((t for (t,) in columns(batch, "text")), hashes)
            found = [k for _, _, k in own.among(bloom, widths)]
            key, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.record_batch({"key": pa.array(key.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def prefixes(found: DataFrame, counted: DataFrame) -> DataFrame:
    """(window, n, key, place): each window that can occur under its rarest shingle and that shingle's place in it."""
    each = found.select("window", "n", F.posexplode("keys").alias("place", "key")).distinct()
    known = each.join(counted.withColumnRenamed("n", "often"), "key", "left").withColumn("often", F.coalesce("often", F.lit(0).cast("long")))
    least = known.groupBy("window", "n").agg(F.min(F.struct("often", "key", "place")).alias("least"))
    return least.where("least.often > 0").select("window", "n", "least.key", "least.place")


_FOUND = "doc_id {kind}, d0 long, d1 long, n_words long, found array<struct<at:int,low:int,key:long,around:array<string>>>"


def _proposals(words, widths: list[int], size: int):
    """Documents -> their number of words and the shingles that may be prefixes, with the words around them.

    Of several copies that a worker meets only the first proposes."""

    def propose(batches) -> Iterator[pa.RecordBatch]:
        hashes, bloom, seen = Hashes(), Bloom(words.value), set()
        kind = pa.struct([("at", pa.int32()), ("low", pa.int32()), ("key", pa.int64()), ("around", pa.list_(pa.string()))])
        for batch in batches:
            own = _Batch((t for (t,) in columns(batch, "text")), hashes)
            digests = list(columns(batch, "d0", "d1"))
            begins = (own.ends - own.sizes).tolist()
            ends = own.ends.tolist()
            found: list[list] = [[] for _ in digests]
            first: dict[int, bool] = {}
            for texts, places, keys in own.among(bloom, widths):
                for k, at, key in zip(texts.tolist(), places.tolist(), keys.view(np.int64).tolist(), strict=True):
                    if k not in first:
                        first[k] = digests[k] not in seen
                        if len(seen) >= CACHE:
                            seen.clear()
                        seen.add(digests[k])
                    if first[k]:
                        low, high = max(begins[k], at - size + 1), min(ends[k], at + size)
                        around = [w.decode("utf-8", "surrogatepass") for w in own.words[low:high]]
                        found[k].append({"at": at - begins[k], "low": low - begins[k], "key": key, "around": around})
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"), "d0": batch.column("d0"), "d1": batch.column("d1"), "n_words": pa.array(own.sizes),
                    "found": pa.array(found, pa.list_(kind)),
                }
            )

    return propose


class Search:
    """Benchmark windows in documents: staged tables of one search.

    ``rows``: doc_id, d0, d1, n_words of every document row. ``spans``: d0, d1, start, n,
    window of every occurrence, once per distinct text. ``owners``: window, item.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, size: int = WINDOW):
        spark = docs.sparkSession
        bounded_batches(spark)
        cut = staged(windows(items, size), "bench-windows")
        keys = cut.select(F.explode("keys").alias("key")).distinct()
        widths = sorted(r.width for r in cut.select("width").distinct().collect())  # at most SHINGLE
        texts = docs.select("doc_id", "text", *(d.alias(f"d{k}") for k, d in enumerate(text_digests(docs["text"]))))
        counted = staged(frequencies(docs, keys, keys.count(), widths), "bench-frequencies") if widths else None
        index = staged(prefixes(cut, counted), "bench-prefixes") if widths else None
        filter_words = Bloom.of(index.select("key"), index.count()).words if widths else np.zeros(64, dtype=np.uint64)
        schema = _FOUND.format(kind=dict(docs.dtypes)["doc_id"])
        proposed = texts.mapInArrow(_proposals(spark.sparkContext.broadcast(filter_words), widths, size), schema)
        self.rows = staged(proposed, "bench-proposals")
        self.owners = cut.select("window", "item").distinct()
        each = self.rows.where(F.size("found") > 0).select("d0", "d1", "n_words", F.explode("found").alias("f")).select("d0", "d1", "n_words", "f.*")
        if index is None:
            index = spark.createDataFrame([], "window string, n int, key long, place int")
        start = F.col("at") - F.col("place")
        within = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
        same = F.array_join(F.slice("around", start - F.col("low") + 1, F.col("n")), " ") == F.col("window")
        spans = each.join(index, "key").where(within).where(same)
        self.spans = staged(spans.select("d0", "d1", start.alias("start"), "n", "window").distinct(), "bench-spans")

    def texts(self) -> DataFrame:
        """(d0, d1) of the texts with an occurrence."""
        return self.spans.select("d0", "d1").distinct()

    def summary(self) -> DataFrame:
        """(d0, d1, n_hit, n_items, items_sha256) of the texts with an occurrence."""
        end = F.col("start") + F.col("n")
        before = Window.partitionBy("d0", "d1").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
        places = self.spans.groupBy("d0", "d1", "start").agg(F.max("n").alias("n"))
        new = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
        hits = places.select("d0", "d1", new.alias("new")).groupBy("d0", "d1").agg(F.sum("new").cast("long").alias("n_hit"))
        owned = self.spans.select("d0", "d1", "window").distinct().join(self.owners, "window").select("d0", "d1", "item").distinct()
        names = F.array_join(F.sort_array(F.collect_list("item")), ",")
        listed = owned.groupBy("d0", "d1").agg(F.count("*").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
        return hits.join(listed, ["d0", "d1"])


def report(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are never contaminated. Null item texts have no
    windows; a null item_id counts as the item ""; repeated items count once by item_id. Repeated
    documents and null doc_ids stay rows of their own; very long texts are read whole. Other
    columns are ignored. Without items every count is zero; without documents there are no rows.
    """
    search = Search(docs, items, size)
    nothing = F.sha2(F.lit(""), 256)
    rows = search.rows.drop("found").join(search.summary(), ["d0", "d1"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.select(
        "doc_id", "n_words", zero("n_hit").alias("n_hit"), zero("n_items").alias("n_items"), F.coalesce("items_sha256", nothing).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, start, n, item_id): every occurrence of an item's window in a document, in words.
    Copies of a text, repeated rows too, each have their own; the rules of ``report`` hold."""
    search = Search(docs, items, size)
    spans = search.spans.join(search.owners, "window").select("d0", "d1", "start", "n", F.col("item").alias("item_id")).distinct()
    return search.rows.select("doc_id", "d0", "d1").join(spans, ["d0", "d1"]).select("doc_id", "start", "n", "item_id")


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no item's window occurs.
    Null and empty texts stay; the rules of ``report`` hold."""
    return without(docs, text_digests(docs["text"]), staged(Search(docs, items, size).texts(), "bench-texts"))


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, s.n AS n, i, array_to_string(w[i : i + s.n - 1], ' ') AS g
  FROM d, sizes s, unnest(range(1, len(w) - s.n + 2)) AS t(i) WHERE len(w) >= s.n),
m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit,
       cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
