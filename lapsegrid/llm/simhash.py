"""SimHash near-duplicates: exact tiled comparison of 64-bit fingerprints.

Fingerprints within the radius agree on at least ``blocks - radius`` of ``blocks`` bit
blocks, so rows are dealt by every such choice of blocks (an exact blocking: no pair
within the radius is missed). Inside a bucket, fingerprints are cut into tiles ordered
by population count; a pair of tiles is skipped when the counts differ by more than
the radius, and the others are compared by numpy exclusive-or and bit counts. Buckets
larger than a tile are dealt out as pairs of tiles, so no bucket sits in one task.
A bucket emits a spanning forest of its links, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsegrid.llm.common import bounded_batches, columns, lower_bytes, staged, without
from lapsegrid.llm.graph import components

SEED = 42
WORDS = 4
RADIUS = 4
BITS = 64
#: Fingerprints of a bucket that one task compares at once.
TILE = 4096
#: Side of one exclusive-or matrix.
INNER = 512
#: Mean bucket size above which a more selective choice of blocks is used.
MEAN_BUCKET = 256
#: Shingles hashed at once, so that a very long text stays bounded.
CHUNK = 1 << 18


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of word shingles; no words: 0; fewer words than a shingle: one shingle."""
    tokens = lower_bytes(text).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(tokens) - words + 1)
    first, final = starts[:last].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, last, CHUNK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + CHUNK], final[at : at + CHUNK], strict=True)]
        raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * counts > last, bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [fingerprint(t) for (t,) in columns(batch, "text")]
        signed = np.array(made, dtype=np.uint64).view(np.int64)
        more = {n: batch.column(n) for n in batch.schema.names if n not in ("doc_id", "text")}
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(signed)} | more)


def fingerprints(docs: DataFrame, *digests: Column) -> DataFrame:
    """(doc_id, fp, digest0, ...): one row per document, fp the fingerprint as a signed
    64-bit integer, digests further long columns of the document."""
    bounded_batches(docs.sparkSession)
    more = [d.alias(f"digest{k}") for k, d in enumerate(digests)]
    schema = ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}", "fp long", *(f"digest{k} long" for k in range(len(more)))])
    return docs.select("doc_id", "text", *more).mapInArrow(_fingerprints, schema)


def block_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the choices of blocks for n fingerprints: the fewest blocks whose
    mean bucket stays under MEAN_BUCKET, at most radius + 4. Every scheme is exact."""
    for blocks in range(radius + 1, radius + 5):
        if n <= MEAN_BUCKET << (BITS * (blocks - radius) // blocks):
            break
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def cross_links(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles of distinct fingerprints that connect what all their links connect, as
    index pairs: a spanning forest, grown an inner tile pair at a time. Pairs within a tile are not compared."""
    orders = [np.argsort(np.bitwise_count(x), kind="stable") for x in (left, right)]
    a, b = left[orders[0]], right[orders[1]]
    wa, wb = (np.bitwise_count(x).astype(np.int64) for x in (a, b))
    parent = list(range(len(a) + len(b)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out: list[tuple[int, int]] = []
    for i in range(0, len(a), INNER):
        last = min(i + INNER, len(a))
        for j in range(0, len(b), INNER):
            end = min(j + INNER, len(b))
            if wb[j] - wa[last - 1] > radius:
                break
            if wa[i] - wb[end - 1] > radius:
                continue
            near = np.bitwise_count(a[i:last, None] ^ b[None, j:end]) <= radius
            while near.any():  # each round joins every row that still has a link to another part
                rows, cols = (np.array([root(k) for k in range(x, y)]) for x, y in ((i, last), (len(a) + j, len(a) + end)))
                near &= rows[:, None] != cols[None, :]
                at = np.flatnonzero(near.any(axis=1))
                for x, y in zip(at.tolist(), near[at].argmax(axis=1).tolist(), strict=True):
                    p, q = root(i + x), root(len(a) + j + y)
                    if p != q:
                        parent[p] = q
                        out.append((i + x, j + y))
    at = np.array(out, dtype=np.int64).reshape(-1, 2)
    return orders[0][at[:, 0]], orders[1][at[:, 1]]


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, as index pairs."""
    none = np.empty(0, dtype=np.int64)
    if len(fps) < 2:
        return none, none
    weight = np.bitwise_count(fps).astype(np.int64)
    order = np.argsort(weight, kind="stable")
    a, w = fps[order], weight[order]
    linked = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), INNER):
        for j in range(i, len(a), INNER):
            if w[j] - w[min(i + INNER, len(a)) - 1] > radius:
                break
            near = np.bitwise_count(a[i : i + INNER, None] ^ a[None, j : j + INNER]) <= radius
            if i == j:
                np.fill_diagonal(near, False)
            if near.any():
                linked[i : i + INNER] |= near.any(axis=1)
                linked[j : j + INNER] |= near.any(axis=0)
    rest = np.flatnonzero(linked)
    left, right = [], []
    while rest.size:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            at = queue.pop()
            near = np.bitwise_count(a[rest] ^ a[at]) <= radius
            if near.any():
                hit = rest[near]
                left.append(np.full(len(hit), at))
                right.append(hit)
                queue.extend(hit)
                rest = rest[~near]
    if not left:
        return none, none
    return order[np.concatenate(left)], order[np.concatenate(right)]


def _bucket_links(batches) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by bucket and tile pair; what is open is carried from batch to batch. A pair of
    one tile with itself compares the tile, one of two tiles only across."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] = []
    held_key = None

    def close():
        rows = np.concatenate(held, axis=1)
        if held_key[3] == held_key[4]:
            fps = np.unique(rows[0])
            i, j = spanning_links(fps.view(np.uint64))
            return fps[i], fps[j]
        left, right = (np.unique(rows[0][rows[1] == t]) for t in held_key[3:])
        i, j = cross_links(left.view(np.uint64), right.view(np.uint64))
        return left[i], right[j]

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("choice", "key", "cell", "i", "j")])
        rows = np.stack([batch.column("fp").to_numpy(zero_copy_only=False), batch.column("mine").to_numpy(zero_copy_only=False).astype(np.int64)])
        if not batch.num_rows:
            continue
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        out = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            key = tuple(keys[:, a])
            if key != held_key:
                if sum(h.shape[1] for h in held) > 1:
                    out.append(close())
                held, held_key = [], key
            held.append(rows[:, a:b])
        if out:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)
    if sum(h.shape[1] for h in held) > 1:
        a, b = close()
        yield pa.record_batch([pa.array(a), pa.array(b)], schema=schema)


def links(distinct: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` within the radius."""
    spark = distinct.sparkSession
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(n, radius)]
    choices = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)))
    cell = F.floor(F.bit_count("fp") / (radius + 1)).cast("int")
    rows = (
        distinct.select("fp", F.explode(choices).alias("c"), cell.alias("own"))
        .select("fp", "c.choice", "c.key", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("cell"))
    )
    at = ["choice", "key", "cell"]
    large = rows.groupBy(*at).count().where(F.col("count") > tile).select(*at, F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(F.least(u, mine).alias("i"), F.greatest(u, mine).alias("j")))
    dealt = (
        rows.join(large, at, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .select("fp", *at, mine.alias("mine"), F.explode(others).alias("p")).select("fp", *at, "mine", "p.i", "p.j")
    )
    group = [*at, "i", "j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(_bucket_links, "a long, b long")


def classes(fps: DataFrame, radius: int = RADIUS, name: Column | str = "doc_id") -> DataFrame:
    """(fp, component_id): for every distinct fingerprint the smallest name, a doc_id, of its class.

    Documents with a null doc_id count as links but never name a class unless all are null.
    """
    distinct = staged(fps.groupBy("fp").agg(F.min(name).alias("low")), "distinct")
    n = distinct.count()
    roots = staged(components(links(distinct.select("fp"), n, radius)), "roots")
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = known.groupBy("root").agg(F.min("low").alias("component_id"))
    return staged(known.join(named, "root").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id.

    Null and empty texts have fingerprint zero and are linked like any other; texts of any
    length are read whole, their shingles hashed CHUNK at a time. Repeated rows stay repeated. Columns other than doc_id and text are ignored. An empty table
    gives an empty result.
    """
    fps = staged(fingerprints(docs), "fingerprints")
    found = fps.join(classes(fps), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each class the row with the smallest doc_id.

    All columns of ``docs`` are kept. A null doc_id comes after all others; rows of a class
    with the same doc_id are ordered by their text's digests, then by the digest of their other columns.
    Rows of different classes never drop each other, whatever their doc_ids. Null and empty texts
    are one class; very long texts are read whole; an empty table gives an empty result.
    """

    def keys(rows):  # a hash passes over nulls, so it is told where they are
        own = [rows["doc_id"].isNull(), rows["doc_id"], rows["text"].isNull(), rows["text"]]
        return [F.xxhash64(*own), F.xxhash64(F.lit(1), *own)]

    names = ["digest0", "digest1"]
    fps = staged(fingerprints(docs, *keys(docs)), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *names)
    # The same text has the same fingerprint, so a key is in one class only.
    found = fps.join(classes(fps, name=rank), "fp").select(*names, rank.eqNullSafe(F.col("component_id")).alias("first"))
    short = [F.col(n).alias(f"d{k}") for k, n in enumerate(names)]
    found = staged(found.groupBy(*short, "first").count(), "survivors")
    kept = without(docs, keys(docs), found.where("not first").select("d0", "d1"))
    again = staged(found.where("first and count > 1").select("d0", "d1"), "again")
    if again.isEmpty():
        return kept
    single = without(kept, keys(kept), again)
    others = F.xxhash64(F.to_json(F.struct(*(kept[c] for c in docs.columns if c != "text"))))
    row = F.struct(*(kept[c] for c in docs.columns))
    same = [k == again[n] for k, n in zip(keys(kept), ("d0", "d1"), strict=True)]
    repeated = kept.join(again, same[0] & same[1]).groupBy(again["d0"], again["d1"]).agg(F.min_by(row, others).alias("row_"))
    return single.unionByName(repeated.select("row_.*"))
