"""Variable-capacity best-fit packing of token sequences.

Texts are encoded once. Documents are dealt by a hash of what they are to shards of bounded size, however the
rows were partitioned, and each shard is packed by itself, longest first: a piece goes to the open bin it fits most tightly;
if none fits, the bin size is opened whose cost per token is least, given what is still to
come. At the end each bin shrinks to the smallest permitted length that holds its contents
and is written out as a training sequence. No token is dropped: documents longer than the
largest length are cut into pieces of that length and a rest.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsegrid.llm.common import bounded_batches, staged
from lapsegrid.llm.idstore import encoder

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a bin besides its tokens.
OVERHEAD = 32
#: Repeated rows whose numbers are broadcast (16 bytes each, counted before); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Documents and tokens in a shard, on average.
SHARD, SHARD_TOKENS = 4096, 16 << 20
SCHEMA = "bin_id long, capacity int, n_tokens int, pieces array<struct<doc_id:{kind},piece:int,start:long,n_tokens:int,offset:int>>, ids array<int>"


def _encode(tokenizer: str):
    def encode(batches) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            ids = own.encode_all(batch.column("text"))
            n = [len(x) // own.kind.itemsize for x in ids]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary())})

    return encode


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids of each text and an end id, as little-endian bytes."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_encode(tokenizer), f"doc_id {kind}, n_tokens long, ids binary")


def cheapest(length: int, capacities, overhead: int, sizes: list[int], sums: list[int], to_come: int) -> int:
    """The capacity with the least cost per token for a bin whose first piece has ``length``.

    The first ``to_come`` of the ascending sizes are still to be placed; sums[k] is the sum
    of the first k. A bin can at best be filled by the pieces that fit beside the first one.
    """
    best, chosen = None, None
    for c in capacities:
        if c >= length:
            room = c - length
            fill = length + min(room, sums[min(to_come, bisect_left(sizes, room + 1))])
            cost = (c + overhead) / fill
            if best is None or cost < best:
                best, chosen = cost, c
    return chosen


def best_fit(lengths: np.ndarray, capacities=CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece (all at most the largest capacity), and the final
    capacity of each bin. Ties are placed in input order."""
    order = np.argsort(-lengths, kind="stable")
    ascending = sorted(lengths.tolist())
    sums = [0, *np.cumsum(ascending).tolist()]
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    left: list[int] = []
    used: list[int] = []
    waiting: dict[int, list[int]] = {}  # free room -> open bins
    rooms = 0  # bit r: some open bin has room r
    for done, k in enumerate(order.tolist()):
        n = int(lengths[k])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            own = waiting[room].pop()
            if not waiting[room]:
                rooms &= ~(1 << room)
        else:
            own = len(left)
            room = cheapest(n, capacities, overhead, ascending, sums, len(lengths) - done - 1)
            left.append(room)
            used.append(0)
        bins[k], offsets[k] = own, used[own]
        used[own] += n
        left[own] = room - n
        if left[own]:
            waiting.setdefault(left[own], []).append(own)
            rooms |= 1 << left[own]
    return bins, offsets, [min(c for c in capacities if c >= u) for u in used]


def cut(tokens: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, number, start, length) of the pieces: of the largest length, then the rest."""
    pieces = np.maximum(1, -(-tokens // largest))
    row = np.repeat(np.arange(len(tokens)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * largest
    return row, piece, start, np.minimum(largest, tokens[row] - start)


def _sequences(shard: int, rows: pa.Table, width: int, capacities, overhead: int) -> pa.Table:
    """The packed sequences of a shard's documents."""
    rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("n_tokens", "ascending"), ("d0", "ascending"), ("d1", "ascending"), ("number", "ascending")]))
    tokens = rows["n_tokens"].to_numpy()
    flat = np.frombuffer(b"".join(rows["ids"].to_pylist()), dtype=f"<u{width}")
    begins = np.cumsum(tokens) - tokens
    doc, piece, start, n = cut(tokens, capacities[-1])
    bins, offsets, final = best_fit(n, capacities, overhead)
    order = np.lexsort((offsets, bins))
    doc, piece, start, n, bins, offsets = (x[order] for x in (doc, piece, start, n, bins, offsets))
    at = (begins[doc] + start).tolist()
    ids = np.concatenate([flat[a : a + m] for a, m in zip(at, n.tolist(), strict=True)]).astype(np.int32)
    many = len(final)
    used = np.bincount(bins, n, many).astype(np.int64)
    kinds = [rows.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    parts = [rows["doc_id"].combine_chunks().take(pa.array(doc)), *(pa.array(x, t) for x, t in zip((piece, start, n, offsets), kinds[1:], strict=True))]
    struct = pa.StructArray.from_arrays(parts, fields=[pa.field(c, t) for c, t in zip(("doc_id", "piece", "start", "n_tokens", "offset"), kinds, strict=True)])
    lists = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)
    return pa.table(
        {
            "bin_id": pa.array((shard << 24) + np.arange(many), pa.int64()), "capacity": pa.array(final, pa.int32()), "n_tokens": pa.array(used, pa.int32()),
            "pieces": lists(np.bincount(bins, minlength=many), struct), "ids": lists(used, pa.array(ids)),
        }
    )


def pack(docs: DataFrame, tokenizer: str, capacities=CAPACITIES, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """Training sequences that hold every token once: one row per bin with bin_id, capacity (its final,
    permitted length), n_tokens, pieces (doc_id, piece, start in the document's ids, n_tokens, offset in
    the sequence) and the ids themselves, without padding.

    Null and empty texts are one end token. Null ids and repeated rows are placed like any other;
    very long texts are cut into pieces, none is left out; equal lengths go by doc_id. Other columns
    are ignored. An empty table gives an empty result.
    """
    capacities = tuple(sorted(capacities))
    width = encoder(tokenizer).kind.itemsize
    own = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("ids")]
    digests = {"d0": F.xxhash64(*own), "d1": F.xxhash64(F.lit(1), *own)}
    rows = staged(encoded(docs, tokenizer).withColumn("row", F.monotonically_increasing_id()).withColumns(digests), "packing-ids", "none")
    many, tokens = rows.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    shards = max(1, -(-many // shard), -(-tokens // SHARD_TOKENS))
    numbered = _numbered(rows)
    dealt = numbered.withColumn("shard", F.pmod(F.xxhash64("d0", "d1", "number"), F.lit(shards)).cast("long")).drop("row")

    def place(key: tuple[Any, ...], found: pa.Table) -> pa.Table:
        return _sequences(key[0].as_py(), found, width, capacities, overhead)

    return dealt.groupBy("shard").applyInArrow(place, SCHEMA.format(kind=dict(docs.dtypes)["doc_id"]))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``number``: their place among equal rows, which alone are counted and numbered. Equal rows can stand for
    each other, so the shards hold the same whatever the order."""
    again = rows.groupBy("d0", "d1").count().where(F.col("count") > 1).select("d0", "d1")
    equal = Window.partitionBy("d0", "d1").orderBy("row")
    numbers = staged(rows.select("row", "d0", "d1").join(again, ["d0", "d1"]).select("row", F.row_number().over(equal).alias("number")), "packing-numbers")
    many = numbers.count()
    if not many:
        return rows.withColumn("number", F.lit(0))
    side = F.broadcast(numbers) if many <= BROADCAST_ROWS else numbers
    return rows.join(side, "row", "left").withColumn("number", F.coalesce("number", F.lit(0)))


def placements(packed: DataFrame) -> DataFrame:
    """Placement of every piece: doc_id, piece, start, n_tokens, bin_id, capacity, offset."""
    each = packed.select("bin_id", "capacity", F.explode("pieces").alias("p"))
    return each.select("p.doc_id", "p.piece", "p.start", "p.n_tokens", "bin_id", "capacity", "p.offset")
