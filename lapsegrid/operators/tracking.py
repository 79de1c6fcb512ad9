"""Links between frames, assignments, chains, and motion along tracks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsegrid.functions.matching import assign_edges


def displacement(points: DataFrame, keys: list[str], order: str, exact_limit: float | None = None) -> DataFrame:
    """Adds displacement to the next point: 0 on the last, null if either end is missing.
    exact_limit also calls coordinate sums above it missing, as a fixed sentinel test does."""
    own = Window.partitionBy(*keys).orderBy(order)
    nx, ny, last = F.lead("x").over(own), F.lead("y").over(own), F.lead(F.lit(1)).over(own).isNull()
    away = F.sqrt((nx - F.col("x")) * (nx - F.col("x")) + (ny - F.col("y")) * (ny - F.col("y")))
    if exact_limit is not None:
        away = F.when(F.abs("x") + F.abs("y") + F.abs(nx) + F.abs(ny) <= exact_limit, away)
    gone = F.col("x").isNull() | F.col("y").isNull()
    return points.withColumn("displacement", F.when(last, F.when(~gone, F.lit(0.0))).otherwise(F.round(away, 6)))


def next_frames(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, next_frame): the following frame that holds anything."""
    own = Window.partitionBy(*keys).orderBy("frame")
    return points.select(*keys, "frame").distinct().withColumn("next_frame", F.lead("frame").over(own))


def link_candidates(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of cells in consecutive non-empty frames: an equi-join on the next frame.
    cells: keys, frame, cell, x, y, area."""
    later = cells.select(*keys, F.col("frame").alias("next_frame"), *(F.col(c).alias(f"{c}2") for c in ("cell", "x", "y", "area")))
    return cells.join(next_frames(cells, keys).where("next_frame is not null"), [*keys, "frame"]).join(later, [*keys, "next_frame"])


def gated_candidates(cells: DataFrame, keys: list[str], gate: float) -> DataFrame:
    """``link_candidates`` whose centres are at most ``gate`` apart. Cells meet in squares of a grid as wide as the gate: each
    is sent to the nine around it, so a frame's pairs are those of neighbours, not all."""
    square = lambda c: F.floor(F.col(c) / gate)
    later = cells.select(*keys, F.col("frame").alias("next_frame"), *(F.col(c).alias(f"{c}2") for c in ("cell", "x", "y", "area")), square("x").alias("gx_"), square("y").alias("gy_"))
    near = F.array(*(F.struct((square("x") + dx).alias("gx_"), (square("y") + dy).alias("gy_")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    own = cells.join(next_frames(cells, keys).where("next_frame is not null"), [*keys, "frame"]).withColumn("at_", F.explode(near)).select("*", "at_.gx_", "at_.gy_")
    pairs = own.join(later, [*keys, "next_frame", "gx_", "gy_"]).drop("at_", "gx_", "gy_")
    return pairs.where((F.col("x2") - F.col("x")) ** 2 + (F.col("y2") - F.col("y")) ** 2 <= gate * gate)


def with_cost(pairs: DataFrame) -> DataFrame:
    """Adds cost: 10 centroid distances plus 100 relative area differences."""
    d = F.sqrt((F.col("x2") - F.col("x")) ** 2 + (F.col("y2") - F.col("y")) ** 2)
    most = F.greatest("area", "area2")
    return pairs.withColumn("cost", 10 * d + 100 * (most - F.least("area", "area2")) / most)


def with_overlap_cost(pairs: DataFrame, overlap: str = "overlap", away: str = "away") -> DataFrame:
    """Adds the overlap term to cost: 1000 times 1 - overlap/smaller area, or the least pixel distance."""
    part = F.when(F.col(overlap) > 0, 1 - F.col(overlap) / F.least("area", "area2")).otherwise(F.col(away))
    return pairs.withColumn("cost", F.col("cost") + 1000 * part)


#: Micrometres per pixel, and gate: fixed values.
SPACING, GATE = {"x": 0.357, "y": 0.357, "z": 2.0}, 12.0


def gated_cost(axes: str = "xyz", overlap: bool = True, spacing: dict[str, float] = SPACING, gate: float = GATE) -> Column:
    """Gaussian cost of linking two regions, 1e10 where their centres are further apart than the gate.

    Of each region: centre (cx, ...), mean, n (volume) and box (x0, x1, ...); of the second with _2 after the
    name. Where the boxes overlap, the cost is less by the share of the overlap in half the sum of the box volumes.
    """
    away = F.sqrt(sum(((F.col(f"c{a}") - F.col(f"c{a}_2")) * spacing[a]) ** 2 for a in axes))
    side = lambda a: F.greatest(F.lit(0), F.least(f"{a}1", f"{a}1_2") - F.greatest(f"{a}0", f"{a}0_2"))
    volume = lambda k: reduce(Column.__mul__, (F.col(f"{a}1{k}") - F.col(f"{a}0{k}") + 1 for a in axes))
    shared = reduce(Column.__mul__, map(side, axes)) / (0.5 * (volume("") + volume("_2"))) if overlap else F.lit(0.0)
    # variances of distance, intensity and volume: fixed values
    gaps = [(away, 100.0), (F.col("mean") - F.col("mean_2"), 100.0), (F.col("n") - F.col("n_2"), 100_000.0)]
    spread = sum(g * g / (2 * v) for g, v in gaps)
    return F.when(away > gate, F.lit(1e10)).otherwise((1 - shared) * (1 - F.exp(-spread)))


def distance_change(points: DataFrame, keys: list[str], order: str, distance: str) -> DataFrame:
    """Adds change: the distance less the one before it on the track; the first keeps its own."""
    own = Window.partitionBy(*keys).orderBy(order)
    return points.withColumn("change", F.col(distance) - F.coalesce(F.lag(distance).over(own), F.lit(0.0)))


def with_weight(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds weight: exp(-6 (cost / largest cost of the frame pair)^2)."""
    most = F.max("cost").over(Window.partitionBy(*keys, "frame"))
    return pairs.withColumn("weight", F.exp(-6 * F.try_divide(F.col("cost"), most + 1e-15) ** 2))


def assignments(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The one-to-one links of greatest total weight of each frame pair. pairs: keys, frame,
    cell, cell2, weight; cells that aren't a pair are never linked.

    The pairs of one well in two frames become one row, and rows of many wells share an
    Arrow batch: small groups cost no call of their own. Of gated pairs a row is linear in the cells.
    """
    kinds = dict(pairs.dtypes)
    edge = F.struct(*(F.col(c).cast(k).alias(c) for c, k in (("cell", "long"), ("cell2", "long"), ("weight", "double"))))
    names = ("cell", "cell2", "weight")
    packed = pairs.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(edge)).alias("e")).select(*keys, "frame", *(F.col(f"e.{c}").alias(c) for c in names))
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "frame"]) + ", cell long, cell2 long, weight double"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in names]
            ends = np.cumsum(pa.compute.list_value_length(batch.column("cell")).to_numpy())
            kept = [a + assign_edges(*(x[a:b] for x in flat)) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            row = pa.array(np.repeat(np.arange(len(kept)), [len(k) for k in kept]))
            at = np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)
            yield pa.record_batch({**{k: batch.column(k).take(row) for k in [*keys, "frame"]}, **{c: pa.array(x[at]) for c, x in zip(names, flat, strict=True)}})

    found = packed.mapInArrow(solve, schema)
    return found.select(*keys, "frame", *(F.col(c).cast(kinds[c]).alias(c) for c in names))


def chains(cells: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, cell, track): cells linked through frames share a track; track ids are
    1, 2, ... within keys by first frame and cell. Unlinked cells are tracks of their own.

    Cells, each after the links that start from it, go by in the order of frames: a task holds the tracks that wait for a later cell,
    never a well. Of several links to a cell that from the last cell counts.
    """
    kinds = dict(cells.dtypes)
    at = lambda frame, cell, k: [F.col(frame).cast("long").alias(f"f{k}_"), F.col(cell).cast("long").alias(f"c{k}_")]
    none = [F.lit(None).cast("long").alias(c) for c in ("f2_", "c2_")]
    own = cells.select(*keys, *at("frame", "cell", 1), F.lit(True).alias("is_cell_"), *none)
    known = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))  # a null key equals none
    steps = links.where(known).select(*keys, *at("frame", "cell", 1), F.lit(False).alias("is_cell_"), *at("next_frame", "cell2", 2))
    rows = own.unionByName(steps).repartition(*keys).sortWithinPartitions(*keys, "f1_", "c1_", "is_cell_")
    found = rows.mapInArrow(_follow(keys), ", ".join(f"{k} {kinds[k]}" for k in keys) + ", f1_ long, c1_ long, track long")
    return found.select(*keys, F.col("f1_").cast(kinds["frame"]).alias("frame"), F.col("c1_").cast(kinds["cell"]).alias("cell"), "track")


def _follow(keys: list[str]):
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        well, at, fresh, waiting, seen = None, None, 0, {}, False  # waiting: by frame and cell, the track that goes on there
        for batch in batches:
            rows, tracks = [], []
            names = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            steps = zip(*(batch.column(c).to_pylist() for c in ("f1_", "c1_", "is_cell_", "f2_", "c2_")), strict=True)
            for n, (name, (f, c, is_cell, f2, c2)) in enumerate(zip(names, steps, strict=True)):
                if name != well:
                    well, at, fresh, waiting = name, None, 0, {}
                if (f, c) != at:
                    if at is not None and f != at[0]:
                        waiting = {k: v for k, v in waiting.items() if k >= f}
                    at, ahead, seen = (f, c), [], False
                if not is_cell:
                    ahead.append((f2, c2))
                elif not seen:
                    seen = True
                    track = waiting.get(f, {}).pop(c, None)
                    if track is None:
                        track = fresh = fresh + 1
                    for to, cell in ahead:
                        if (to, cell) > at:
                            waiting.setdefault(to, {})[cell] = track
                    rows.append(n)
                    tracks.append(track)
            if rows:
                kept = batch.take(pa.array(rows))
                yield pa.record_batch({**{c: kept.column(c) for c in [*keys, "f1_", "c1_"]}, "track": pa.array(tracks, pa.int64())})

    return follow


def unlinked(cells: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that no link starts from."""
    return cells.join(links.select(*keys, "frame", "cell"), [*keys, "frame", "cell"], "left_anti")


def motion_summary(points: DataFrame, keys: list[str], time: str) -> DataFrame:
    """(keys, n, avg_speed, path, net, confinement) of tracks of two points or more. One
    shuffle: steps by lag, ends by ordered minima and maxima."""
    own = Window.partitionBy(*keys).orderBy(time)
    dx, dy = F.col("x") - F.lag("x").over(own), F.col("y") - F.lag("y").over(own)
    step, dt = F.sqrt(dx * dx + dy * dy), F.col(time) - F.lag(time).over(own)
    rows = points.withColumns({"step": step, "speed": F.try_divide(step, dt)})
    ends = lambda f, c: f(F.struct(time, c))[c]
    net = F.sqrt((ends(F.max, "x") - ends(F.min, "x")) ** 2 + (ends(F.max, "y") - ends(F.min, "y")) ** 2)
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("speed").alias("speed"), F.sum("step").alias("path"), net.alias("net")).where("n > 1")
    return found.select(
        *keys, "n", F.round(F.col("speed") / (F.col("n") - 1), 6).alias("avg_speed"), F.round("path", 6).alias("path"), F.round("net", 6).alias("net"),
        F.round(F.try_divide("path", "net"), 6).alias("confinement"),
    )


def overlap_of(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """(shared pixels, least distance) of two pixel sets as (n, 2) integer arrays."""
    shared = len({*map(tuple, a.tolist())} & {*map(tuple, b.tolist())})
    if shared:
        return shared, 0.0
    return 0, float(np.sqrt(min(((a - p) ** 2).sum(axis=1).min() for p in b)))
