"""Operators on frame rows: (block, channel, frame, width, height, px array). Pixels stay in
arrays; nothing here explodes a frame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - used as pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsegrid.functions import kernels as K
from lapsegrid.functions.matching import set_distances
from lapsegrid.operators import segment, wells

STACK = ["block", "channel"]
KINDS = "block int, channel string, frame int"


def px_sum(px: str = "px") -> Column:
    return F.aggregate(px, F.lit(0).cast("long"), lambda a, v: a + v)


def standardised(px: str) -> Column:
    """Pixels less the frame's mean over its spread; NULL in a frame of one value."""
    n, zero = F.size(px), F.lit(0.0)
    mean = F.aggregate(px, zero, lambda a, v: a + v) / n
    square = F.aggregate(px, zero, lambda a, v: a + v * v.cast("double"))
    spread = F.sqrt(F.greatest(zero, (square - n * mean * mean) / (n - 1)))
    parts = F.array(F.struct(mean.alias("m"), spread.alias("s")))
    return F.flatten(F.transform(parts, lambda t: F.transform(px, lambda v: F.try_divide(v - t["m"], t["s"]))))


def border_flags(width: str = "width") -> dict[str, Column]:
    """Whether the first and last row and column of ``px`` sum to zero."""
    part = lambda test: F.expr(f"aggregate(filter(px, (v, i) -> {test}), 0L, (a, v) -> a + v) = 0")
    return {"top": part(f"i < {width}"), "bottom": part(f"i >= size(px) - {width}"), "left": part(f"i % {width} = 0"), "right": part(f"i % {width} = {width} - 1")}


def repair_borders(frames: DataFrame) -> DataFrame:
    """Borders that are empty in a stack's first frame become the stack's mean in all frames."""
    # a frame is reduced to a sum and four flags before anything is shuffled
    marks = frames.select(*STACK, "frame", px_sum().alias("total"), F.size("px").cast("long").alias("n"), F.struct(*(v.alias(k) for k, v in border_flags().items())).alias("flags"))
    stack = marks.groupBy(*STACK).agg(F.floor(F.sum("total") / F.sum("n")).cast("int").alias("mean"), F.min_by("flags", "frame").alias("flags")).select(*STACK, "mean", "flags.*")
    held = frames.join(stack, STACK)
    fixed = F.expr(
        "CASE WHEN top OR bottom OR left OR right THEN transform(px, (v, i) -> CASE WHEN (top AND i < width) OR (bottom AND i >= size(px) - width)"
        " OR (left AND i % width = 0) OR (right AND i % width = width - 1) THEN mean ELSE v END) ELSE px END"
    )
    return held.select(*STACK, "frame", "width", "height", fixed.alias("px"))


def unmix_frames(frames: DataFrame, first: str, second: str, inverse) -> DataFrame:
    """The frames with two channels replaced by their unmixed ones (joined on block and frame)."""
    a, b, c, d = (F.lit(float(v)) for v in inverse)
    one = frames.where(F.col("channel") == first)
    two = frames.where(F.col("channel") == second).select("block", "frame", F.col("px").alias("px2"))
    both = one.join(two, ["block", "frame"])
    out = lambda p, q: F.zip_with("px", "px2", lambda x, y: F.floor(F.greatest(F.lit(0.0), x * p + y * q)).cast("int"))
    pair = F.array(F.struct(F.lit(first).alias("channel"), out(a, b).alias("px")), F.struct(F.lit(second).alias("channel"), out(c, d).alias("px")))
    made = both.select("block", "frame", "width", "height", F.explode(pair).alias("o")).select("block", "o.channel", "frame", "width", "height", "o.px")
    return frames.where(~F.col("channel").isin(first, second)).select(*STACK, "frame", "width", "height", "px").unionByName(made)


def subtract_background(frames: DataFrame, sigma: float = 40.0) -> DataFrame:
    def run(key, image):
        return [(*key, image.shape[1], image.shape[0], K.subtract_background(image, sigma).ravel())]

    return segment.each_frame(frames, [*STACK, "frame"], run, f"{KINDS}, width int, height int, px array<int>")


def register_wells(bright: DataFrame, patterns: list[np.ndarray], n: int, size: int, margin: int, exact: bool = False, sigma: float = 30.0) -> DataFrame:
    """(block, row, col, x, y, type, score): wells of the first bright-field frame, the best one of each
    grid cell. The frame is compared after its background is subtracted, untruncated (sigma 0: as it is)."""
    own = bright.where(F.col("frame") == 0)

    def find(key, image):
        h, w = image.shape
        image = K.subtract_background(image, sigma, truncate=False) if sigma > 0 else image
        return [(*key, int(y * n // h), int(x * n // w), x, y, t, s) for x, y, t, s in segment.find_wells(image, patterns, size, margin, exact)]

    found = segment.each_frame(own, ["block"], find, "block int, row int, col int, x int, y int, type int, score double")
    best = Window.partitionBy("block", "row", "col").orderBy((F.floor("score") if exact else F.col("score")).desc(), "y", "x")
    return found.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def shifts(bright: DataFrame) -> DataFrame:
    """(block, frame, dx, dy, px, py): drift against the frame before, and its running sum.

    Frame numbers alone go through the window; the pixels of a frame meet those of the one before by an
    equi-join, so no task holds a stack. Each comparison gives the stored shift directly, whichever of two
    frames a correlator would turn round.
    """
    own = Window.partitionBy("block").orderBy("frame")
    order = bright.select("block", "frame").withColumn("last", F.coalesce(F.lag("frame").over(own), "frame"))
    after = bright.select("block", "frame", "width", F.col("px").alias("after")).join(order, ["block", "frame"])
    before = bright.select("block", F.col("frame").alias("last"), F.col("px").alias("before"))
    pairs = after.join(before, ["block", "last"]).select("block", "frame", "width", F.concat("before", "after").alias("px"))

    def run(key, image):
        h = image.shape[0] // 2
        return [(*key, *K.drift(image[:h], image[h:]))]

    return wells.drift_path(segment.each_frame(pairs, ["block", "frame"], run, "block int, frame int, dx int, dy int"), ["block"], "frame")


def crop_wells(frames: DataFrame, found: DataFrame, path: DataFrame, size: int) -> DataFrame:
    """(block, row, col, channel, frame, width, px): drift-following windows; empty crops are not kept.

    The wells of a block (at most one per grid cell) travel as one array, so a frame is
    read once however many wells it has.
    """
    listed = found.groupBy("block").agg(F.collect_list(F.struct("row", "col", "x", "y")).alias("wells"))
    rows = frames.join(path.select("block", "frame", F.col("px").alias("sx"), F.col("py").alias("sy")), ["block", "frame"]).join(listed, "block")

    def run(key, image):
        *own, sx, sy, here = key
        out = []
        for w in here:
            own_crop = K.crop(image, int(w["x"] - sx), int(w["y"] - sy), size)
            if own_crop.any():
                out.append((own[0], int(w["row"]), int(w["col"]), own[1], own[2], size, own_crop.ravel()))
        return out

    return segment.each_frame(rows, [*STACK, "frame", "sx", "sy", "wells"], run, "block int, row int, col int, channel string, frame int, width int, px array<int>")


def seed_maps(seeds: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """(keys, width, height, px): frames that are 255 at seeds (keys, x, y) and 0 elsewhere. A frame's row is built from the
    gaps between its seeds in order, so its cost is its pixels, however many seeds it has."""
    places = seeds.groupBy(*keys).agg(F.array_sort(F.collect_set((F.col("y") * width + F.col("x")).cast("int"))).alias("at_"))
    gap = lambda n: F.array_repeat(F.lit(0), n)
    parts = F.transform("at_", lambda p, k: F.concat(gap(p - F.coalesce(F.get("at_", k - 1), F.lit(-1)) - 1), F.array(F.lit(255))))
    px = F.concat(F.flatten(parts), gap(F.lit(width * height - 1) - F.coalesce(F.get("at_", F.size("at_") - 1), F.lit(-1))))
    return places.select(*keys, F.lit(width).alias("width"), F.lit(height).alias("height"), px.alias("px"))


def count_tiles(counts: DataFrame, keys: list[str], size: int = 5000, tile: int = 512) -> DataFrame:
    """(keys, top, left, width, height, px): the scatter image of sparse counts (keys, c1, c2, n) as tiles, c1 across and c2 down, counts
    modulo 2^16 (SNK7). Values from ``size`` on are left out. A tile is built from its own counts; empty ones are not made."""
    part = lambda c: F.floor(F.col(c) / tile).cast("int")
    rows = counts.where((F.col("c1").between(0, size - 1)) & (F.col("c2").between(0, size - 1)))
    own = rows.select(*keys, part("c2").alias("down_"), part("c1").alias("over_"), F.struct((F.col("c2") % tile).cast("int").alias("y"), (F.col("c1") % tile).cast("int").alias("x"), F.col("n").cast("long").alias("n")).alias("e_"))
    packed = own.groupBy(*keys, "down_", "over_").agg(F.collect_list("e_").alias("e_"))
    kinds = dict(packed.dtypes)
    segment.bounded_frames(counts.sparkSession)

    def build(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                top, left = (batch.column(c)[k].as_py() * tile for c in ("down_", "over_"))
                h, w = min(tile, size - top), min(tile, size - left)
                entries = batch.column("e_").slice(k, 1).flatten()
                y, x, n = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x", "n"))
                px = np.zeros((h, w), dtype=np.int64)
                np.add.at(px, (y, x), n)
                one = lambda v: pa.array([v], pa.int32())
                yield pa.record_batch({**{c: batch.column(c).slice(k, 1) for c in keys}, "top": one(top), "left": one(left), "width": one(w), "height": one(h), "px": pa.array([(px % 65536).astype(np.int32).ravel()], pa.list_(pa.int32()))})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "top int, left int, width int, height int, px array<int>"])
    return packed.mapInArrow(build, schema)


def split_cells(masks: DataFrame, numbers: DataFrame, least: int = 50) -> DataFrame:
    """(block, row, col, channel, frame, cell, area, x, y, pts): the cells of mask crops, split
    into each well's number of cells and cleaned. pts are the cell's pixels."""
    rows = masks.join(numbers, ["block", "row", "col", "channel"])

    def run(key, image):
        *own, k = key
        label = K.clean_labels(K.spectral_split(image > 0, int(k), least))
        out = []
        for c in np.unique(label[label > 0]).tolist():
            ys, xs = np.nonzero(label == c)
            out.append((*own, int(c), len(xs), float(xs.mean()), float(ys.mean()), [{"x": int(a), "y": int(b)} for a, b in zip(xs, ys, strict=True)]))
        return out

    keys = ["block", "row", "col", "channel", "frame"]
    return segment.each_frame(rows, [*keys, "k"], run, "block int, row int, col int, channel string, frame int, cell int, area int, x double, y double, pts array<struct<x:int,y:int>>")


def pair_overlaps(cells: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, next_frame, cell, cell2, overlap, away): shared pixels and least pixel distance of all cells of two
    frames. cells: keys, frame, cell, pts; steps: keys, frame, next_frame. A frame's cells are one row, sent once to the
    frame before, however many pairs they make."""
    packed = cells.groupBy(*keys, "frame").agg(F.collect_list(F.struct("cell", "pts")).alias("c")).select(*keys, "frame", F.col("c.cell").alias("cell"), F.col("c.pts").alias("pts"))
    later = packed.select(*keys, F.col("frame").alias("next_frame"), F.col("cell").alias("cell2"), F.col("pts").alias("pts2"))
    rows = packed.join(steps.select(*keys, "frame", "next_frame"), [*keys, "frame"]).join(later, [*keys, "next_frame"])
    kinds = dict(rows.dtypes)
    head = [*keys, "frame", "next_frame"]
    kind = kinds["cell"].removeprefix("array<").removesuffix(">")
    segment.bounded_frames(cells.sparkSession)

    def sets(column, k):
        lists = column.slice(k, 1).flatten()
        ends = np.cumsum(pa.compute.list_value_length(lists).to_numpy())[:-1]
        points = lists.flatten()
        return list(zip(*(np.split(points.field(c).to_numpy(zero_copy_only=False), ends) for c in ("y", "x")), strict=True))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shared, away = set_distances(sets(batch.column("pts"), k), sets(batch.column("pts2"), k))
                one, two = (batch.column(c).slice(k, 1).flatten() for c in ("cell", "cell2"))
                i, j = (x.ravel() for x in np.indices(shared.shape))
                same = {c: batch.column(c).take(pa.array(np.full(len(i), k))) for c in head}
                yield pa.record_batch({**same, "cell": one.take(pa.array(i)), "cell2": two.take(pa.array(j)), "overlap": pa.array(shared.ravel()), "away": pa.array(away.ravel())})

    schema = ", ".join(f"{c} {kinds[c]}" for c in head) + f", cell {kind}, cell2 {kind}, overlap long, away double"
    return rows.select(*head, "cell", "pts", "cell2", "pts2").mapInArrow(run, schema)


def intensity_features(cells: DataFrame, crops: DataFrame, name: str) -> DataFrame:
    """Cells' mean of another channel's crop under their pixels, as column ``name``."""
    keys = ["block", "row", "col", "frame"]
    other = crops.select(*keys, "width", F.col("px").alias("signal"))
    mean = F.expr("aggregate(pts, 0D, (a, p) -> a + element_at(signal, p.y * width + p.x + 1)) / size(pts)")
    return cells.join(other, keys, "left").withColumn(name, F.round(mean, 6)).drop("signal", "width")


def association_features(cells: DataFrame, effector: DataFrame) -> DataFrame:
    """Cells with ``assoc``: effector signal around them."""
    keys = ["block", "row", "col", "frame"]
    rows = cells.join(effector.select(*keys, "width", F.col("px").alias("signal")), keys)
    own = [f.name for f in cells.schema]

    def run(batches):
        for batch in batches:
            made = []
            for pts, signal, width in zip(*(batch.column(c).to_pylist() for c in ("pts", "signal", "width")), strict=True):
                image = np.asarray(signal, dtype=float).reshape(-1, width)
                mask = np.zeros(image.shape, dtype=bool)
                mask[[p["y"] for p in pts], [p["x"] for p in pts]] = True
                made.append(round(K.association(mask, image), 6))
            yield pa.record_batch({**{c: batch.column(c) for c in own}, "assoc": pa.array(made, pa.float64())})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    return rows.select(*own, "signal", "width").mapInArrow(run, f"{kinds}, assoc double")
