"""Stacks in three dimensions: components, labels and distance maps. No task holds a stack.

Frames are (keys, order, px, width); a stack is the frames with the same keys, its planes are the frames by
``order``. A frame's components are found from its runs, frames meet the next one by an equi-join, and what
touches is merged over the whole stack by star contraction. Distances are taken in the plane, then across
planes in tiles of pixel columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapsegrid.functions import runs as R
from lapsegrid.operators.segment import bounded_frames, each_frame
from lapsegrid.sources.scratch import kept_as

#: Links of a stack that one task may merge at once; the links of larger stacks are contracted as tables.
LINKS = 1 << 20
#: Values of a tile of pixel columns, over all planes.
TILE = 1 << 22
_RUNS = "y array<int>, x0 array<int>, x1 array<int>, v array<int>, part array<int>"
_NAMES = ("y", "x0", "x1", "v", "part")
#: Names of the working columns.
_TAKEN = {*_NAMES, *(f"{n}2" for n in _NAMES), "place", "width", "height", "px", "a", "b", "node", "root", "n", "size", "label_", "of_", "most", "x", "r", "t", "tile", "places", "found", "last", "sq"}


def _kinds(frame: DataFrame, names: list[str]) -> str:
    own = dict(frame.dtypes)
    return ", ".join(f"{n} {own[n]}" for n in names)


def placed(frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Frames with ``place``, their number in the stack from 0. Frame numbers alone go through the window."""
    if taken := {c.lower() for c in (*keys, order)} & _TAKEN:
        raise ValueError(f"keys may not be called {sorted(taken)}")
    own = Window.partitionBy(*keys).orderBy(order)
    places = frames.select(*keys, order).withColumn("place", F.row_number().over(own) - 1)
    return frames.join(places, [*keys, order])


def parts(frames: DataFrame, keys: list[str], order: str, mark: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(keys, order, place, width, height, runs): the runs of equal values of mark(image), zero left out, with the
    component in the frame that each belongs to."""

    def find(key, image):
        own = R.runs_of(np.asarray(mark(image)).astype(np.int64))
        return [(*key, image.shape[1], image.shape[0], *(getattr(own, n).astype(np.int32) for n in _NAMES))]

    rows = placed(frames, keys, order)
    head = [*keys, order, "place"]
    return each_frame(rows, head, find, f"{_kinds(rows, head)}, width int, height int, {_RUNS}")


def _runs(batch: pa.RecordBatch, k: int, more: str = "") -> R.Runs:
    return R.Runs(*(batch.column(n + more).slice(k, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for n in _NAMES))


def links(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): components of neighbouring planes that touch, as nodes: place, then position in the plane."""
    bounded_frames(found.sparkSession)
    above = found.select(*keys, (F.col("place") - 1).alias("place"), *(F.col(n).alias(f"{n}2") for n in _NAMES))
    both = found.select(*keys, "place", "width", *_NAMES).join(above, [*keys, "place"])

    def touch(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, two, place = _runs(batch, k), _runs(batch, k, "2"), batch.column("place")[k].as_py()
                i, j = R.touching(one, two, batch.column("width")[k].as_py(), (-1, 0, 1))
                pairs = np.unique((one.part[i] << 32) | two.part[j])
                a, b = (place << 32) + (pairs >> 32), ((place + 1) << 32) + (pairs & 0xFFFFFFFF)
                same = {c: batch.column(c).take(pa.array(np.full(len(pairs), k))) for c in keys}
                yield pa.record_batch({**same, "a": pa.array(a), "b": pa.array(b)})

    return both.mapInArrow(touch, f"{_kinds(found, keys)}, a long, b long")


def _merged(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root) of stacks whose links fit a task: one row a stack."""
    packed = edges.groupBy(*keys).agg(F.collect_list(F.struct("a", "b")).alias("x")).select(*keys, F.col("x.a").alias("a"), F.col("x.b").alias("b"))

    def merge(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False) for c in "ab")
                nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
                root = R.joined(len(nodes), at[: len(a)], at[len(a) :])
                same = {c: batch.column(c).take(pa.array(np.full(len(nodes), k))) for c in keys}
                yield pa.record_batch({**same, "node": pa.array(nodes), "root": pa.array(nodes[root])})

    return packed.mapInArrow(merge, f"{_kinds(edges, keys)}, node long, root long")


def _contracted(edges: DataFrame, keys: list[str], rounds: int = 200) -> DataFrame:
    """(keys, node, root) by alternating large-star and small-star rounds (Kiveris et al., 2014), each a table."""

    def tidy(frame):
        return frame.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def state(frame):
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first())

    now = kept_as(tidy(edges), "links")
    was = state(now)
    for _ in range(rounds if was[0] else 0):
        both = now.unionByName(now.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = tidy(both.where("b > a").join(least, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(least, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        now = kept_as(tidy(small.unionByName(least.select(*keys, "a", F.col("m").alias("b")))), "links")
        new = state(now)
        if new == was:
            break
        was = new
    else:
        if was[0]:
            raise RuntimeError("components did not settle")
    own = now.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
    return own.unionByName(now.select(*keys, F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def linked(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root): the smallest node that each node of ``edges`` (keys, a, b) is linked to. A stack's links
    are counted first: up to LINKS are one row, more are contracted as tables."""
    edges = kept_as(edges, "links")
    many = edges.groupBy(*keys).count().where(F.col("count") > LINKS).select(*keys)
    if many.isEmpty():
        return _merged(edges, keys)
    few = edges.join(many, keys, "left_anti")
    return _merged(few, keys).unionByName(_contracted(edges.join(many, keys, "left_semi"), keys))


def components(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, part, root, n): the frames' components, the node that names the stack's component (its first
    pixel by plane, then raster order), and pixels in the frame."""
    cut = F.arrays_zip("part", "x0", "x1")
    own = found.select(*keys, "place", F.explode(cut).alias("r")).groupBy(*keys, "place", F.col("r.part").alias("part"))
    sized = own.agg(F.sum(F.col("r.x1") - F.col("r.x0") + 1).alias("n")).withColumn("node", F.shiftleft(F.col("place").cast("long"), 32) + F.col("part"))
    roots = linked(links(found, keys), keys)
    return sized.join(roots, [*keys, "node"], "left").select(*keys, "place", "part", F.coalesce("root", "node").alias("root"), "n")


def ranked(named: DataFrame, keys: list[str], least: int = 0, exact: bool = False) -> DataFrame:
    """(keys, root, size, label_): labels 1, 2, ... of components with at least ``least`` pixels, by size, then first pixel.
    ``exact`` leaves out the smallest of the large ones, and all but the first where none is too small."""
    sizes = named.groupBy(*keys, "root").agg(F.sum("n").alias("size"))
    own = Window.partitionBy(*keys).orderBy(F.col("size").desc(), "root")
    rows = sizes.withColumn("label_", F.row_number().over(own))
    if exact:
        whole = Window.partitionBy(*keys)
        large, all_ = F.count_if(F.col("size") >= least).over(whole), F.count("*").over(whole)
        most = F.when(large == all_, 1).otherwise(F.greatest(F.lit(1), large - 1))
        return rows.withColumn("most", most).where("label_ <= most").drop("most")
    return rows.where(F.col("size") >= least)


def labelled(frames: DataFrame, keys: list[str], order: str, mark: Callable[[np.ndarray], np.ndarray], least: int = 0, exact: bool = False) -> DataFrame:
    """(keys, order, width, px): the frames of each stack with the labels of its 26-connected components of equal values of
    mark(image), zero left out, numbered by size (LG12-13, LG20-22, LG48)."""
    found = kept_as(parts(frames, keys, order, mark), "runs")
    named = kept_as(components(found, keys), "components")
    labels = named.join(ranked(named, keys, least, exact), [*keys, "root"]).groupBy(*keys, "place").agg(F.collect_list(F.struct("part", "label_")).alias("x"))
    rows = found.join(labels, [*keys, "place"], "left").select(*keys, order, "width", "height", *_NAMES, F.col("x.part").alias("of_"), F.col("x.label_").alias("label_"))

    def draw(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, w, h = _runs(batch, k), batch.column("width")[k].as_py(), batch.column("height")[k].as_py()
                of, label = (batch.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False) for c in ("of_", "label_"))
                names = np.zeros(w * h, dtype=np.int64)
                names[of] = label
                px = R.drawn(own, names[own.part], h, w).astype(np.int32).ravel()
                yield pa.record_batch({**{c: batch.column(c).slice(k, 1) for c in (*keys, order, "width")}, "px": pa.array([px], pa.list_(pa.int32()))})

    return rows.mapInArrow(draw, f"{_kinds(frames, [*keys, order])}, width int, px array<int>")


# -- distances ------------------------------------------------------------
def distances(frames: DataFrame, keys: list[str], order: str, mark: Callable[[np.ndarray], np.ndarray], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(keys, order, width, px array<double>): distance of each pixel of a mask to the nearest one of the stack that is off it; 0
    off it, and the sum of the stack's sides where none is off it (LG19). ``spacing`` is that of z, y and x. Exact:
    squared distances in the plane, then the lower envelope across planes, a tile of pixel columns at a time."""
    rows = placed(frames, keys, order)
    head = [*keys, order, "place"]

    def plane(key, image):
        return [(*key, image.shape[1], R.plane_squares(np.asarray(mark(image), dtype=bool), *spacing[1:]).ravel())]

    flat = kept_as(each_frame(rows, head, plane, f"{_kinds(rows, head)}, width int, sq array<double>"), "squares")
    deepest = flat.agg(F.max("place")).first()[0]
    side = max(1, TILE // ((deepest or 0) + 1))
    tiles = F.floor((F.size("sq") - 1) / side).cast("int")
    cut = F.transform(F.sequence(F.lit(0), tiles), lambda t: F.struct(t.alias("tile"), F.slice("sq", t * side + 1, F.lit(side)).alias("part")))
    columns = flat.select(*keys, "place", F.explode(cut).alias("t")).select(*keys, "place", "t.*").groupBy(*keys, "tile").agg(F.collect_list(F.struct("place", "part")).alias("x"))
    columns = columns.select(*keys, "tile", F.col("x.place").alias("places"), F.flatten("x.part").alias("px"))

    def across(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                places, values = (batch.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False) for c in ("places", "px"))
                order_ = np.argsort(places)
                found = R.envelope(values.reshape(len(places), -1)[order_], spacing[0])
                same = {c: batch.column(c).take(pa.array(np.full(len(places), k))) for c in [*keys, "tile"]}
                yield pa.record_batch({**same, "place": pa.array(places[order_].astype(np.int32)), "part": pa.array(list(found), pa.list_(pa.float64()))})

    bounded_frames(frames.sparkSession)
    back = columns.mapInArrow(across, f"{_kinds(frames, keys)}, tile int, place int, part array<double>")
    px = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tile", "part"))), lambda t: t.part))
    found = back.groupBy(*keys, "place").agg(px.alias("found"))
    whole = flat.groupBy(*keys).agg(F.max("place").alias("last"))
    sides = (F.col("last") + 1) * spacing[0] + F.col("width") * spacing[2] + F.size("found") / F.col("width") * spacing[1]
    value = F.transform("found", lambda v: F.when(v == float("inf"), sides).otherwise(F.sqrt(v)))
    return flat.select(*head, "width").join(found, [*keys, "place"]).join(whole, keys).select(*keys, order, "width", value.alias("px"))
