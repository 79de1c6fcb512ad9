"""Stacks as volumes: stencils over neighbouring frames, projections, composites, labels and point lists.

A stencil's row holds a frame with the frames around it, sent to it by place, so a volume is
never assembled whole. Pixel tables have x, y, z, i columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsegrid.functions import kernels as K
from lapsegrid.operators.segment import each_frame


# -- stencils -------------------------------------------------------------
def slabs(frames: DataFrame, keys: list[str], order: str, reach: int, replicate: bool = True) -> DataFrame:
    """``frames`` with px replaced by the px of frames -reach..reach around, end to end.

    Beyond the stack's ends its first or last frame is repeated, or, without ``replicate``, pixels are
    NULL and count for nothing. Frame numbers alone go through a window; each frame's pixels are sent to
    the at most 2 reach + 1 places that need them, so a group is a slab and never a stack.
    """
    own, whole = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    places = frames.select(*keys, order).withColumns({"place_": F.row_number().over(own), "last_": F.count("*").over(whole)})
    rows = frames.join(places, [*keys, order])
    sent = []
    for k in range(-reach, reach + 1):  # the frame at ``place_`` stands k frames from the one at ``to``
        to = [F.col("place_") - k]
        if replicate and k:
            # the end frame also stands for those that a place near the end would look for beyond it
            end = (F.col("place_") == F.col("last_")) if k > 0 else (F.col("place_") == 1)
            to += [F.when(end, F.col("place_") - k + (m if k > 0 else -m)) for m in range(1, abs(k) + 1)]
        sent += [F.struct(t.cast("int").alias("to"), F.lit(k).alias("k")) for t in to]
    each = rows.select(*keys, "last_", F.explode(F.array(*sent)).alias("sent_"), F.col("px").alias("part_")).where(F.col("sent_.to").between(1, F.col("last_")))
    gathered = each.groupBy(*keys, F.col("sent_.to").alias("place_")).agg(F.map_from_entries(F.collect_list(F.struct("sent_.k", "part_"))).alias("parts_"))
    both = rows.join(gathered, [*keys, "place_"])
    nothing = F.transform("px", lambda v: F.when(F.lit(False), v))
    around = [F.coalesce(F.try_element_at("parts_", F.lit(k)), nothing) for k in range(-reach, reach + 1)]
    return both.withColumn("px", F.concat(*around)).select(*frames.columns)


def ball(r: int, rz: int) -> list[tuple[int, int, int]]:
    """Offsets (dz, dy, dx) of an ellipsoid of radius r in the plane and rz across it."""
    z, y, x = np.mgrid[-rz : rz + 1, -r : r + 1, -r : r + 1]
    inside = (x / max(r, 1)) ** 2 + (y / max(r, 1)) ** 2 + (z / max(rz, 1)) ** 2 <= 1
    return list(zip(z[inside].tolist(), y[inside].tolist(), x[inside].tolist(), strict=True))


def stencil(slab: np.ndarray, offsets, reduce: Callable, mode: str, fill: float = np.nan) -> np.ndarray:
    """Middle frame of a (depth, h, w) slab with each pixel reduced over its neighbours.
    In-plane borders are repeated (``edge``) or filled (``constant``)."""
    depth, h, w = slab.shape
    r = max(max(abs(dy), abs(dx)) for _, dy, dx in offsets)
    pad = {"constant_values": fill} if mode == "constant" else {}
    wide = np.pad(slab, ((0, 0), (r, r), (r, r)), mode=mode, **pad)
    mid = depth // 2
    return reduce(np.stack([wide[mid + dz, r + dy : r + dy + h, r + dx : r + dx + w] for dz, dy, dx in offsets]), axis=0)


def median_filter(slab: np.ndarray) -> np.ndarray:
    """3x3x3 (or, of one frame, 3x3) median with repeated borders (LG5, LG10, LG29)."""
    d = min(1, slab.shape[0] // 2)
    return stencil(slab, [(z, y, x) for z in range(-d, d + 1) for y in (-1, 0, 1) for x in (-1, 0, 1)], np.median, "edge")


def dilated(slab: np.ndarray, r: int, rz: int = 0) -> np.ndarray:
    """Grey dilation by a ball; what lies outside counts for nothing (LG17)."""
    return stencil(slab.astype(float), ball(r, rz), np.nanmax, "constant")


def eroded(slab: np.ndarray, r: int, rz: int = 0) -> np.ndarray:
    """Grey erosion by a ball; what lies outside counts for nothing (LG18)."""
    return stencil(slab.astype(float), ball(r, rz), np.nanmin, "constant")


def holes_filled(image: np.ndarray, r: int) -> np.ndarray:
    """Pixels that are zero get the value of the grey closing; the others stay (LG51)."""
    closed = eroded(dilated(image[None], r)[None], r)
    return np.where(image == 0, closed, image)


def outline(mask: np.ndarray) -> np.ndarray:
    """Mask pixels with a 4-neighbour off the mask; the border of the image is no such neighbour (LG33-34)."""
    return mask & ~stencil(mask[None], [(0, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)], np.all, "edge")


def stack_filter(frames: DataFrame, keys: list[str], kinds: str, stack: list[str], order: str, width: int, height: int, reach: int, kernel: Callable, replicate: bool = True) -> DataFrame:
    """(keys, px array<double>) of kernel(slab) for each frame of each stack."""
    rows = slabs(frames, stack, order, reach, replicate)
    run = lambda key, im: [(*key, kernel(im.astype(float).reshape(-1, height, width)).ravel())]
    return each_frame(rows, keys, run, f"{kinds}, px array<double>", width)


# -- projections and colours ----------------------------------------------
def first_along(px: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """First non-zero value along an axis, none where all are zero (LG3)."""
    return px.where(F.col(value) != 0).groupBy(*keys).agg(F.min_by(value, order).alias(name))


def collage(x: Column, y: Column, tile: Column, width: int, height: int) -> tuple[Column, Column]:
    """Place of a pixel in a 2x2 collage of four tiles (LG4)."""
    return x + (tile % 2) * width, y + F.floor(tile / 2).cast("int") * height


def composite(channels: list[Column], colours: list[str]) -> Column:
    """Colour of the first channel that isn't zero, else NULL (LG24-25, LG30)."""
    return F.coalesce(*(F.when(c != 0, F.lit(k)) for c, k in zip(channels, colours, strict=True)))


def winner(values: list[Column]) -> list[Column]:
    """Each channel where it is the first of the greatest, else zero (LG6-7)."""
    best = F.array_position(F.array(*values), F.greatest(*values))
    return [F.when(best == k, v).otherwise(F.lit(0)) for k, v in enumerate(values, 1)]


def boxed(px: DataFrame, low: dict[str, int], high: dict[str, int], label: int | None = None) -> DataFrame:
    """Pixels of a closed box, of one label if one is named, with places from its corner (LG43-44)."""
    for c in low:
        px = px.where(F.col(c).between(low[c], high[c]))
    px = px if label is None else px.where(F.col("label") == label)
    return px.withColumns({c: F.col(c) - v for c, v in low.items()})


# -- labels ---------------------------------------------------------------
def merged(px: DataFrame, keys: list[str], pairs: DataFrame) -> DataFrame:
    """Area, centroid and mean of each label after pairs(keys, label, into) are merged (LG49).

    Partial sums per label come first, so the pixels are aggregated before the join."""
    sums = px.groupBy(*keys, "label").agg(F.count("*").alias("area"), *(F.sum(c).alias(c) for c in ("x", "y", "i")))
    named = sums.join(pairs, [*keys, "label"], "left").withColumn("label", F.coalesce("into", "label"))
    total = named.groupBy(*keys, "label").agg(*(F.sum(c).alias(c) for c in ("area", "x", "y", "i")))
    return total.select(*keys, "label", "area", *((F.col(c) / F.col("area")).alias(n) for c, n in (("x", "cx"), ("y", "cy"), ("i", "mean"))))


def split_in_two(mask: np.ndarray, tolerance: float = 0.02, rounds: int = 100) -> np.ndarray:
    """Labels 1 and 2 of a mask's pixels by 2-means, started from the ends of their longest
    spread; 1 holds the first pixel. Ends when no centre moves more than the tolerance (LG50)."""
    at = np.argwhere(mask).astype(float)
    label = np.zeros(mask.shape, dtype=int)
    if len(at) < 2:
        label[mask] = 1
        return label
    centred = at - at.mean(axis=0)
    along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
    centre = at[[along.argmin(), along.argmax()]]
    for _ in range(rounds):
        near = ((at[:, None] - centre) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.stack([at[near == k].mean(axis=0) if (near == k).any() else centre[k] for k in (0, 1)])
        done = np.abs(moved - centre).max() <= tolerance
        centre = moved
        if done:
            break
    label[mask] = np.where(near == near[0], 1, 2)
    return label


def labelled(mask: np.ndarray, closing: int = 0, least: int = 0) -> np.ndarray:
    """Labels 1, 2, ... of the components of a mask, or of its closing, with at least so many pixels, by
    size, then raster order (LG20-22)."""
    if closing:
        mask = eroded(dilated(mask[None].astype(float), closing)[None], closing) > 0
    label = K.components(mask)
    kept = sorted(((k, n) for k, n in K.sizes(label).items() if n >= least), key=lambda kn: (-kn[1], kn[0]))
    names = np.zeros(mask.size + 1, dtype=np.int64)
    names[[k for k, _ in kept]] = np.arange(1, len(kept) + 1)
    return names[label]


def walk_ends(mask: np.ndarray, start: tuple[int, int], steps: int) -> list[tuple[int, int]]:
    """Where a breadth-first walk through touching mask pixels ends: pixels after ``steps`` steps and pixels
    from which no new one is reached, in the walk's order. A pixel is taken by the first that reaches it;
    neighbours come by column, then row (LG37)."""
    if not mask[start]:
        return []
    h, w = mask.shape
    taken, queue, out = {start}, [(start, steps)], []
    for (y, x), left in queue:
        near = [(y + dy, x + dx) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dy or dx) and 0 <= y + dy < h and 0 <= x + dx < w]
        new = [p for p in near if mask[p] and p not in taken] if left else []
        taken.update(new)
        queue.extend((p, left - 1) for p in new)
        if not new:
            out.append((y, x))
    return out


def nearest(mask: np.ndarray, centre: tuple[float, float], axis: tuple[float, float]) -> tuple[tuple[int, int], float, float] | None:
    """(pixel, distance, angle) of the structure's pixel nearest to a point, the first in raster order of
    equally near ones. The angle is that of the way to the pixel with an axis, 0 to 90 degrees (LG38, LG40)."""
    at = np.argwhere(mask)
    if not len(at):
        return None
    way = at - np.array(centre)
    away = np.sqrt((way**2).sum(axis=1))
    k = int(np.argmin(np.round(away, 9)))
    length = away[k] * np.hypot(*axis)
    angle = float(np.degrees(np.arccos(min(1.0, abs(way[k] @ np.array(axis)) / length)))) if length else 0.0
    return (int(at[k][0]), int(at[k][1])), float(away[k]), angle


def within_steps(mask: np.ndarray, start: tuple[int, ...], steps: int) -> np.ndarray:
    """Mask pixels that a walk of at most ``steps`` through touching mask pixels reaches (LG37)."""
    reached = np.zeros_like(mask, dtype=bool)
    reached[start] = mask[start]
    for _ in range(steps):
        grown = reached.copy()
        for axis in range(mask.ndim):
            side = np.moveaxis(grown, axis, 0)
            old = side.copy()
            side[1:] |= old[:-1]
            side[:-1] |= old[1:]
        grown &= mask
        if (grown == reached).all():
            break
        reached = grown
    return reached


# -- contact --------------------------------------------------------------
def nearest_share(mask: np.ndarray, centre: tuple[float, ...], share: float = 0.05) -> float | None:
    """Mean distance of a point to the nearest share of a structure's pixels (at least one)."""
    at = np.argwhere(mask)
    if not len(at):
        return None
    n = max(1, int(len(at) * share))
    return float(np.sort(np.sqrt(((at - np.array(centre)) ** 2).sum(axis=1)))[:n].mean())


def contact(near: Column, area: Column, limit: float = 1.7) -> Column:
    """Whether a cell touches a structure: its nearest-share distance over the radius of a
    disc of its area is within the limit; NULL without a structure (LG42)."""
    return near / F.sqrt(area / F.pi()) <= limit


def sampled(px: Column, x: Column, y: Column, width: int) -> Column:
    """Value of a map, such as a distance map, at a centroid cut to whole pixels (LG52)."""
    return F.try_element_at(px, (F.floor(y) * width + F.floor(x) + 1).cast("int"))


# -- point lists ----------------------------------------------------------
def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points (x, y, z, from 0) of text lines "z y x" that count from 1; other lines are left out (LG26)."""
    parts = F.split(F.trim("value"), r"\s+")
    place = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("int") - 1
    return spark.read.text(path).select(place(3).alias("x"), place(2).alias("y"), place(1).alias("z")).dropna()


def write_points(points: DataFrame, path: str) -> None:
    """Write points as ``read_points`` reads them (LG28)."""
    points.select(F.concat_ws(" ", *((F.col(c) + 1).cast("string") for c in "zyx")).alias("value")).write.text(path)


# -- drawing into colour images -------------------------------------------
def line_pixels(start: tuple[int, int], end: tuple[int, int]) -> list[tuple[int, int]]:
    """Pixels (x, y) of a straight line, one per step along its longer side, ends included; halves round up."""
    (x, y), (u, v) = start, end
    steps = max(abs(u - x), abs(v - y), 1)
    at = lambda a, b, k: a + int(np.floor((b - a) * k / steps + 0.5))
    return list(dict.fromkeys((at(x, u, k), at(y, v, k)) for k in range(steps + 1)))


def with_line(image: np.ndarray, start: tuple[int, int], end: tuple[int, int], first: tuple, last: tuple) -> np.ndarray:
    """A colour image (h, w, 3) with a line from ``last`` at its start towards ``first``: no channel gets darker,
    points outside are moved to the border (LG47)."""
    out = image.astype(np.float64).copy()
    h, w = image.shape[:2]
    inside = [(min(max(x, 0), w - 1), min(max(y, 0), h - 1)) for x, y in (start, end)]
    path = line_pixels(*inside)
    for k, (x, y) in enumerate(path):
        share = k / len(path)
        colour = np.floor(share * np.array(first, dtype=float) + (1 - share) * np.array(last, dtype=float))
        out[y, x] = np.maximum(out[y, x], colour)
    return out


def annotated(image: np.ndarray, glyph: np.ndarray, x: int, y: int, colour: tuple = (0, 0, 255)) -> np.ndarray:
    """A colour image (h, w, 3) with the set pixels of a glyph in one colour, its middle at (x, y) or as near
    to it as the glyph fits into the image (LG45)."""
    out = image.copy()
    (h, w), (gh, gw) = image.shape[:2], glyph.shape
    top, left = min(max(y - gh // 2, 0), max(h - gh, 0)), min(max(x - gw // 2, 0), max(w - gw, 0))
    part = glyph[: h - top, : w - left]
    out[top : top + part.shape[0], left : left + part.shape[1]][part] = colour
    return out
