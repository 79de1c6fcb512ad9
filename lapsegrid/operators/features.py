"""Per-cell and per-well features."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def region_props(px: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area, cx, cy, ratio): centroid and minor/major axis ratio of a region's pixels."""
    r = px.groupBy(*keys).agg(
        F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy")
    )
    uxx, uyy = F.col("vx") + 1 / 12, F.col("vy") + 1 / 12
    q = F.sqrt((uxx - uyy) * (uxx - uyy) + 4 * F.col("vxy") * F.col("vxy"))
    ratio = F.sqrt(F.greatest(F.lit(0.0), uxx + uyy - q) / (uxx + uyy + q))
    return r.select(*keys, "area", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round(ratio, 6).alias("ratio"))


def region_features(px: DataFrame, keys: list[str], axes: str = "xy") -> DataFrame:
    """Feature vector of each region's pixels: volume, sum, mean, least, most, spread (sample variance), and per axis
    the centre (cx), the centre by intensity (wx) and the box (x0, x1), with box_volume."""
    own = [F.count("*").alias("volume"), F.sum("i").alias("sum"), F.avg("i").alias("mean"), F.min("i").alias("least"), F.max("i").alias("most"), F.var_samp("i").alias("spread")]
    for a in axes:
        own += [F.avg(a).alias(f"c{a}"), F.try_divide(F.sum(F.col(a) * F.col("i")), F.sum("i")).alias(f"w{a}"), F.min(a).alias(f"{a}0"), F.max(a).alias(f"{a}1")]
    rows = px.groupBy(*keys).agg(*own)
    return rows.withColumn("box_volume", reduce(Column.__mul__, (F.col(f"{a}1") - F.col(f"{a}0") + 1 for a in axes)))


def bounding_boxes(px: DataFrame, keys: list[str], axes: str = "xy") -> DataFrame:
    return px.groupBy(*keys).agg(*(f(a).alias(f"{a}{k}") for a in axes for k, f in enumerate((F.min, F.max))))


def box_overlap(a: DataFrame, b: DataFrame, axes: str = "xy", exact: bool = False) -> Column:
    """Shared pixels of two boxes. ``exact`` takes the last pixel of a side for its end, so each side is one less."""
    side = lambda c: F.greatest(F.lit(0), F.least(a[f"{c}1"], b[f"{c}1"]) - F.greatest(a[f"{c}0"], b[f"{c}0"]) + F.lit(0 if exact else 1))
    return reduce(Column.__mul__, map(side, axes))


def masked(px: Column, other: Column, on: Callable[[Column], Column]) -> tuple[Column, Column]:
    """(sum, number) of another channel's pixels where on(pixel), both frames as arrays: no pixel becomes a row."""
    add = lambda a, v: a + v
    total = F.aggregate(F.zip_with(px, other, lambda p, o: F.when(on(p), o).otherwise(0).cast("double")), F.lit(0.0), add)
    return total, F.aggregate(F.transform(px, lambda p: on(p).cast("long")), F.lit(0).cast("long"), add)


def zonal_mean(mask: DataFrame, intensity: DataFrame, pixel: list[str], keys: list[str]) -> DataFrame:
    """(keys, mean, n): mean of another channel's intensity ``i`` under a mask."""
    return mask.join(intensity, pixel).groupBy(*keys).agg(F.round(F.avg("i"), 6).alias("mean"), F.count("*").alias("n"))


def ring_weights(reach: int = 10) -> list[tuple[int, int, float]]:
    """(dx, dy, weight) of the offsets within reach: sum of 1/r^2 over the rings that hold it."""
    out = []
    for dx in range(-reach, reach + 1):
        for dy in range(-reach, reach + 1):
            d2 = dx * dx + dy * dy
            if 0 < d2 <= reach * reach:
                first = next(r for r in range(1, reach + 1) if r * r >= d2)
                out.append((dx, dy, sum(1 / r**2 for r in range(first, reach + 1))))
    return out


def association(mask: DataFrame, effector: DataFrame, keys: list[str], width: int, reach: int = 10) -> DataFrame:
    """(keys, assoc): effector signal near a mask, by nearest-ring weight, over all effector
    signal of the frame.

    The distance of an effector pixel to the mask is found by an equi-join over the bounded
    table of offsets within reach, not by a pairwise join.
    """
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in ring_weights(reach)))
    around = mask.select(*keys, "x", "y", F.explode(offsets).alias("o")).select(*keys, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "o.w")
    around = around.where((F.col("x").between(0, width - 1)) & F.col("y").between(0, width - 1)).groupBy(*keys, "x", "y").agg(F.max("w").alias("w"))
    inside = mask.select(*keys, "x", "y").withColumn("inside", F.lit(True))
    near = effector.join(around, [*keys, "x", "y"], "left").join(inside, [*keys, "x", "y"], "left")
    weight = F.when(F.col("inside"), 0.0).otherwise(F.coalesce("w", F.lit(0.0)))
    return near.groupBy(*keys).agg(F.round(F.try_divide(F.sum(weight * F.col("i")), F.sum("i")), 6).alias("assoc"))
