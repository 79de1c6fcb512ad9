"""Histograms and the thresholds and gates derived from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(px: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, bin, n): map-side combined counts."""
    return px.groupBy(*keys, value.alias("bin")).agg(F.count("*").alias("n"))


def _cumulated(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and bin sums up to each bin, and in all. A key's rows are its bins, at most
    the number of intensity levels, whatever the number of pixels."""
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    weighted = F.col("n") * F.col("bin")
    return hist.select(
        *keys, "bin", F.sum("n").over(upto).alias("c"), F.sum(weighted).over(upto).alias("s"), F.sum("n").over(whole).alias("c_all"), F.sum(weighted).over(whole).alias("s_all")
    )


def _first_best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place_", F.row_number().over(own)).where("place_ = 1").drop("place_")


def min_error_threshold(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, th, cost): Poisson minimum-error threshold. The smallest bin of least defined
    cost; where no cost is defined, the largest bin with a null cost."""
    r = _cumulated(hist, keys).withColumns(
        {"p0": F.col("c") / F.col("c_all"), "p1": (F.col("c_all") - F.col("c")) / F.col("c_all"), "mu": F.col("s_all") / F.col("c_all")}
    )
    m0 = F.try_divide(F.col("s").cast("double"), F.col("c").cast("double"))
    m1 = F.try_divide((F.col("s_all") - F.col("s")).cast("double"), (F.col("c_all") - F.col("c")).cast("double"))
    r = r.withColumns({"m0": m0, "m1": m1})
    sound = (F.col("p0") > 0) & (F.col("p1") > 0) & (F.col("m0") > 0) & (F.col("m1") > 0)
    cost = F.col("mu") - F.col("p0") * (F.ln("p0") + F.col("m0") * F.ln("m0")) - F.col("p1") * (F.ln("p1") + F.col("m1") * F.ln("m1"))
    r = r.withColumn("cost", F.round(F.when(sound, cost), 6))
    best = _first_best(r, keys, [F.col("cost").asc_nulls_last(), F.when(F.col("cost").isNull(), -F.col("bin")).otherwise(F.col("bin"))])
    return best.select(*keys, F.col("bin").alias("th"), "cost")


def minimum_error(image: np.ndarray) -> int:
    """``min_error_threshold`` of one frame of whole numbers, by the same rule: costs are rounded to six
    places, the smallest value of least cost wins, and the maximum where no cost is defined."""
    n = np.bincount(image.ravel())
    i = np.arange(len(n))
    c, s = np.cumsum(n), np.cumsum(n * i)
    with np.errstate(all="ignore"):
        p0, p1 = c / c[-1], (c[-1] - c) / c[-1]
        m0, m1 = s / c, (s[-1] - s) / (c[-1] - c)
        cost = np.round(s[-1] / c[-1] - p0 * (np.log(p0) + m0 * np.log(m0)) - p1 * (np.log(p1) + m1 * np.log(m1)), 6)
    sound = (n > 0) & (p0 > 0) & (p1 > 0) & (m0 > 0) & (m1 > 0)
    return int(np.argmin(np.where(sound, cost, np.inf))) if sound.any() else int(image.max())


def otsu_threshold(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, th, spread): the smallest bin of greatest between-class variance."""
    r = _cumulated(hist, keys)
    n0, n1 = F.col("c").cast("double"), (F.col("c_all") - F.col("c")).cast("double")
    gap = F.try_divide(F.col("s").cast("double"), n0) - F.try_divide((F.col("s_all") - F.col("s")).cast("double"), n1)
    total = F.col("c_all").cast("double")
    r = r.withColumn("spread", F.round(F.coalesce(n0 / total * (n1 / total) * gap * gap, F.lit(0.0)), 6))
    return _first_best(r, keys, [F.col("spread").desc(), F.col("bin").asc()]).select(*keys, F.col("bin").alias("th"), "spread")


def joint_histogram(rows: DataFrame, first: Column, second: Column, cut: int = 5000) -> DataFrame:
    """(c1, c2, n) of two channels; values of ``cut`` and more are left out."""
    return rows.select(first.alias("c1"), second.alias("c2")).where((F.col("c1") < cut) & (F.col("c2") < cut)).groupBy("c1", "c2").agg(F.count("*").alias("n"))


def background_gate(px: DataFrame, keys: list[str], mask: Column, least: float = 0.9) -> DataFrame:
    """(keys, share, bad): share of the larger class; bad below ``least`` or if there is one class."""
    on = F.avg(mask.cast("double"))
    share = px.groupBy(*keys).agg(F.greatest(on, 1 - on).alias("share"))
    return share.select(*keys, F.round("share", 6).alias("share"), ((F.col("share") < least) | (F.col("share") == 1.0)).alias("bad"))


def foreground_choice(px: DataFrame, keys: list[str], mask: Column) -> DataFrame:
    """(keys, n_on, n_on_exact): foreground pixels when the smaller class is the foreground,
    and when class numbers are taken as they come (then a larger class 1 turns all pixels on)."""
    r = px.groupBy(*keys).agg(F.sum(mask).alias("on"), F.count("*").alias("n"))
    more = F.col("on") > F.col("n") - F.col("on")
    return r.select(*keys, F.when(more, F.col("n") - F.col("on")).otherwise(F.col("on")).alias("n_on"), F.when(more, F.col("n")).otherwise(F.col("on")).alias("n_on_exact"))
