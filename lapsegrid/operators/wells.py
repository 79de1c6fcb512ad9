"""Wells: drift paths, windows, seed counts, cell numbers and compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: wells per row -> (well size, half window)
WELL_SIZES = {8: (233, 115), 7: (269, 125), 6: (281, 140)}


def well_size(per_row: Column) -> tuple[Column, Column]:
    """(well size, half window) of a grid; NULL for a grid that isn't known."""
    known = lambda k: F.create_map(*(F.lit(v) for n, s in WELL_SIZES.items() for v in (n, s[k])))
    return F.try_element_at(known(0), per_row), F.try_element_at(known(1), per_row)


def drift_path(shifts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds px, py: the running sums of the stored shifts. A centre is its first place minus these."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return shifts.withColumns({"px": F.sum("dx").over(upto), "py": F.sum("dy").over(upto)})


def best_per_cell(points: DataFrame, score: Column, exact: bool = False) -> DataFrame:
    """The best point of each (row, col); ties by y, then x, then id. exact truncates scores first."""
    rank = F.floor(score) if exact else score
    own = Window.partitionBy("row", "col").orderBy(rank.desc(), "y", "x", "id")
    return points.withColumn("place_", F.row_number().over(own)).where("place_ = 1").drop("place_")


def seeds_in_windows(seeds: DataFrame, windows: DataFrame, keys: list[str], half: int, cell: int = 128) -> DataFrame:
    """Pairs of seeds (keys, x, y) and windows (keys, well, cx, cy) with |x-cx| < half and
    |y-cy| < half.

    A range join as an equi-join: a seed lies in one grid cell, a window is listed under
    the cells it touches, and the strict test follows.
    """
    at = lambda c, d: F.floor((c + F.lit(d)) / F.lit(cell)).cast("int")
    s = seeds.withColumns({"gx": at(F.col("x"), 0), "gy": at(F.col("y"), 0)})
    w = windows.withColumn("gx", F.explode(F.sequence(at(F.col("cx"), -half), at(F.col("cx"), half)))).withColumn("gy", F.explode(F.sequence(at(F.col("cy"), -half), at(F.col("cy"), half))))
    near = (F.abs(F.col("x") - F.col("cx")) < half) & (F.abs(F.col("y") - F.col("cy")) < half)
    return s.join(w, [*keys, "gx", "gy"]).where(near).drop("gx", "gy")


def seed_counts(pairs: DataFrame, spine: DataFrame, by: list[str]) -> DataFrame:
    """Seeds per window with zeros for windows that hold none."""
    counted = pairs.groupBy(*by).agg(F.count("*").alias("n"))
    return spine.join(counted, by, "left").select(*by, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cell_number(counts: DataFrame, keys: list[str], frames: int = 7) -> DataFrame:
    """(keys, k): the most frequent count of the first frames, the smallest of equally
    frequent ones; wells without cells are left out."""
    many = counts.where(F.col("frame") < frames).groupBy(*keys, "n").agg(F.count("*").alias("times"))
    own = Window.partitionBy(*keys).orderBy(F.col("times").desc(), F.col("n").asc())
    return many.withColumn("place_", F.row_number().over(own)).where("place_ = 1 AND n > 0").select(*keys, F.col("n").alias("k"))


def composition(effectors: DataFrame, targets: DataFrame, key: str, most_effectors: int = 1, most_targets: int = 5) -> DataFrame:
    """(key, effectors, targets, composition, routed) of wells within both limits. routed
    names the subset table; other kept wells stand in the experiment table only."""
    both = effectors.withColumnRenamed("k", "effectors").join(targets.withColumnRenamed("k", "targets"), key, "full")
    both = both.select(key, F.coalesce("effectors", F.lit(0)).alias("effectors"), F.coalesce("targets", F.lit(0)).alias("targets"))
    both = both.where((F.col("effectors") <= most_effectors) & (F.col("targets") <= most_targets))
    name = F.concat(F.lit("E"), F.col("effectors").cast("string"), F.lit("T"), F.col("targets").cast("string"))
    routed = F.when(name.isin("E1T1", "E1T2", "E1T3"), name).otherwise("Exp")
    return both.select(key, "effectors", "targets", name.alias("composition"), routed.alias("routed"))
