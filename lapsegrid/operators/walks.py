"""Walks along structures and the structure nearest to a point, in three dimensions, over tables of voxels.

A structure is a table of voxels (keys, z, y, x), thin lines mostly. A walk spreads from its start to touching voxels, a step
for each round of equi-joins on voxel keys; a search looks into a grid of growing squares. Neither holds a stack.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsegrid.sources.scratch import kept_as, shuffled

AXES = ("z", "y", "x")
#: Side of a square of the first search, in units of the coordinates.
SQUARE = 8.0


def _around(frame: DataFrame, keys: list[str], own: list[str]) -> DataFrame:
    """The 26 neighbours of each voxel, with the columns ``own``."""
    near = [F.struct(*((F.col(a) + d).alias(a) for a, d in zip(AXES, (dz, dy, dx), strict=True))) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dz or dy or dx]
    return frame.select(*keys, *own, F.explode(F.array(*near)).alias("at_")).select(*keys, *own, "at_.*")


def walks(points: DataFrame, starts: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """(keys, walk, z, y, x, step): the voxels of a structure that each walk (keys, walk, z, y, x) reaches in at most so many
    steps between touching voxels, and the step at which it first does (LG37). A start off the structure reaches nothing."""
    at = [*keys, "walk", *AXES]
    solid = kept_as(points.select(*keys, *AXES).distinct(), "structure")
    front = kept_as(starts.select(*at).distinct().join(shuffled(solid), [*keys, *AXES]).select(*at, F.lit(0).alias("step")), "walk")
    found = [front]
    for step in range(1, steps + 1):
        near = _around(front, keys, ["walk"]).distinct().join(shuffled(solid), [*keys, *AXES])
        for old in found[-2:]:  # a neighbour of the last front was reached in the last two steps, or never
            near = near.join(shuffled(old.select(*at)), at, "left_anti")
        front = kept_as(near.select(*at, F.lit(step).alias("step")), "walk")
        if front.isEmpty():
            break
        found.append(front)
    return reduce(DataFrame.unionByName, found)


def ends(reached: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """The voxels at which walks end: those of the last step, and those none of whose neighbours was reached later; with the
    way (dz, dy, dx) that the walk has come from its start, at step 0."""
    at = [*keys, "walk", *AXES]
    later = _around(reached.select(*at, (F.col("step") - 1).alias("step")), keys, ["walk", "step"]).distinct()
    last = reached.join(shuffled(later), [*at, "step"], "left_anti").unionByName(reached.where(F.col("step") == steps)).distinct()
    start = reached.where("step = 0").groupBy(*keys, "walk").agg(*(F.min(a).alias(f"{a}0") for a in AXES))
    return last.join(shuffled(start), [*keys, "walk"]).select(*at, "step", *((F.col(a) - F.col(f"{a}0")).alias(f"d{a}") for a in AXES))


def nearest(points: DataFrame, structure: DataFrame, keys: list[str], name: str, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), axis: list[str] | None = None) -> DataFrame:
    """(keys, name, z, y, x, away, angle): the voxel of the structure nearest to each point (keys, name, z, y, x), the first by
    z, y and x of equally near ones, and the angle (0 to 90 degrees) of the way there to the point's ``axis`` (three columns; else NULL)
    (LG38, LG40). Points without a structure in their stack are left out.

    Points look into the squares of a grid around their own; what is nearer than a square's side has been seen then. Those that
    have found nothing so near look again at squares twice as wide."""
    scale = dict(zip(AXES, spacing, strict=True))
    axis = axis or []
    solid = kept_as(structure.select(*keys, *AXES).distinct(), "structure")
    known = solid.select(*keys).distinct()
    left = kept_as(points.select(*keys, name, *(F.col(a).alias(f"{a}_") for a in AXES), *axis).join(known, keys, "left_semi"), "points")
    away: Column = F.round(F.sqrt(sum(((F.col(a) - F.col(f"{a}_")) * scale[a]) ** 2 for a in AXES)), 9)
    spread = both_ends(solid, left, scale)
    side, found = SQUARE, []
    while not left.isEmpty():
        square = lambda c, a: F.floor(F.col(c) * scale[a] / side).cast("long")  # noqa: B023, E731
        near = F.array(*(F.struct(*((square(f"{a}_", a) + d).alias(f"g{a}") for a, d in zip(AXES, (dz, dy, dx), strict=True))) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
        grid = [f"g{a}" for a in AXES]
        asked = left.select("*", F.explode(near).alias("at_")).select(*left.columns, "at_.*")
        seen = asked.join(shuffled(solid.select(*keys, *AXES, *(square(a, a).alias(f"g{a}") for a in AXES))), [*keys, *grid])
        best = seen.groupBy(*left.columns).agg(F.min(F.struct(away.alias("away"), *AXES)).alias("b"))
        done = kept_as((best if side > spread else best.where(F.col("b.away") <= side)).select(*left.columns, "b.*"), "nearest")
        found.append(done)
        if side > spread:
            break
        left = kept_as(left.join(shuffled(done.select(*keys, name)), [*keys, name], "left_anti"), "points")
        side *= 2
    if not found:
        found = [left.select("*", F.lit(0.0).alias("away"), *(F.lit(0).alias(a) for a in AXES)).limit(0)]
    rows = reduce(DataFrame.unionByName, found)
    way = [(F.col(a) - F.col(f"{a}_")) * scale[a] for a in AXES]
    angle = F.lit(None).cast("double")
    if axis:
        dot, size = sum(w * F.col(c) for w, c in zip(way, axis, strict=True)), F.sqrt(sum(F.col(c) * F.col(c) for c in axis))
        angle = F.when(F.col("away") * size > 0, F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot) / (F.sqrt(sum(w * w for w in way)) * size))))).otherwise(0.0)
    return rows.select(*keys, name, *AXES, "away", angle.alias("angle"))


def both_ends(one: DataFrame, two: DataFrame, scale: dict[str, float]) -> float:
    """The greatest extent of two tables together, over all axes."""
    low = lambda f, d: [f(F.col(c) * scale[a]).alias(f"{a}{k}") for a, c in zip(AXES, d, strict=True) for k, f in (("0", F.min), ("1", F.max))]  # noqa: ARG005, E731
    rows = [one.agg(*low(None, AXES)).first(), two.agg(*low(None, [f"{a}_" for a in AXES])).first()]
    rows = [r for r in rows if r[0] is not None]
    return max((max(r[f"{a}1"] for r in rows) - min(r[f"{a}0"] for r in rows) for a in AXES), default=0.0) if rows else 0.0
