"""Queries of stacks in three dimensions and of sparse links. A label's frames are a stack; the SQL walks or measures voxels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lapsegrid.operators import solids, tracking, volume, walks
from lapsegrid.plans.catalogue import LINKS, _cells, _stack, query
from lapsegrid.sources.views import FRAME, PX

_VOX = f"{PX}, {FRAME}, vx AS MATERIALIZED (SELECT px.label, fr.frame AS z, px.x, px.y, px.pos, px.i, cast(fr.frame AS bigint) * 4294967296 + px.pos AS id FROM px JOIN fr USING (vec_id, label))"


def _components_sql(source: str, value: str = "1") -> str:
    """CTEs that end in sz(label, comp, size, k): 26-connected components of ``source``, k by size, then first voxel; c names each voxel's."""
    return f"""m AS MATERIALIZED (SELECT label, z, x, y, pos, id, {value} AS v FROM {source}),
e AS MATERIALIZED (SELECT a.label, a.id AS p, b.id AS q FROM m a JOIN m b ON a.label = b.label AND a.v = b.v AND abs(a.z - b.z) <= 1 AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
t AS (SELECT label, p, q FROM e UNION SELECT t.label, t.p, e.q FROM t JOIN e ON t.label = e.label AND t.q = e.p),
c AS MATERIALIZED (SELECT label, p, min(q) AS comp FROM t GROUP BY label, p),
sz AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY size DESC, comp) AS k FROM (SELECT label, comp, count(*) AS size FROM c GROUP BY label, comp))"""


_LABEL_ROWS = "SELECT c.label, cast(c.p // 4294967296 AS integer) AS z, cast(c.p % 4294967296 AS integer) AS pos, cast(sz.k AS integer) AS k FROM c JOIN sz ON sz.label = c.label AND sz.comp = c.comp"


def _flat(rows, name="k"):
    px = rows.select("label", F.col("frame").alias("z"), F.posexplode("px").alias("pos", name))
    return px.where(F.col(name) > 0)


def _frames(spark, sf):
    return _stack(spark, sf).select("label", "frame", F.lit(8).alias("width"), "px")


@query(f"WITH RECURSIVE {_VOX}, b AS (SELECT * FROM vx WHERE i >= 1200), {_components_sql('b')} {_LABEL_ROWS}")
def q_volume_labels(spark, sf):
    """Components of a stack's bright voxels, labelled by size (LG13, LG20)."""
    return _flat(solids.labelled(_frames(spark, sf), ["label"], "frame", lambda im: im >= 1200))


@query(f"WITH RECURSIVE {_VOX}, b AS (SELECT * FROM vx WHERE i >= 1200), {_components_sql('b')} SELECT label, z, pos FROM ({_LABEL_ROWS} WHERE sz.size >= 5)")
def q_volume_large(spark, sf):
    """Voxels of components of at least five voxels (LG12)."""
    return _flat(solids.labelled(_frames(spark, sf), ["label"], "frame", lambda im: im >= 1200, least=5)).drop("k")


@query(f"WITH RECURSIVE {_VOX}, b AS (SELECT * FROM vx WHERE i >= 1200), {_components_sql('b')} SELECT label, z, pos FROM ({_LABEL_ROWS} WHERE sz.k = 1)")
def q_volume_largest(spark, sf):
    """Voxels of a stack's largest component (LG22)."""
    return _flat(solids.labelled(_frames(spark, sf), ["label"], "frame", lambda im: im >= 1200)).where("k = 1").drop("k")


@query(f"WITH RECURSIVE {_VOX}, b AS (SELECT * FROM vx WHERE i >= 1150), {_components_sql('b', 'i // 50')} {_LABEL_ROWS} WHERE sz.size >= 2")
def q_volume_levels(spark, sf):
    """Components of equal classes of brightness: those of each label, or of one label of a stack (LG13, LG48)."""
    return _flat(solids.labelled(_frames(spark, sf), ["label"], "frame", lambda im: (im >= 1150) * (im // 50), least=2))


def _near_sql(f: str, source: str) -> str:
    """The least or greatest of each voxel and its six neighbours, by windows."""
    near = ", ".join(f"{g}(i) OVER {w}" for w in "rcd" for g in ("lag", "lead"))
    windows = "r AS (PARTITION BY label, z, y ORDER BY x), c AS (PARTITION BY label, z, x ORDER BY y), d AS (PARTITION BY label, y, x ORDER BY z)"
    return f"SELECT label, z, x, y, pos, id, {f}(i, {near}) AS i FROM {source} WINDOW {windows}"


@query(f"""WITH RECURSIVE {_VOX}, w AS (SELECT * REPLACE (CASE WHEN i >= 1250 THEN 1 ELSE 0 END AS i) FROM vx), d AS MATERIALIZED ({_near_sql('greatest', 'w')}),
z AS MATERIALIZED ({_near_sql('least', 'd')}), b AS (SELECT * FROM z WHERE i = 1), {_components_sql('b')} {_LABEL_ROWS} WHERE sz.size >= 3""")
def q_volume_labelled(spark, sf):
    """Threshold, closing by a ball, large components, labels by size, all in three dimensions (LG17, LG18, LG20, LG21)."""
    rows = _frames(spark, sf).withColumn("px", F.transform("px", lambda v: F.when(v >= 1250, 1).otherwise(0)))
    for kernel in (volume.dilated, volume.eroded):
        made = volume.stack_filter(rows, ["label", "frame"], "label int, frame int", ["label"], "frame", 8, 8, 1, lambda slab, f=kernel: f(slab, 1, 1), replicate=False)
        rows = made.withColumn("width", F.lit(8))
    return _flat(solids.labelled(rows, ["label"], "frame", lambda im: im > 0, least=3))


@query(f"""WITH {_VOX}, o AS MATERIALIZED (SELECT * FROM vx WHERE i >= 1200)
SELECT a.label, a.z, a.pos, round(min(sqrt(4.0 * (a.z - o.z) * (a.z - o.z) + 0.127449 * ((a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y)))), 6) AS away
FROM vx a JOIN o ON o.label = a.label WHERE a.i < 1200 GROUP BY ALL""")
def q_volume_distance(spark, sf):
    """Distance of each dark voxel to the nearest bright one of its stack, with the spacing of the axes (LG19)."""
    s = tracking.SPACING
    found = solids.distances(_frames(spark, sf), ["label"], "frame", lambda im: im < 1200, (s["z"], s["y"], s["x"]))
    return _flat(found, "away").withColumn("away", F.round("away", 6))


GATE = 60.0
_GATED = f"""{LINKS}, gc AS (SELECT a.user_id, a.frame, nf.next_frame, a.cell, b.cell AS cell2, 10 * sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) + 100 * (greatest(a.area, b.area) - least(a.area, b.area)) / greatest(a.area, b.area) AS cost
 FROM cl a JOIN nf ON nf.user_id = a.user_id AND nf.frame = a.frame JOIN cl b ON b.user_id = a.user_id AND b.frame = nf.next_frame WHERE pow(b.x - a.x, 2) + pow(b.y - a.y, 2) <= {GATE * GATE})"""


@query(f"WITH {_GATED} SELECT user_id, frame, next_frame, cell, cell2, round(cost, 6) AS cost FROM gc")
def q_gated_candidates(spark, sf):
    """Pairs of cells of two frames within a gate, by a join of grid squares (JN6)."""
    found = tracking.with_cost(tracking.gated_candidates(_cells(spark, sf), ["user_id"], GATE))
    return found.select("user_id", "frame", "next_frame", "cell", "cell2", F.round("cost", 6).alias("cost"))


@query(f"""WITH RECURSIVE {_GATED}, gw AS MATERIALIZED (SELECT user_id, frame, cell, cell2, exp(-6 * pow(cost / (max(cost) OVER (PARTITION BY user_id, frame) + 1e-15), 2)) AS weight FROM gc),
rk AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY user_id, frame ORDER BY cell) AS a, dense_rank() OVER (PARTITION BY user_id, frame ORDER BY cell2) AS b FROM gw),
ln AS MATERIALIZED (SELECT user_id, frame, a, cast(1 AS bigint) << cast(b AS integer) AS bit, weight FROM rk UNION ALL SELECT DISTINCT user_id, frame, a, cast(0 AS bigint), cast(0 AS double) FROM rk),
mt AS (SELECT user_id, frame, cast(0 AS bigint) AS k, cast(0 AS bigint) AS used, cast(0 AS double) AS w FROM (SELECT DISTINCT user_id, frame FROM rk) UNION ALL
 SELECT m.user_id, m.frame, m.k + 1, m.used | l.bit, max(m.w + l.weight) FROM mt m JOIN ln l ON l.user_id = m.user_id AND l.frame = m.frame AND l.a = m.k + 1 AND m.used & l.bit = 0 GROUP BY ALL)
SELECT user_id, frame, round(max(w), 6) AS total FROM mt GROUP BY user_id, frame""")
def q_gated_assignment(spark, sf):
    """Greatest total weight of one-to-one links within the gate, over the edges alone (KR13-15)."""
    weighed = tracking.with_weight(tracking.with_cost(tracking.gated_candidates(_cells(spark, sf), ["user_id"], GATE)), ["user_id"])
    return tracking.assignments(weighed, ["user_id"]).groupBy("user_id", "frame").agg(F.round(F.sum("weight"), 6).alias("total"))


# -- walks and nearest structures -----------------------------------------
def _voxels(spark, sf, least):
    """label, z, y, x of a stack's voxels that are at least so bright."""
    px = _frames(spark, sf).select("label", F.col("frame").alias("z"), F.posexplode("px").alias("pos", "i")).where(F.col("i") >= least)
    return px.select("label", "z", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), "i")


_WALK = f"""{_VOX}, s AS MATERIALIZED (SELECT label, z, y, x FROM vx WHERE i >= 1150), b AS (SELECT label, z, y, x, row_number() OVER (PARTITION BY label ORDER BY z, y, x) AS walk FROM vx WHERE i >= 1330),
w AS (SELECT label, cast(walk AS integer) AS walk, z, y, x, 0 AS step FROM b UNION SELECT w.label, w.walk, s.z, s.y, s.x, w.step + 1 FROM w JOIN s ON s.label = w.label AND abs(s.z - w.z) <= 1 AND abs(s.y - w.y) <= 1 AND abs(s.x - w.x) <= 1 WHERE w.step < 4),
r AS MATERIALIZED (SELECT label, walk, z, y, x, min(step) AS step FROM w GROUP BY ALL)"""


def _walks(spark, sf):
    own = Window.partitionBy("label").orderBy("z", "y", "x")
    starts = _voxels(spark, sf, 1330).withColumn("walk", F.row_number().over(own))
    return walks.walks(_voxels(spark, sf, 1150), starts, ["label"], 4)


@query(f"WITH RECURSIVE {_WALK} SELECT * FROM r")
def q_volume_walks(spark, sf):
    """What walks of four steps through a stack's bright voxels reach, and when (LG37)."""
    return _walks(spark, sf)


@query(f"""WITH RECURSIVE {_WALK}, o AS (SELECT label, walk, z, y, x FROM r WHERE step = 0)
SELECT r.label, r.walk, r.z, r.y, r.x, r.step, r.z - o.z AS dz, r.y - o.y AS dy, r.x - o.x AS dx FROM r JOIN o USING (label, walk)
WHERE r.step = 4 OR NOT EXISTS (SELECT 1 FROM r n WHERE n.label = r.label AND n.walk = r.walk AND n.step = r.step + 1 AND abs(n.z - r.z) <= 1 AND abs(n.y - r.y) <= 1 AND abs(n.x - r.x) <= 1)""")
def q_volume_walk_ends(spark, sf):
    """Where those walks end, and the way from their starts (LG37)."""
    return walks.ends(_walks(spark, sf), ["label"], 4)


@query(f"""WITH {_VOX}, p AS (SELECT label, z, y, x, row_number() OVER (PARTITION BY label ORDER BY z, y, x) AS cell FROM vx WHERE i < 700), s AS MATERIALIZED (SELECT label, z, y, x FROM vx WHERE i >= 1250),
n AS (SELECT p.label, p.cell, s.z, s.y, s.x, 2.0 * (s.z - p.z) AS dz, 0.357 * (s.y - p.y) AS dy, 0.357 * (s.x - p.x) AS dx FROM p JOIN s USING (label)),
k AS (SELECT *, sqrt(dz * dz + dy * dy + dx * dx) AS away, row_number() OVER (PARTITION BY label, cell ORDER BY round(sqrt(dz * dz + dy * dy + dx * dx), 9), z, y, x) AS k FROM n)
SELECT label, cast(cell AS integer) AS cell, z, y, x, round(away, 6) AS away, round(CASE WHEN away = 0 THEN 0.0 ELSE degrees(acos(least(1.0, abs(dx) / away))) END, 4) AS angle FROM k WHERE k = 1""")
def q_volume_nearest(spark, sf):
    """The bright voxel nearest to each dark one of its stack, its distance, and the angle of the way there to the rows (LG38, LG40)."""
    s = tracking.SPACING
    own = Window.partitionBy("label").orderBy("z", "y", "x")
    dark = _voxels(spark, sf, 0).where("i < 700").withColumn("cell", F.row_number().over(own)).withColumns({"az": F.lit(0.0), "ay": F.lit(0.0), "ax": F.lit(1.0)})
    found = walks.nearest(dark, _voxels(spark, sf, 1250), ["label"], "cell", (s["z"], s["y"], s["x"]), ["az", "ay", "ax"])
    return found.withColumns({"away": F.round("away", 6), "angle": F.round("angle", 4)})
