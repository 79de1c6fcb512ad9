"""Registry of the engine's own queries over the driver's tables, with DuckDB oracles.

The driver's tables hold no images, so each query runs the engine's operator on an
analogue view (``lapsegrid.sources.views``): embeddings as 8x8 frames with the label as
well, events as tracks and as seeds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsegrid.functions import kernels as K
from lapsegrid.functions import pixels as P
from lapsegrid.operators import features, histogram, segment, stack, tables, tracking, volume, wells
from lapsegrid.sources import manifest
from lapsegrid.sources.scratch import shuffled
from lapsegrid.sources.views import FRAME, PX, SD, TP, frame_index, frames, pixels, seeds, table, tracks

QUERIES: dict = {}
ORACLES: dict = {}
MIX = (1.0, 0.0, 0.241, 0.970)
TH = 1000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def on(c: str = "i"):
    return P.above(F.col(c), TH)


# -- sources and projections ----------------------------------------------
@query("""SELECT event_id, cast(substr(name, strpos(name, '_s') + 2, 3) AS integer) AS block, cast(regexp_extract(name, 't([0-9]{2})c', 1) AS integer) AS frame, token AS role
FROM (SELECT event_id, 'run_s' || lpad(cast(event_id % 500 + 1 AS varchar), 3, '0') || 't' || lpad(cast(hour(ts) AS varchar), 2, '0') || 'c' || cast(event_id % 3 + 1 AS varchar) || '_ORG.tif' AS name,
 'c' || cast(event_id % 3 + 1 AS varchar) || '_ORG' AS token FROM events)""")
def q_manifest_parse(spark: SparkSession, sf: str) -> DataFrame:
    two = lambda c, n: F.lpad(c.cast("string"), n, "0")
    name = F.concat(F.lit("run_s"), two(F.col("event_id") % 500 + 1, 3), F.lit("t"), two(F.hour("ts"), 2), F.lit("c"), (F.col("event_id") % 3 + 1).cast("string"), F.lit("_ORG.tif"))
    names = table(spark, sf, "events").select("event_id", name.alias("name"))
    channels = spark.createDataFrame([(f"c{k}_ORG", f"c{k}_ORG") for k in (1, 2, 3)], "role string, token string")
    parsed = manifest.zeiss(names.withColumn("name", F.concat("name", F.lit("#"), F.col("event_id").cast("string"))), channels)
    return parsed.select(F.substring_index("name", "#", -1).cast("long").alias("event_id"), "block", "frame", "role")


@query(f"WITH {PX} SELECT label, vec_id, round(avg(i), 6) AS mean_i FROM px GROUP BY ALL")
def q_pixel_mean(spark, sf):
    # the frame stays an array: no explode, no shuffle
    total = F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v)
    return frames(spark, sf).select("label", "vec_id", F.round(total / F.size("px"), 6).alias("mean_i"))


@query(f"WITH {PX} SELECT label, round(avg(CASE WHEN i >= 1000 THEN 1.0 ELSE 0.0 END), 6) AS share FROM px GROUP BY label")
def q_mask_fraction(spark, sf):
    bright = F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + P.above(v, TH))
    rows = frames(spark, sf).select("label", bright.alias("n"), F.size("px").cast("long").alias("m"))
    return rows.groupBy("label").agg(F.round(F.sum("n") / F.sum("m"), 6).alias("share"))


_INV = P.inverse_mixing(*MIX)


def pair_frames(spark, sf):
    """Even vec_id is channel 1, the next one channel 2: vec_id, px, px2. Frames meet as arrays."""
    later = frames(spark, sf).where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("px").alias("px2"))
    return frames(spark, sf).where("vec_id % 2 = 0").select("vec_id", "px").join(later, "vec_id")


def channel_pairs(spark, sf):
    """The pixels of ``pair_frames``: vec_id, pos, x, y, i1, i2. Rows are made after the join."""
    rows = pair_frames(spark, sf).select("vec_id", F.posexplode(F.arrays_zip("px", "px2")).alias("pos", "i"))
    return rows.select("vec_id", "pos", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), F.col("i.px").alias("i1"), F.col("i.px2").alias("i2"))


PAIRS = f"{PX}, pr AS MATERIALIZED (SELECT a.vec_id, a.label, a.pos, a.x, a.y, a.i AS i1, b.i AS i2 FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND b.pos = a.pos WHERE a.vec_id % 2 = 0)"


@query(f"""WITH {PAIRS} SELECT vec_id, pos, cast(floor(greatest(0.0, i1 * {_INV[0]!r}::double + i2 * {_INV[1]!r}::double)) AS integer) AS o1,
cast(floor(greatest(0.0, i1 * {_INV[2]!r}::double + i2 * {_INV[3]!r}::double)) AS integer) AS o2 FROM pr""")
def q_unmix(spark, sf):
    """``stack.unmix_frames`` on pairs of frames as the two channels of a block."""
    made = unmixed(spark, sf)
    one, two = (made.where(F.col("channel") == c).select("block", F.col("px").alias(n)) for c, n in (("c0", "o1"), ("c1", "o2")))
    both = one.join(two, "block").select((F.col("block") * 2).cast("long").alias("vec_id"), F.posexplode(F.arrays_zip("o1", "o2")).alias("pos", "o"))
    return both.select("vec_id", "pos", "o.o1", "o.o2")


def unmixed(spark, sf):
    """Pairs of frames as the two channels of a block, unmixed."""
    rows = frames(spark, sf).select(
        F.floor(F.col("vec_id") / 2).cast("int").alias("block"), F.concat(F.lit("c"), (F.col("vec_id") % 2).cast("string")).alias("channel"), F.lit(0).alias("frame"),
        F.lit(8).alias("width"), F.lit(8).alias("height"), "px",
    )
    return stack.unmix_frames(rows, "c0", "c1", _INV)


@query(f"""WITH {PX}, {FRAME}, z AS (SELECT vec_id, label, pos, x, y, CASE WHEN (x = 0 AND label % 2 = 0) THEN 0 ELSE i END AS i FROM px),
f0 AS (SELECT z.* FROM z JOIN fr USING (vec_id, label) WHERE frame = 0),
fl AS (SELECT label, sum(CASE WHEN x = 0 THEN i ELSE 0 END) = 0 AS l, sum(CASE WHEN x = 7 THEN i ELSE 0 END) = 0 AS r, sum(CASE WHEN y = 0 THEN i ELSE 0 END) = 0 AS t, sum(CASE WHEN y = 7 THEN i ELSE 0 END) = 0 AS b FROM f0 GROUP BY label),
m AS (SELECT label, cast(floor(avg(i)) AS integer) AS m FROM z GROUP BY label)
SELECT vec_id, pos, CASE WHEN (x = 0 AND l) OR (x = 7 AND r) OR (y = 0 AND t) OR (y = 7 AND b) THEN m ELSE i END AS i FROM z JOIN fl USING (label) JOIN m USING (label)""")
def q_border_repair(spark, sf):
    """Frames of even labels get an empty first column, as a camera defect would make; the repair
    must find it in the first frame and fill it in all."""
    rows = frames(spark, sf).join(frame_index(spark, sf), ["vec_id", "label"])
    hurt = F.when(F.col("label") % 2 == 0, F.transform("px", lambda v, i: F.when(i % 8 == 0, F.lit(0)).otherwise(v))).otherwise(F.col("px"))
    named = rows.select(F.col("label").alias("block"), F.lit("c").alias("channel"), "frame", F.lit(8).alias("width"), F.lit(8).alias("height"), hurt.alias("px"))
    fixed = stack.repair_borders(named).select(F.col("block").alias("label"), "frame", "px")
    return fixed.join(frame_index(spark, sf), ["label", "frame"]).select("vec_id", F.posexplode("px").alias("pos", "i"))


@query(f"WITH {PX} SELECT vec_id, cast(63 - pos AS integer) AS pos, i FROM px")
def q_rotate180(spark, sf):
    return frames(spark, sf).select("vec_id", F.posexplode("px").alias("pos", "i")).select("vec_id", P.rotated_position(F.col("pos"), 64).alias("pos"), "i")


@query(f"WITH {PX} SELECT vec_id, (x + 3) % 8 AS x, (y + 6) % 8 AS y, i FROM px")
def q_circshift(spark, sf):
    return pixels(spark, sf).select("vec_id", P.shifted(F.col("x"), 3, 8).alias("x"), P.shifted(F.col("y"), -2, 8).alias("y"), "i")


@query("SELECT event_id, least(greatest(value, 50.0), 400.0) AS v FROM events")
def q_clamp(spark, sf):
    return table(spark, sf, "events").select("event_id", P.clamp(F.col("value"), 50.0, 400.0).alias("v"))


@query(f"WITH {PX} SELECT vec_id, pos, i * i AS i2, CASE WHEN i BETWEEN 900 AND 1100 THEN 255 ELSE 0 END AS band FROM px")
def q_square_and_band(spark, sf):
    return pixels(spark, sf).select("vec_id", "pos", (F.col("i") * F.col("i")).alias("i2"), F.when(F.col("i").between(900, 1100), 255).otherwise(0).alias("band"))


# -- histograms -----------------------------------------------------------
@query(f"WITH {PX} SELECT label, i // 50 AS bin, count(*) AS n FROM px GROUP BY ALL")
def q_histogram(spark, sf):
    return histogram.histogram(pixels(spark, sf), ["label"], F.floor(F.col("i") / 50).cast("int"))


@query("""SELECT cast(l_quantity AS integer) AS c1, cast(round(l_discount * 100) AS integer) AS c2, count(*) AS n FROM lineitem WHERE cast(l_quantity AS integer) < 45 AND round(l_discount * 100) < 45 GROUP BY ALL""")
def q_joint_hist(spark, sf):
    return histogram.joint_histogram(table(spark, sf, "lineitem"), F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"), 45)


HIST = f"{PX}, h AS (SELECT label, i // 25 AS bin, count(*) AS n FROM px GROUP BY ALL)"
CUM = """w AS (SELECT label, bin, sum(n) OVER o AS c, sum(n * bin) OVER o AS s, sum(n) OVER (PARTITION BY label) AS ca, sum(n * bin) OVER (PARTITION BY label) AS sa
 FROM h WINDOW o AS (PARTITION BY label ORDER BY bin ROWS UNBOUNDED PRECEDING))"""


def _hist25(spark, sf):
    return histogram.histogram(pixels(spark, sf), ["label"], F.floor(F.col("i") / 25).cast("int"))


@query(f"""WITH {HIST}, {CUM}, r AS (SELECT label, bin, c / ca AS p0, (ca - c) / ca AS p1, sa / ca AS mu, s / nullif(c, 0) AS m0, (sa - s) / nullif(ca - c, 0) AS m1 FROM w),
q AS (SELECT label, bin, CASE WHEN p0 > 0 AND p1 > 0 AND m0 > 0 AND m1 > 0 THEN round(mu - p0 * (ln(p0) + m0 * ln(m0)) - p1 * (ln(p1) + m1 * ln(m1)), 6) END AS cost FROM r)
SELECT label, bin AS th, cost FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cost NULLS LAST, CASE WHEN cost IS NULL THEN -bin ELSE bin END) AS k FROM q) WHERE k = 1""")
def q_min_error_threshold(spark, sf):
    return histogram.min_error_threshold(_hist25(spark, sf), ["label"])


@query(f"""WITH {HIST}, {CUM}, q AS (SELECT label, bin, round(coalesce(c / ca * ((ca - c) / ca) * pow(s / nullif(c, 0) - (sa - s) / nullif(ca - c, 0), 2), 0.0), 6) AS spread FROM w)
SELECT label, bin AS th, spread FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY spread DESC, bin) AS k FROM q) WHERE k = 1""")
def q_otsu(spark, sf):
    return histogram.otsu_threshold(_hist25(spark, sf), ["label"])


GATE = f"{PX}, g AS (SELECT vec_id, sum(CASE WHEN i >= 1000 THEN 1 ELSE 0 END) AS n1, count(*) AS n FROM px GROUP BY vec_id)"


@query(f"WITH {GATE} SELECT vec_id, round(greatest(n1, n - n1) / n, 6) AS share, greatest(n1, n - n1) / n < 0.6 OR greatest(n1, n - n1) = n AS bad FROM g")
def q_background_gate(spark, sf):
    return histogram.background_gate(pixels(spark, sf), ["vec_id"], on(), 0.6)


@query(f"WITH {GATE} SELECT vec_id, cast(least(n1, n - n1) AS bigint) AS n_on, cast(CASE WHEN n1 > n - n1 THEN n ELSE n1 END AS bigint) AS n_on_exact FROM g")
def q_foreground_choice(spark, sf):
    return histogram.foreground_choice(pixels(spark, sf), ["vec_id"], on())


# -- windows on pixels ----------------------------------------------------
def _sep_sql(f, r):
    return f"""b1 AS (SELECT *, {f}(i) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS a FROM px),
b2 AS (SELECT vec_id, pos, x, y, i, {f}(a) OVER (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS v FROM b1)"""


@query(f"WITH {PX}, {_sep_sql('sum', 1)} SELECT vec_id, pos, cast(v AS bigint) AS s FROM b2")
def q_box_sum(spark, sf):
    rows = _image_rows(spark, sf, lambda k, im: [(*k, K.box_sum(im, 3, 3)[1:-1, 1:-1].ravel())], "vec_id long, px array<double>")
    return rows.select("vec_id", F.posexplode("px").alias("pos", "v")).select("vec_id", "pos", F.col("v").cast("long").alias("s"))


@query(f"WITH {PX}, {_sep_sql('max', 2)} SELECT vec_id, pos, v AS m FROM b2")
def q_running_max(spark, sf):
    return _flat(_image_rows(spark, sf, lambda k, im: [(*k, K.sliding_max(im, 2).ravel())], "vec_id long, px array<double>"), "m", "vec_id")


@query(f"""WITH {PX} SELECT a.vec_id, a.x, a.y FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.pos <> b.pos
WHERE a.x BETWEEN 2 AND 5 AND a.y BETWEEN 2 AND 5 AND a.i > 0 GROUP BY a.vec_id, a.x, a.y, a.i HAVING max(b.i) < a.i""")
def q_local_max(spark, sf):
    return segment.each_frame(frames(spark, sf), ["vec_id"], lambda key, im: [(*key, x, y) for x, y in K.local_maxima(im, 1)], "vec_id long, x int, y int", 8)


# -- components (frames stay rows: no shuffle) -----------------------------
def _comp(near: str) -> str:
    return f"""{PX}, m AS (SELECT vec_id, label, pos, x, y FROM px WHERE i >= 1000),
e AS (SELECT a.vec_id, a.pos AS p, b.pos AS q FROM m a JOIN m b ON a.vec_id = b.vec_id AND {near}),
t AS (SELECT vec_id, p, q FROM e UNION SELECT t.vec_id, t.p, e.q FROM t JOIN e ON t.vec_id = e.vec_id AND t.q = e.p),
c AS (SELECT vec_id, p, min(q) AS comp FROM t GROUP BY vec_id, p), cs AS (SELECT vec_id, comp, count(*) AS size FROM c GROUP BY vec_id, comp)"""


EIGHT = _comp("abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1")
FOUR = _comp("abs(a.x - b.x) + abs(a.y - b.y) <= 1")


@query(f"WITH RECURSIVE {EIGHT} SELECT vec_id, comp, cast(size AS integer) AS size FROM cs")
def q_components(spark, sf):
    return segment.component_rows(frames(spark, sf), ["vec_id"], "vec_id long", TH, 8)


@query(f"WITH RECURSIVE {EIGHT} SELECT f.vec_id, cast(coalesce(sum(size) FILTER (size >= 5), 0) AS integer) AS n_px FROM (SELECT DISTINCT vec_id FROM px) f LEFT JOIN cs USING (vec_id) GROUP BY f.vec_id")
def q_remove_small(spark, sf):
    return segment.filtered_mask(frames(spark, sf), ["vec_id"], "vec_id long", TH, 8, least=5)


@query(f"WITH RECURSIVE {EIGHT} SELECT f.vec_id, cast(coalesce(sum(size) FILTER (size < 20), 0) AS integer) AS n_px FROM (SELECT DISTINCT vec_id FROM px) f LEFT JOIN cs USING (vec_id) GROUP BY f.vec_id")
def q_remove_large(spark, sf):
    return segment.filtered_mask(frames(spark, sf), ["vec_id"], "vec_id long", TH, 8, most=20)


@query(f"WITH RECURSIVE {FOUR} SELECT vec_id, comp, cast(size AS integer) AS size FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY size DESC, comp) AS k FROM cs) WHERE k = 1")
def q_largest_component(spark, sf):
    own = Window.partitionBy("vec_id").orderBy(F.col("size").desc(), "comp")
    rows = segment.component_rows(frames(spark, sf), ["vec_id"], "vec_id long", TH, 8, 4)
    return rows.withColumn("k", F.row_number().over(own)).where("k = 1").drop("k")


@query(f"WITH RECURSIVE {EIGHT} SELECT vec_id, comp, cast(size AS integer) AS size, cast(row_number() OVER (PARTITION BY vec_id ORDER BY size DESC, comp) AS integer) AS rank FROM cs")
def q_size_rank(spark, sf):
    own = Window.partitionBy("vec_id").orderBy(F.col("size").desc(), "comp")
    return segment.component_rows(frames(spark, sf), ["vec_id"], "vec_id long", TH, 8).withColumn("rank", F.row_number().over(own))


# -- projections over frames ----------------------------------------------
@query(f"WITH {PX} SELECT label, x, y, max(i) AS m FROM px GROUP BY label, x, y")
def q_max_projection(spark, sf):
    return pixels(spark, sf).groupBy("label", "x", "y").agg(F.max("i").alias("m"))


@query(f"""WITH {PX} SELECT vec_id // 4 AS grp, pos, max(i) AS m, cast(min(CASE WHEN i = mx THEN vec_id % 4 END) AS integer) AS channel
FROM (SELECT *, max(i) OVER (PARTITION BY vec_id // 4, pos) AS mx FROM px) GROUP BY ALL""")
def q_argmax_channel(spark, sf):
    group = F.floor(F.col("vec_id") / 4).alias("grp")
    best = F.max(F.struct(F.col("i"), (-(F.col("vec_id") % 4)).alias("k")))
    return pixels(spark, sf).groupBy(group, "pos").agg(best.alias("b")).select("grp", "pos", F.col("b.i").alias("m"), (-F.col("b.k")).cast("int").alias("channel"))


BOX = f"{PX}, bx AS (SELECT vec_id, label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px WHERE i >= 1100 GROUP BY vec_id, label)"


def _boxes(spark, sf):
    return features.bounding_boxes(pixels(spark, sf).where("i >= 1100"), ["vec_id", "label"])


@query(f"WITH {BOX} SELECT * FROM bx")
def q_bbox(spark, sf):
    return _boxes(spark, sf)


@query(f"""WITH {BOX} SELECT a.vec_id AS v1, b.vec_id AS v2, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1) AS n
FROM bx a JOIN bx b ON a.vec_id + 1 = b.vec_id""")
def q_box_overlap(spark, sf):
    a, b = _boxes(spark, sf).drop("label"), _boxes(spark, sf).drop("label")
    b = b.withColumn("vec_id", F.col("vec_id") - 1)
    return a.join(b, a["vec_id"] == b["vec_id"]).select(a["vec_id"].alias("v1"), (a["vec_id"] + 1).alias("v2"), features.box_overlap(a, b).alias("n"))


# -- features -------------------------------------------------------------
@query(f"""WITH {PX}, m AS (SELECT vec_id, count(*) AS area, avg(x) AS cx, avg(y) AS cy, var_pop(x) + 1.0/12 AS a, var_pop(y) + 1.0/12 AS b, covar_pop(x, y) AS c FROM px WHERE i >= 1000 GROUP BY vec_id)
SELECT vec_id, area, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt(greatest(0.0, a + b - sqrt((a - b) * (a - b) + 4 * c * c)) / (a + b + sqrt((a - b) * (a - b) + 4 * c * c))), 6) AS ratio FROM m""")
def q_region_props(spark, sf):
    return features.region_props(pixels(spark, sf).where(f"i >= {TH}"), ["vec_id"])


@query(f"WITH {PAIRS} SELECT vec_id, round(avg(i2), 6) AS mean, count(*) AS n FROM pr WHERE i1 >= 1000 GROUP BY vec_id")
def q_zonal_mean(spark, sf):
    """The mean of one channel under the mask of another; frames meet as arrays (AG16, JN4)."""
    total, n = features.masked(F.col("px"), F.col("px2"), lambda v: v >= TH)
    rows = pair_frames(spark, sf).select("vec_id", total.alias("total"), n.alias("n")).where("n > 0")
    return rows.select("vec_id", F.round(F.col("total") / F.col("n"), 6).alias("mean"), "n")


@query(f"""WITH {PAIRS}, ms AS (SELECT * FROM pr WHERE i1 >= 1150),
d AS (SELECT e.vec_id, e.pos, e.i2, min((e.x - m.x) * (e.x - m.x) + (e.y - m.y) * (e.y - m.y)) AS d2 FROM pr e JOIN ms m USING (vec_id) GROUP BY e.vec_id, e.pos, e.i2),
w AS (SELECT vec_id, pos, i2, CASE WHEN d2 = 0 THEN 0.0 ELSE (SELECT coalesce(sum(1.0 / (r * r)), 0.0) FROM range(1, 11) AS t(r) WHERE r * r >= d2) END AS w FROM d)
SELECT vec_id, round(sum(w * i2) / sum(i2), 6) AS assoc FROM w GROUP BY vec_id""")
def q_association(spark, sf):
    """Effector signal around a mask by the distance map of the frame (JN5, AG17)."""
    both = pair_frames(spark, sf).select("vec_id", F.concat("px", "px2").alias("px"))
    run = lambda k, im: [(*k, round(K.association(im[:8] >= 1150, im[8:]), 6))] if (im[:8] >= 1150).any() else []
    return segment.each_frame(both, ["vec_id"], run, "vec_id long, assoc double", 8)


@query(f"WITH {PX} SELECT vec_id, pos, round((i - avg(i) OVER w) / nullif(stddev_samp(i) OVER w, 0), 6) AS z FROM px WINDOW w AS (PARTITION BY vec_id)")
def q_zscore(spark, sf):
    rows = frames(spark, sf).select("vec_id", F.posexplode(stack.standardised("px")).alias("pos", "z"))
    return rows.withColumn("z", F.round("z", 6))


@query(f"WITH {PAIRS} SELECT vec_id, pos, greatest(i1, i2) AS m FROM pr")
def q_pixel_max(spark, sf):
    return channel_pairs(spark, sf).select("vec_id", "pos", F.greatest("i1", "i2").alias("m"))


@query("SELECT user_id, round(min(value), 6) AS least, CASE WHEN min(value) < 4 THEN 'near' ELSE 'far' END AS cls FROM events GROUP BY user_id")
def q_distance_class(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.min("value"), 6).alias("least")).withColumn("cls", F.when(F.col("least") < 4, "near").otherwise("far"))


@query("SELECT vec_id, cast((label * 7 + 3) % 10 AS integer) AS label2 FROM embeddings")
def q_relabel(spark, sf):
    lookup = spark.createDataFrame([(k, (k * 7 + 3) % 10) for k in range(10)], "label int, label2 int")
    return table(spark, sf, "embeddings").select("vec_id", "label").join(F.broadcast(lookup), "label").select("vec_id", "label2")


@query(f"WITH {PAIRS} SELECT vec_id, cast(count(*) AS bigint) AS n_shared FROM pr WHERE i1 >= 1000 AND i2 >= 1000 GROUP BY vec_id")
def q_shared_pixels(spark, sf):
    """Pixel-set intersection of two masks as arrays."""
    masks = frames(spark, sf).select("vec_id", F.expr(f"filter(sequence(0, 63), p -> px[p] >= {TH})").alias("on"))
    later = masks.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("on").alias("on2"))
    both = masks.where("vec_id % 2 = 0").join(later, "vec_id").select("vec_id", F.size(F.array_intersect("on", "on2")).cast("long").alias("n_shared"))
    return both.where("n_shared > 0")


# -- wells ----------------------------------------------------------------
@query(f"""WITH {TP}, s AS (SELECT user_id, f, CASE WHEN f = 1 THEN 0 ELSE cast(floor(x) AS integer) % 5 - 2 END AS dx, CASE WHEN f = 1 THEN 0 ELSE y % 5 - 2 END AS dy FROM tp)
SELECT user_id, f, cast(200 - sum(dx) OVER w AS bigint) AS cx, cast(200 - sum(dy) OVER w AS bigint) AS cy FROM s WINDOW w AS (PARTITION BY user_id ORDER BY f ROWS UNBOUNDED PRECEDING)""")
def q_drift_path(spark, sf):
    first = F.col("f") == 1
    s = tracks(spark, sf).select("user_id", "f", F.when(first, 0).otherwise(F.floor("x").cast("int") % 5 - 2).alias("dx"), F.when(first, 0).otherwise(F.col("y") % 5 - 2).alias("dy"))
    return wells.drift_path(s, ["user_id"], "f").select("user_id", "f", (200 - F.col("px")).alias("cx"), (200 - F.col("py")).alias("cy"))


@query("""WITH p AS (SELECT event_id AS id, value AS x, cast(regexp_extract(props, '[0-9]+') AS double) AS y, value * 0.37 - floor(value * 0.37) AS score FROM events),
g AS (SELECT *, cast(floor(y / 12.5) AS integer) AS row, cast(floor(x / 62.5) AS integer) AS col FROM p)
SELECT row, col, id FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY round(score, 9) DESC, y, x, id) AS k FROM g) WHERE k = 1""")
def q_grid_label(spark, sf):
    share = F.col("value") * 0.37
    p = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("value").alias("x"), F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("y"), (share - F.floor(share)).alias("score")
    )
    row, col = P.grid_cell(F.col("x"), F.col("y"), 500, 100, 8)
    return wells.best_per_cell(p.withColumns({"row": row, "col": col}), F.round("score", 9)).select("row", "col", "id")


WELLS = [(k, 60 + 120 * (k % 4), 25 + 50 * (k // 4)) for k in range(8)]
WINDOWS = "wl AS (SELECT k AS well, 60 + 120 * (k % 4) AS x0, 25 + 50 * (k // 4) AS y0 FROM range(8) AS t(k)), wf AS (SELECT cast(well AS integer) AS well, frame, cast(x0 + frame % 3 - 1 AS integer) AS cx, cast(y0 - frame % 2 AS integer) AS cy FROM wl, (SELECT DISTINCT frame FROM sd))"


def _windows(spark, sf):
    """Windows of eight wells that drift with the frame: well, frame, cx, cy."""
    spots = F.array(*(F.struct(F.lit(k).alias("well"), F.lit(x).alias("x0"), F.lit(y).alias("y0")) for k, x, y in WELLS))
    own = seeds(spark, sf).select("frame").distinct().select("frame", F.explode(spots).alias("w"))
    return own.select("w.well", "frame", (F.col("w.x0") + F.col("frame") % 3 - 1).alias("cx"), (F.col("w.y0") - F.col("frame") % 2).alias("cy"))


SEEDS = f"{SD}, {WINDOWS}, sc AS (SELECT wf.well, wf.frame, count(sd.event_id) AS n FROM wf LEFT JOIN sd ON sd.frame = wf.frame AND abs(sd.x - wf.cx) < 20 AND abs(sd.y - wf.cy) < 20 GROUP BY wf.well, wf.frame)"


def _seed_counts(spark, sf):
    windows = _windows(spark, sf)
    pairs = wells.seeds_in_windows(seeds(spark, sf), windows, ["frame"], 20, 32)
    return wells.seed_counts(pairs, windows, ["well", "frame"])


@query(f"WITH {SEEDS} SELECT well, frame, n FROM sc")
def q_seed_count(spark, sf):
    return _seed_counts(spark, sf)


def _mode_sql(source, key):
    return f"SELECT {key}, n AS k FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY times DESC, n) AS p FROM (SELECT {key}, n, count(*) AS times FROM {source} WHERE frame < 7 GROUP BY {key}, n)) WHERE p = 1 AND n > 0"


@query(f"WITH {SEEDS} {_mode_sql('sc', 'well')}")
def q_cell_mode(spark, sf):
    return wells.cell_number(_seed_counts(spark, sf), ["well"])


def _channel_counts(spark, sf, odd):
    """Seeds of one channel per user and day of the first week, with zeros."""
    own = seeds(spark, sf).where("frame < 7")
    spine = own.select("user_id").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return wells.seed_counts(own.where("event_id % 4 <> 0" if odd else "event_id % 4 = 0"), spine, ["user_id", "frame"])


def _channel_sql(name, test):
    return f"{name} AS (SELECT u.user_id, u.frame, count(s.event_id) AS n FROM sp u LEFT JOIN (SELECT * FROM sd WHERE {test}) s ON s.user_id = u.user_id AND s.frame = u.frame GROUP BY u.user_id, u.frame)"


COMPOSITION = f"""{SD}, sp AS (SELECT user_id, cast(f AS integer) AS frame FROM (SELECT DISTINCT user_id FROM sd WHERE frame < 7), unnest(range(7)) AS t(f)),
{_channel_sql('ce', 'event_id % 4 = 0')}, {_channel_sql('ct', 'event_id % 4 <> 0')}, ke AS ({_mode_sql('ce', 'user_id')}), kt AS ({_mode_sql('ct', 'user_id')}),
cp AS (SELECT user_id, effectors, targets, 'E' || effectors || 'T' || targets AS composition FROM (SELECT coalesce(ke.user_id, kt.user_id) AS user_id, coalesce(ke.k, 0) AS effectors, coalesce(kt.k, 0) AS targets FROM ke FULL JOIN kt ON ke.user_id = kt.user_id)
 WHERE effectors <= 1 AND targets <= 5)"""


def _compositions(spark, sf):
    e, t = (wells.cell_number(_channel_counts(spark, sf, odd), ["user_id"]) for odd in (False, True))
    return wells.composition(e, t, "user_id")


@query(f"WITH {COMPOSITION} SELECT user_id, effectors, targets, composition, CASE WHEN composition IN ('E1T1', 'E1T2', 'E1T3') THEN composition ELSE 'Exp' END AS routed FROM cp")
def q_composition(spark, sf):
    return _compositions(spark, sf)


# -- tracks ---------------------------------------------------------------
@query(f"""WITH {TP} SELECT user_id, f, CASE WHEN lead(x) OVER w IS NULL THEN 0.0 ELSE round(sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)), 6) END AS displacement FROM tp WINDOW w AS (PARTITION BY user_id ORDER BY f)""")
def q_displacement(spark, sf):
    return tracking.displacement(tracks(spark, sf), ["user_id"], "f").select("user_id", "f", "displacement")


CELLS = f"{SD}, cl AS (SELECT user_id, frame, row_number() OVER (PARTITION BY user_id, frame ORDER BY event_id) AS cell, x, y, 20 + event_id % 30 AS area FROM sd), nf AS (SELECT user_id, frame, lead(frame) OVER (PARTITION BY user_id ORDER BY frame) AS next_frame FROM (SELECT DISTINCT user_id, frame FROM cl))"
LINKS = f"""{CELLS}, lc AS (SELECT a.user_id, a.frame, nf.next_frame, a.cell, b.cell AS cell2, 10 * sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) + 100 * (greatest(a.area, b.area) - least(a.area, b.area)) / greatest(a.area, b.area) AS cost
 FROM cl a JOIN nf ON nf.user_id = a.user_id AND nf.frame = a.frame JOIN cl b ON b.user_id = a.user_id AND b.frame = nf.next_frame),
lw AS (SELECT *, exp(-6 * pow(cost / (max(cost) OVER (PARTITION BY user_id, frame) + 1e-15), 2)) AS weight FROM lc)"""


def _cells(spark, sf):
    """A user is a well; a seed is a cell with an invented area."""
    own = Window.partitionBy("user_id", "frame").orderBy("event_id")
    return seeds(spark, sf).select("user_id", "frame", F.row_number().over(own).alias("cell"), "x", "y", (20 + F.col("event_id") % 30).alias("area"))


def _links(spark, sf):
    return tracking.with_weight(tracking.with_cost(tracking.link_candidates(_cells(spark, sf), ["user_id"])), ["user_id"])


@query(f"WITH {CELLS} SELECT user_id, frame, coalesce(next_frame, -1) AS next_frame FROM nf")
def q_next_frame(spark, sf):
    found = tracking.next_frames(_cells(spark, sf), ["user_id"])
    return found.select("user_id", "frame", F.coalesce("next_frame", F.lit(-1)).alias("next_frame"))


@query(f"WITH {LINKS} SELECT user_id, frame, next_frame, cell, cell2 FROM lc")
def q_link_candidates(spark, sf):
    return tracking.link_candidates(_cells(spark, sf), ["user_id"]).select("user_id", "frame", "next_frame", "cell", "cell2")


@query(f"WITH {LINKS} SELECT user_id, frame, cell, cell2, round(cost, 6) AS cost FROM lc")
def q_link_cost(spark, sf):
    return tracking.with_cost(tracking.link_candidates(_cells(spark, sf), ["user_id"])).select("user_id", "frame", "cell", "cell2", F.round("cost", 6).alias("cost"))


@query(f"WITH {LINKS} SELECT user_id, frame, cell, cell2, round(weight, 6) AS weight FROM lw")
def q_link_weight(spark, sf):
    return _links(spark, sf).select("user_id", "frame", "cell", "cell2", F.round("weight", 6).alias("weight"))


# The best matching of a frame pair, whatever its size: the cells of the smaller side are placed in turn, and of the
# ways to have used the same cells of the other side only the best is kept.
MATCHED = f"""{LINKS}, pr AS (SELECT user_id, frame, max(cell) AS ca, max(cell2) AS cb FROM lw GROUP BY ALL),
ln AS (SELECT user_id, frame, least(ca, cb) AS n, CASE WHEN ca <= cb THEN cell ELSE cell2 END AS a, CASE WHEN ca <= cb THEN cell2 ELSE cell END AS b, weight FROM lw JOIN pr USING (user_id, frame)),
mt AS (SELECT user_id, frame, n, cast(0 AS bigint) AS k, cast(0 AS bigint) AS used, cast(0 AS double) AS w FROM (SELECT DISTINCT user_id, frame, n FROM ln) UNION ALL
 SELECT m.user_id, m.frame, m.n, m.k + 1, m.used | (cast(1 AS bigint) << cast(l.b AS integer)), max(m.w + l.weight)
 FROM mt m JOIN ln l ON l.user_id = m.user_id AND l.frame = m.frame AND l.a = m.k + 1 AND m.used & (cast(1 AS bigint) << cast(l.b AS integer)) = 0 GROUP BY ALL)"""


@query(f"WITH RECURSIVE {MATCHED} SELECT user_id, frame, cast(n AS bigint) AS n_links, round(max(w), 6) AS total FROM mt WHERE k = n GROUP BY user_id, frame, n")
def q_assignment(spark, sf):
    found = tracking.assignments(_links(spark, sf), ["user_id"])
    return found.groupBy("user_id", "frame").agg(F.count("*").alias("n_links"), F.round(F.sum("weight"), 6).alias("total"))


CHAIN = f"""{SD}, cl AS (SELECT user_id, frame, row_number() OVER (PARTITION BY user_id, frame ORDER BY event_id) AS cell FROM sd),
nf AS (SELECT user_id, frame, lead(frame) OVER (PARTITION BY user_id ORDER BY frame) AS next_frame FROM (SELECT DISTINCT user_id, frame FROM cl)),
lk AS (SELECT a.user_id, a.frame, a.cell, nf.next_frame, b.cell AS cell2 FROM cl a JOIN nf USING (user_id, frame) JOIN cl b ON b.user_id = a.user_id AND b.frame = nf.next_frame AND b.cell = a.cell)"""


def _rank_links(spark, sf):
    """Cells linked to the cell of the same rank in the next non-empty day."""
    own = Window.partitionBy("user_id", "frame").orderBy("event_id")
    cells = seeds(spark, sf).select("user_id", "frame", F.row_number().over(own).alias("cell"))
    later = cells.select("user_id", F.col("frame").alias("next_frame"), F.col("cell").alias("cell2"))
    step = tracking.next_frames(cells, ["user_id"]).where("next_frame is not null")
    links = cells.join(shuffled(step), ["user_id", "frame"]).join(shuffled(later), ["user_id", "next_frame"]).where("cell = cell2")
    return cells, links


@query(f"""WITH RECURSIVE {CHAIN}, ro AS (SELECT c.user_id, c.frame, c.cell FROM cl c WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.user_id = c.user_id AND lk.next_frame = c.frame AND lk.cell2 = c.cell)),
rn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frame, cell) AS track FROM ro),
tr AS (SELECT user_id, frame, cell, track FROM rn UNION ALL SELECT lk.user_id, lk.next_frame, lk.cell2, tr.track FROM tr JOIN lk ON lk.user_id = tr.user_id AND lk.frame = tr.frame AND lk.cell = tr.cell)
SELECT * FROM tr""")
def q_tracks(spark, sf):
    cells, links = _rank_links(spark, sf)
    return tracking.chains(cells, links, ["user_id"])


@query(f"WITH {CHAIN} SELECT c.user_id, c.frame, c.cell FROM cl c WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.user_id = c.user_id AND lk.frame = c.frame AND lk.cell = c.cell)")
def q_unlinked(spark, sf):
    cells, links = _rank_links(spark, sf)
    return tracking.unlinked(cells, links, ["user_id"])


@query(f"""WITH {TP}, s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step, f - lag(f) OVER w AS dt FROM tp WINDOW w AS (PARTITION BY user_id ORDER BY f))
SELECT user_id, count(*) AS n, round(sum(step / dt) / (count(*) - 1), 6) AS avg_speed, round(sum(step), 6) AS path, round(sqrt(pow(arg_max(x, f) - arg_min(x, f), 2) + pow(arg_max(y, f) - arg_min(y, f), 2)), 6) AS net,
round(round(sum(step), 12) / nullif(sqrt(pow(arg_max(x, f) - arg_min(x, f), 2) + pow(arg_max(y, f) - arg_min(y, f), 2)), 0), 6) AS confinement FROM s GROUP BY user_id HAVING count(*) > 1""")
def q_motion_summary(spark, sf):
    return tracking.motion_summary(tracks(spark, sf), ["user_id"], "f")


# -- tables ---------------------------------------------------------------
@query("SELECT 'lineitem' AS block, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem UNION ALL SELECT 'orders', count(*), round(sum(o_totalprice), 2) FROM orders UNION ALL SELECT 'events', count(*), round(sum(value), 2) FROM events")
def q_experiment_union(spark, sf):
    part = lambda name, c: table(spark, sf, name).agg(F.lit(name).alias("block"), F.count("*").alias("n"), F.round(F.sum(F.col(c).cast("decimal(18,2)")), 2).cast("double").alias("total"))
    return tables.union_all([part("lineitem", "l_quantity"), part("orders", "o_totalprice"), part("events", "value")])


def _every_sql(source, keys):
    """The value of each frame up to the largest, MISSING where there is none."""
    on_ = " AND ".join(f"t.{k} = a.{k}" for k in [*keys, "frame"])
    names = ", ".join(f"a.{k}" for k in keys)
    return f"""SELECT {names}, a.frame, coalesce(t.m, -1000.0) AS m FROM (SELECT DISTINCT {", ".join(keys)}, cast(f AS integer) AS frame FROM {source}, unnest(range((SELECT max(frame) + 1 FROM {source}))) AS r(f)) a
LEFT JOIN {source} t ON {on_}"""


@query(f"WITH {PX}, {FRAME}, lm AS (SELECT label, frame, round(avg(i), 6) AS m FROM px JOIN fr USING (vec_id, label) GROUP BY label, frame) {_every_sql('lm', ['label'])}")
def q_frame_table(spark, sf):
    """What the wide table f1..fN holds, one frame per row: their number grows with the data."""
    means = q_pixel_mean(spark, sf).join(frame_index(spark, sf), ["vec_id", "label"]).withColumnRenamed("mean_i", "m")
    return tables.every_frame(means, ["label"], "m")


NAMES = ["x", "y", "ratio", "displacement", "death", "assoc"]
BLOCK = """ft AS (SELECT user_id, event_id % 3 AS part, CASE event_id % 3 WHEN 1 THEN event_id // 3 % 5 WHEN 2 THEN event_id // 3 % 2 ELSE 0 END AS target, event_id // 15 % 6 AS name, hour(ts) AS f, value FROM events),
lv AS (SELECT user_id, CASE part WHEN 0 THEN CASE WHEN name = 5 THEN 0 ELSE name END WHEN 1 THEN 6 + 8 * target + CASE WHEN name = 5 THEN 6 ELSE name END ELSE 46 + target END AS line, f, round(avg(value), 6) AS v
 FROM ft GROUP BY ALL)"""
HOURS = ", ".join(
    f"CASE WHEN s.line = 48 THEN {k + 1}.0 WHEN s.line = 5 THEN -1.0 WHEN s.line BETWEEN 6 AND 45 AND (s.line - 6) % 8 = 5 THEN -1.0 WHEN s.line BETWEEN 6 AND 45 AND (s.line - 6) % 8 = 7 THEN -2.0"
    f" ELSE coalesce(max(CASE WHEN f = {k} THEN v END), -1000.0) END AS f{k + 1}" for k in range(24)
)


@query(f"WITH {BLOCK} SELECT s.user_id, cast(s.line AS integer) AS line, {HOURS} FROM (SELECT DISTINCT user_id, line FROM events, unnest(range(49)) AS t(line)) s LEFT JOIN lv ON lv.user_id = s.user_id AND lv.line = s.line GROUP BY s.user_id, s.line")
def q_well_block(spark, sf):
    """The 49-row block of every well: a user is a well, the hours of the day are its 24 frames."""
    third, part = F.floor(F.col("event_id") / 3), F.col("event_id") % 3
    name = F.floor(F.col("event_id") / 15) % 6
    rows = table(spark, sf, "events").select(
        "user_id", F.element_at(F.array(*map(F.lit, ("effector", "target", "bead"))), (part + 1).cast("int")).alias("part"),
        F.when(part == 1, third % 5).when(part == 2, third % 2).otherwise(0).cast("int").alias("target"),
        F.element_at(F.array(*map(F.lit, NAMES)), (F.when((part == 0) & (name == 5), 0).otherwise(name) + 1).cast("int")).alias("name"), F.hour("ts").alias("frame"), "value",
    )
    rows = rows.withColumn("name", F.when(F.col("part") == "bead", "x").otherwise(F.col("name")))
    means = rows.groupBy("user_id", "part", "target", "name", "frame").agg(F.round(F.avg("value"), 6).alias("value"))
    return tables.well_block(means, ["user_id"], list(range(24)))


# -- more projections, costs and tables ------------------------------------
@query("""SELECT event_id, substr(p, length(p) - 6, 3) || CASE WHEN p LIKE '%/bin_%' THEN 'bin' WHEN p LIKE '%/bg_%' THEN 'bg' ELSE '' END AS channel
FROM (SELECT event_id, '/run/' || CASE event_id % 3 WHEN 0 THEN 'bin_' WHEN 1 THEN 'bg_' ELSE '' END || 'B001CH' || cast(event_id % 6 AS varchar) || '.tif' AS p FROM events)""")
def q_channel_name(spark, sf):
    kind = F.when(F.col("event_id") % 3 == 0, "bin_").when(F.col("event_id") % 3 == 1, "bg_").otherwise("")
    path = F.concat(F.lit("/run/"), kind, F.lit("B001CH"), (F.col("event_id") % 6).cast("string"), F.lit(".tif"))
    return table(spark, sf, "events").select("event_id", P.channel_name(path).alias("channel"))


@query("""SELECT name, cast(substr(name, 2) AS integer) AS block, cast(row_number() OVER (ORDER BY name) AS integer) AS ordinal
FROM (SELECT DISTINCT CASE WHEN user_id % 4 = 0 THEN 'notes' ELSE 'B' || lpad(cast(user_id AS varchar), 3, '0') END AS name FROM events) WHERE name <> 'notes'""")
def q_block_folders(spark, sf):
    name = F.when(F.col("user_id") % 4 == 0, "notes").otherwise(F.concat(F.lit("B"), F.lpad(F.col("user_id").cast("string"), 3, "0")))
    return manifest.block_folders(table(spark, sf, "events").select(name.alias("name")).distinct())


@query(f"WITH {PX} SELECT vec_id, cast((y + 1) * 11 + x + 1 AS integer) AS pos, i FROM px WHERE i > 0")
def q_pad(spark, sf):
    rows = frames(spark, sf).select("vec_id", F.posexplode(P.padded(F.col("px"), 8, 8, 1, 2)).alias("pos", "i"))
    return rows.where("i > 0")


@query(f"WITH {PX} SELECT vec_id, max(i) AS top, round(var_samp(i), 6) AS variance, cast(count(DISTINCT i) AS bigint) AS levels FROM px GROUP BY vec_id")
def q_frame_statistics(spark, sf):
    mean = F.aggregate("px", F.lit(0.0), lambda a, v: a + v) / F.size("px")
    spread = F.aggregate("px", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))) / (F.size("px") - 1)
    rows = frames(spark, sf).withColumn("mean", mean)
    return rows.select("vec_id", F.array_max("px").alias("top"), F.round(spread, 6).alias("variance"), F.size(F.array_distinct("px")).cast("long").alias("levels"))


@query(f"WITH {PX}, {FRAME} SELECT vec_id, frame, round(avg(i), 6) AS mean_i FROM px JOIN fr USING (vec_id, label) WHERE frame < 3 GROUP BY ALL")
def q_first_frames(spark, sf):
    """The first pages of each stack: the filter stands before pixels are read into a sum."""
    return q_pixel_mean(spark, sf).join(frame_index(spark, sf).where("frame < 3"), ["vec_id", "label"]).select("vec_id", "frame", "mean_i")


@query(f"""WITH {BOX}, c AS (SELECT vec_id, avg(x) AS cx, avg(y) AS cy, avg(i) AS m, cast(count(*) AS double) AS n FROM px WHERE i >= 1100 GROUP BY vec_id),
j AS (SELECT a.vec_id AS v1, b.vec_id AS v2, sqrt(pow(0.357 * (a.cx - b.cx), 2) + pow(0.357 * (a.cy - b.cy), 2)) AS d, a.m - b.m AS gm, a.n - b.n AS gn,
 greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0)) / (0.5 * ((p.x1 - p.x0 + 1) * (p.y1 - p.y0 + 1) + (q.x1 - q.x0 + 1) * (q.y1 - q.y0 + 1))) AS o
 FROM c a JOIN c b ON a.vec_id + 1 = b.vec_id JOIN bx p ON p.vec_id = a.vec_id JOIN bx q ON q.vec_id = b.vec_id)
SELECT v1, v2, round(CASE WHEN d > 12 THEN 1e10 ELSE (1 - o) * (1 - exp(-(d * d / 200.0 + gm * gm / 200.0 + gn * gn / 200000.0))) END, 6) AS cost FROM j""")
def q_gated_cost(spark, sf):
    px = pixels(spark, sf).where("i >= 1100")
    own = px.groupBy("vec_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("i").alias("mean"), F.count("*").cast("double").alias("n"), *(f(c).alias(c + k) for c in "xy" for f, k in ((F.min, "0"), (F.max, "1"))))
    later = own.select((F.col("vec_id") - 1).alias("vec_id"), *(F.col(c).alias(f"{c}_2") for c in own.columns[1:]))
    return own.join(later, "vec_id").select(F.col("vec_id").alias("v1"), (F.col("vec_id") + 1).alias("v2"), F.round(tracking.gated_cost("xy"), 6).alias("cost"))


@query(f"WITH {TP} SELECT user_id, f, round(x - coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY f), 0.0), 6) AS change FROM tp")
def q_distance_change(spark, sf):
    return tracking.distance_change(tracks(spark, sf), ["user_id"], "f", "x").select("user_id", "f", F.round("change", 6).alias("change"))


@query(f"""WITH {PX}, a AS (SELECT vec_id, pos, x, y FROM px WHERE i >= 1200), n AS (SELECT vec_id, count(*) AS n FROM a GROUP BY vec_id),
o AS (SELECT p.vec_id, count(*) AS o FROM a p JOIN a q ON q.vec_id = p.vec_id + 1 AND q.pos = p.pos GROUP BY p.vec_id),
d AS (SELECT p.vec_id, min(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) AS d FROM a p JOIN a q ON q.vec_id = p.vec_id + 1 GROUP BY p.vec_id)
SELECT d.vec_id, coalesce(o, 0) AS overlap, round(CASE WHEN o > 0 THEN 1 - o / least(n1.n, n2.n) ELSE d END, 6) AS term FROM d LEFT JOIN o USING (vec_id) JOIN n n1 ON n1.vec_id = d.vec_id JOIN n n2 ON n2.vec_id = d.vec_id + 1""")
def q_overlap_term(spark, sf):
    """The bright pixels of a frame are its one cell: pixel sets as arrays, compared once per pair of frames (JN7, JN8)."""
    points = F.expr("transform(filter(sequence(0, 63), p -> px[p] >= 1200), p -> struct(cast(p % 8 AS int) AS x, cast(p div 8 AS int) AS y))")
    own = frames(spark, sf).select(F.col("vec_id").alias("frame"), F.lit(1).alias("cell"), points.alias("pts")).where("size(pts) > 0")
    area = own.select("frame", F.size("pts").alias("n"))
    steps = area.select("frame", (F.col("frame") + 1).alias("next_frame"), "n").join(area.select(F.col("frame").alias("next_frame"), F.col("n").alias("n2")), "next_frame")
    pairs = stack.pair_overlaps(own, steps, []).join(steps, ["frame", "next_frame"])
    part = F.when(F.col("overlap") > 0, 1 - F.col("overlap") / F.least("n", "n2")).otherwise(F.col("away"))
    return pairs.select(F.col("frame").alias("vec_id"), "overlap", F.round(part, 6).alias("term"))


@query(f"WITH {COMPOSITION} SELECT composition AS route, count(*) AS n FROM cp WHERE composition IN ('E1T1', 'E1T2', 'E1T3') GROUP BY ALL UNION ALL SELECT 'Exp', count(*) FROM cp")
def q_routes(spark, sf):
    """Rows of the subset tables and of the experiment table, which holds all kept wells."""
    return _route_counts(_compositions(spark, sf))


def _route_counts(kept):
    routes = F.explode(F.array_distinct(F.array(F.col("routed"), F.lit("Exp"))))
    return kept.select(routes.alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query(f"""WITH {PX}, {FRAME}, lm AS (SELECT label, frame, avg(i) AS raw, avg(CASE WHEN i >= 1000 THEN 1.0 ELSE 0.0 END) AS mask FROM px JOIN fr USING (vec_id, label) GROUP BY label, frame),
l2 AS (SELECT label, 'raw' AS kind, frame, round(raw, 6) AS m FROM lm UNION ALL SELECT label, 'mask', frame, round(mask, 6) FROM lm) {_every_sql('l2', ['label', 'kind'])}""")
def q_pixel_table(spark, sf):
    """Raw and mask means of every well and frame, one frame per row."""
    return tables.every_frame(_pixel_means(spark, sf), ["label", "kind"], "m")


def _pixel_means(spark, sf):
    mask = F.aggregate(F.transform("px", lambda v: F.when(v >= TH, 1.0).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v) / F.size("px")
    raw = F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v) / F.size("px")
    kinds = F.explode(F.map_from_arrays(F.array(F.lit("raw"), F.lit("mask")), F.array(F.round(raw, 6), F.round(mask, 6)))).alias("kind", "m")
    return frames(spark, sf).select("vec_id", "label", kinds).join(frame_index(spark, sf), ["vec_id", "label"])


def _image_rows(spark, sf, kernel, schema):
    return segment.each_frame(frames(spark, sf), ["vec_id"], kernel, schema, 8)


# -- stacks as volumes ----------------------------------------------------
def _stack(spark, sf):
    return frames(spark, sf).join(frame_index(spark, sf), ["vec_id", "label"])


def _flat(rows, name, *keys):
    return rows.select(*keys, F.posexplode("px").alias("pos", "v")).select(*keys, "pos", F.col("v").cast("int").alias(name))


@query(f"""WITH {PX}, {FRAME}, v AS (SELECT px.*, frame FROM px JOIN fr USING (vec_id, label)), top AS (SELECT label, max(frame) AS top FROM fr GROUP BY label),
o AS (SELECT a.unnest - 1 AS dz, b.unnest - 1 AS dy, c.unnest - 1 AS dx FROM unnest(range(3)) a, unnest(range(3)) b, unnest(range(3)) c),
n AS (SELECT v.vec_id, v.pos, v.label, least(greatest(frame + dz, 0), top) AS f, least(greatest(x + dx, 0), 7) + 8 * least(greatest(y + dy, 0), 7) AS p FROM v JOIN top USING (label), o)
SELECT n.vec_id, n.pos, cast(median(w.i) AS integer) AS m FROM n JOIN v w ON w.label = n.label AND w.frame = n.f AND w.pos = n.p GROUP BY n.vec_id, n.pos""")
def q_median_filter(spark, sf):
    return _flat(volume.stack_filter(_stack(spark, sf), ["vec_id"], "vec_id long", ["label"], "frame", 8, 8, 1, volume.median_filter), "m", "vec_id")


def _ball_sql(f, r):
    near = f"abs(b.x - a.x) <= {r} AND abs(b.y - a.y) <= {r} AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= {r * r}"
    return f"SELECT a.vec_id, a.pos, a.x, a.y, {f}(b.i) AS m FROM {{0}} a JOIN {{0}} b ON a.vec_id = b.vec_id AND {near} GROUP BY a.vec_id, a.pos, a.x, a.y"


@query(f"WITH {PX} SELECT vec_id, pos, m FROM ({_ball_sql('max', 2).format('px')})")
def q_dilated(spark, sf):
    return _flat(_image_rows(spark, sf, lambda k, im: [(*k, volume.dilated(im[None], 2).ravel())], "vec_id long, px array<double>"), "m", "vec_id")


@query(f"WITH {PX} SELECT vec_id, pos, m FROM ({_ball_sql('min', 2).format('px')})")
def q_eroded(spark, sf):
    return _flat(_image_rows(spark, sf, lambda k, im: [(*k, volume.eroded(im[None], 2).ravel())], "vec_id long, px array<double>"), "m", "vec_id")


def _cross_sql(f, source):
    """The least or greatest of each pixel and its four neighbours, by windows."""
    near = ", ".join(f"{g}(i) OVER {w}" for w in "rc" for g in ("lag", "lead"))
    return f"SELECT vec_id, pos, x, y, {f}(i, {near}) AS i FROM {source} WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)"


@query(f"""WITH {PX}, z AS (SELECT vec_id, pos, x, y, CASE WHEN i < 950 THEN 0 ELSE i END AS i FROM px), d AS ({_cross_sql('greatest', 'z')}), c AS ({_cross_sql('least', 'd')})
SELECT vec_id, pos, CASE WHEN z.i = 0 THEN c.i ELSE z.i END AS m FROM z JOIN c USING (vec_id, pos)""")
def q_fill_holes(spark, sf):
    fill = lambda k, im: [(*k, volume.holes_filled(np.where(im < 950, 0, im), 1).ravel())]
    return _flat(_image_rows(spark, sf, fill, "vec_id long, px array<double>"), "m", "vec_id")


@query(f"""WITH {PX}, m AS (SELECT * FROM px WHERE i >= 1000) SELECT DISTINCT a.vec_id, a.pos FROM m a JOIN px b ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 WHERE b.i < 1000""")
def q_outline(spark, sf):
    return _image_rows(spark, sf, lambda k, im: [(*k, p) for p in np.flatnonzero(volume.outline(im >= TH)).tolist()], "vec_id long, pos int")


@query(f"WITH {PX}, {FRAME} SELECT label, x, y, arg_min(i, frame) AS i FROM px JOIN fr USING (vec_id, label) WHERE i >= 1000 GROUP BY label, x, y")
def q_first_along(spark, sf):
    px = pixels(spark, sf).join(frame_index(spark, sf), ["vec_id", "label"]).withColumn("i", F.when(F.col("i") >= TH, F.col("i")).otherwise(0))
    return volume.first_along(px, ["label", "x", "y"], "frame", "i", "i")


@query(f"WITH {PX} SELECT vec_id // 4 AS grp, cast(x + vec_id % 2 * 8 AS integer) AS x, cast(y + vec_id % 4 // 2 * 8 AS integer) AS y, i FROM px")
def q_collage(spark, sf):
    x, y = volume.collage(F.col("x"), F.col("y"), F.col("vec_id") % 4, 8, 8)
    return pixels(spark, sf).select(F.floor(F.col("vec_id") / 4).alias("grp"), x.cast("int").alias("x"), y.cast("int").alias("y"), "i")


@query(f"WITH {PAIRS} SELECT vec_id, pos, CASE WHEN i1 >= 1000 THEN 'red' WHEN i2 >= 1000 THEN 'green' END AS colour, CASE WHEN i1 >= i2 THEN i1 ELSE 0 END AS w1, CASE WHEN i2 > i1 THEN i2 ELSE 0 END AS w2 FROM pr")
def q_composite(spark, sf):
    shown = [F.when(F.col(c) >= TH, F.col(c)).otherwise(0) for c in ("i1", "i2")]
    w1, w2 = volume.winner([F.col("i1"), F.col("i2")])
    return channel_pairs(spark, sf).select("vec_id", "pos", volume.composite(shown, ["red", "green"]).alias("colour"), w1.alias("w1"), w2.alias("w2"))


@query(f"WITH {PX} SELECT vec_id, x - 2 AS x, y - 3 AS y, i FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 3 AND 6 AND label = 1")
def q_box_crop(spark, sf):
    return volume.boxed(pixels(spark, sf), {"x": 2, "y": 3}, {"x": 5, "y": 6}, 1).select("vec_id", "x", "y", "i")


@query(f"""WITH {PX}, c AS (SELECT vec_id, x, y, i, cast(CASE WHEN pos // 16 = 3 THEN 1 ELSE pos // 16 END AS integer) AS label FROM px)
SELECT vec_id, label, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(i), 6) AS mean FROM c GROUP BY vec_id, label""")
def q_merged_cells(spark, sf):
    """Each quarter of a frame is a cell; the last is merged into the second."""
    px = pixels(spark, sf).withColumn("label", F.floor(F.col("pos") / 16).cast("int"))
    pairs = px.select("vec_id").distinct().select("vec_id", F.lit(3).alias("label"), F.lit(1).alias("into"))
    rows = volume.merged(px, ["vec_id"], pairs)
    return rows.select("vec_id", "label", "area", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "mean")))


@query(f"""WITH {PAIRS}, c AS (SELECT vec_id, avg(x) AS cx, avg(y) AS cy, count(*) AS area FROM pr WHERE i1 >= 1150 GROUP BY vec_id),
d AS (SELECT vec_id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d, area FROM pr JOIN c USING (vec_id) WHERE i2 >= 1000),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM d)
SELECT vec_id, round(avg(d), 6) AS near, avg(d) / sqrt(any_value(area) / pi()) <= 1.7 AS touches FROM r WHERE k <= greatest(1, cast(floor(n * 0.05) AS integer)) GROUP BY vec_id""")
def q_contact(spark, sf):
    """Both masks of a pair travel in one row; the distances never leave it."""
    later = frames(spark, sf).where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("px").alias("px2"))
    both = frames(spark, sf).where("vec_id % 2 = 0").join(later, "vec_id").select("vec_id", F.concat("px", "px2").alias("px"))

    def run(k, im):
        cell = np.argwhere(im[:8] >= 1150)
        near = volume.nearest_share(im[8:] >= TH, tuple(cell.mean(axis=0))) if len(cell) else None
        return [] if near is None else [(*k, near, len(cell))]

    found = segment.each_frame(both, ["vec_id"], run, "vec_id long, near double, area int", 8)
    return found.select("vec_id", F.round("near", 6).alias("near"), volume.contact(F.col("near"), F.col("area")).alias("touches"))


@query(f"WITH {PX}, c AS (SELECT vec_id, cast(floor(avg(x)) + 8 * floor(avg(y)) AS integer) AS pos FROM px WHERE i >= 1150 GROUP BY vec_id) SELECT vec_id, i AS at_centre FROM c JOIN px USING (vec_id, pos)")
def q_sampled(spark, sf):
    spots = F.expr("filter(sequence(0, 63), p -> px[p] >= 1150)")
    mean = lambda part: F.aggregate("spots", F.lit(0.0), lambda a, p: a + part(p)) / F.size("spots")
    rows = frames(spark, sf).select("vec_id", "px", spots.alias("spots")).where("size(spots) > 0")
    x, y = mean(lambda p: p % 8), mean(lambda p: F.floor(p / 8))
    return rows.select("vec_id", volume.sampled(F.col("px"), x, y, 8).alias("at_centre"))


@query(f"""WITH RECURSIVE {PX}, m AS (SELECT vec_id, pos, x, y FROM px WHERE i >= 1000),
w AS (SELECT vec_id, pos, x, y, 0 AS step FROM m WHERE pos = 27 UNION SELECT m.vec_id, m.pos, m.x, m.y, w.step + 1 FROM w JOIN m ON m.vec_id = w.vec_id AND abs(m.x - w.x) <= 1 AND abs(m.y - w.y) <= 1 WHERE w.step < 3)
SELECT DISTINCT vec_id, pos FROM w""")
def q_within_steps(spark, sf):
    return _image_rows(spark, sf, lambda k, im: [(*k, p) for p in np.flatnonzero(volume.within_steps(im >= TH, (3, 3), 3)).tolist()], "vec_id long, pos int")


# -- kernels; the SQL of some is built in ``shapes``, the others' rows are held against plain versions in the tests --
@query()
def k_gaussian_bg(spark, sf):
    return _image_rows(spark, sf, lambda k, im: [(*k, int(K.subtract_background(im, 2.0).sum()))], "vec_id long, total long")


@query()
def k_log_seed(spark, sf):
    def run(k, im):
        response = K.seed_response(im, im >= TH, 2, 3)
        return [(*k, float(response.max()), len(K.local_maxima(response, 1)))]

    return _image_rows(spark, sf, run, "vec_id long, peak double, n_seeds int").withColumn("peak", F.round("peak", 6))


@query()
def k_segment(spark, sf):
    s = segment.Settings(least=2, most=40, window=1, least_radius=2, most_radius=3)
    return segment.segment_frames(frames(spark, sf).withColumn("width", F.lit(8)), ["vec_id"], "vec_id long", s)


@query()
def k_ncc(spark, sf):
    pattern = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]], dtype=float)
    rows = _image_rows(spark, sf, lambda k, im: [(*k, x, y, t, s) for x, y, t, s in segment.find_wells(im, [pattern, -pattern], 3, 1)], "vec_id long, x int, y int, type int, score double")
    return rows.withColumn("score", F.round("score", 6))


@query()
def k_drift(spark, sf):
    """Shift of each frame against the one before it in its well."""
    own = Window.partitionBy("label").orderBy("vec_id")
    order = frames(spark, sf).select("vec_id", F.lag("vec_id").over(own).alias("last")).where("last is not null")
    before = frames(spark, sf).select(F.col("vec_id").alias("last"), F.col("px").alias("before"))
    pairs = frames(spark, sf).join(order, "vec_id").join(before, "last").select("vec_id", F.concat("before", "px").alias("px"))
    return segment.each_frame(pairs, ["vec_id"], lambda k, im: [(*k, *K.drift(im[:8], im[8:]))], "vec_id long, dx int, dy int", 8)


@query()
def k_crop(spark, sf):
    def run(k, im):
        own = K.crop(im, 3 + k[0] % 3, 4, 5)
        return [(*k, int(own.sum()), int((own > 0).sum()))] if own.any() else []

    return _image_rows(spark, sf, run, "vec_id long, total long, n_px int")


@query()
def k_split_in_two(spark, sf):
    return _image_rows(spark, sf, lambda k, im: [(*k, c, n) for c, n in K.sizes(volume.split_in_two(im >= TH)).items()], "vec_id long, cell int, size int")


@query()
def k_spectral(spark, sf):
    def run(k, im):
        label = K.clean_labels(K.spectral_split(im >= TH, 2, 10))
        return [(*k, c, n) for c, n in K.sizes(label).items()]

    return _image_rows(spark, sf, run, "vec_id long, cell int, size int")


from lapsegrid.plans import round_trips, shapes, stacks  # noqa: E402, F401 - they register their queries here
