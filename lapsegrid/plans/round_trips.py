"""Queries of the sources and sinks: what is written is read back and compared with the table it came from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lapsegrid.operators import histogram, stack, tables, volume, wells
from lapsegrid.plans.catalogue import _stack, query
from lapsegrid.sources import manifest, nrrd, tiff
from lapsegrid.sources.scratch import fresh_dir
from lapsegrid.sources.views import FRAME, PX, SD, TP, pixels, seeds, table, tracks

CHANNELS = "role string, token string"


@query("""SELECT event_id, cast(event_id % 100 + 1 AS integer) AS block, cast(hour(ts) AS integer) AS frame, CASE event_id % 2 WHEN 0 THEN 'FITC' ELSE 'CY5' END AS role FROM events""")
def q_manifest_leica(spark, sf):
    """Names of the second system, built from events and parsed back (SRC3, SRC5, SRC6)."""
    role = F.when(F.col("event_id") % 2 == 0, "FITC").otherwise("CY5")
    block = manifest.padded_block(F.col("event_id") % 100 + 1, 3)
    name = F.concat(F.lit("run"), manifest.padded_block(F.hour("ts"), 3), F.lit("_w2"), role, F.lit("_t"), block, F.lit(".TIF"))
    names = table(spark, sf, "events").select("event_id", name.alias("name"))
    return manifest.leica(names, spark.createDataFrame([("FITC", "FITC"), ("CY5", "CY5")], CHANNELS)).select("event_id", "block", "frame", "role")


def _manifest(spark, sf):
    """Files of the first system: one per event, so that times repeat within a block and channel."""
    number = F.lpad(F.col("event_id").cast("string"), 7, "0")
    name = F.concat(F.lit("run"), number, F.lit("_s"), manifest.padded_block(F.col("user_id") % 50 + 1, 3), F.lit("t"), F.lpad(F.hour("ts").cast("string"), 2, "0"), F.lit("c"), (F.col("event_id") % 2 + 1).cast("string"), F.lit("_ORG.tif"))
    return manifest.zeiss(table(spark, sf, "events").select(name.alias("name")), spark.createDataFrame([("a", "c1_ORG"), ("b", "c2_ORG")], CHANNELS))


FILES = """fl AS (SELECT cast(user_id % 50 + 1 AS integer) AS block, CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS role, cast(hour(ts) AS integer) AS frame,
 'run' || lpad(cast(event_id AS varchar), 7, '0') || '_s' || lpad(cast(user_id % 50 + 1 AS varchar), 3, '0') || 't' || lpad(cast(hour(ts) AS varchar), 2, '0') || 'c' || cast(event_id % 2 + 1 AS varchar) || '_ORG.tif' AS name FROM events)"""


@query(f"WITH {FILES} SELECT *, cast(row_number() OVER (PARTITION BY block, role ORDER BY frame, name) AS integer) AS place FROM fl")
def q_file_order(spark, sf):
    """Files of each block and channel by time, then name (SO1)."""
    return manifest.in_order(_manifest(spark, sf))


@query(f"WITH {FILES} SELECT * FROM fl")
def q_manifest_files(spark, sf):
    """A folder of file names per block and channel, written and read back (SNK3)."""
    path = fresh_dir(spark, "manifest")
    manifest.write_manifest(_manifest(spark, sf), path)
    found = spark.read.schema("frame int, name string, block int, role string").csv(path, sep="\t")
    return found.select("block", "role", "frame", "name")


@query("SELECT u.user_id, s.source, count(e.event_id) AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['click', 'view', 'never']) AS source) s LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = s.source GROUP BY ALL")
def q_optional_source(spark, sf):
    """Every well has a row for every source, also for those that it lacks (SRC12)."""
    events = table(spark, sf, "events")
    spine = events.select("user_id").distinct().withColumn("source", F.explode(F.array(F.lit("click"), F.lit("view"), F.lit("never"))))
    return wells.seed_counts(events.select("user_id", F.col("event_type").alias("source")), spine, ["user_id", "source"])


@query("SELECT n_nationkey, cast(6 + n_nationkey % 3 AS integer) AS wells, CASE n_nationkey % 3 WHEN 2 THEN 233 WHEN 1 THEN 269 ELSE 281 END AS size, CASE n_nationkey % 3 WHEN 2 THEN 115 WHEN 1 THEN 125 ELSE 140 END AS half FROM nation")
def q_grid_size(spark, sf):
    """Well size and half window by wells per row (MAP18)."""
    size, half = wells.well_size(F.col("wells"))
    rows = table(spark, sf, "nation").select("n_nationkey", (6 + F.col("n_nationkey") % 3).cast("int").alias("wells"))
    return rows.select("n_nationkey", "wells", size.alias("size"), half.alias("half"))


@query("SELECT 'k' || n_nationkey AS name, cast(n_regionkey AS varchar) AS value FROM nation")
def q_options(spark, sf):
    """A key-value parameter file, written and read back (SRC9)."""
    path = fresh_dir(spark, "options")
    line = F.concat(F.lit("k"), F.col("n_nationkey").cast("string"), F.lit("  "), F.col("n_regionkey").cast("string"))
    table(spark, sf, "nation").select(line.alias("value")).coalesce(1).write.text(path)
    return spark.createDataFrame(list(manifest.read_options(spark, path).items()), "name string, value string")


@query("SELECT cast(min(r_regionkey) + 1 AS double) AS a11, 0.25::double AS a12, 0.5::double AS a21, cast(max(r_regionkey) AS double) AS a22 FROM region")
def q_mixing_matrix(spark, sf):
    """A 2 x 2 matrix in a text file, written and read back (SRC10)."""
    path = fresh_dir(spark, "matrix")
    lines = F.array(F.concat((F.min("r_regionkey") + 1).cast("string"), F.lit(" 0.25")), F.concat(F.lit("0.5 "), F.max("r_regionkey").cast("string")))
    table(spark, sf, "region").agg(F.explode(lines).alias("value")).coalesce(1).write.text(path)
    return spark.createDataFrame([manifest.read_mixing_matrix(spark, path)], "a11 double, a12 double, a21 double, a22 double")


@query(f"WITH {SD} SELECT frame, x, y FROM sd")
def q_seeds_file(spark, sf):
    """Seeds as tab text by frame, row and column, written and read back (SNK4, SRC11)."""
    path = fresh_dir(spark, "seeds")
    tables.write_seeds(seeds(spark, sf).select("frame", "x", "y"), path)
    return manifest.read_tab(spark, path, "frame int, x int, y int")


@query(f"""WITH {TP}, s AS (SELECT user_id, f, CASE WHEN f = 1 THEN 0 ELSE cast(floor(x) AS integer) % 5 - 2 END AS dx, CASE WHEN f = 1 THEN 0 ELSE y % 5 - 2 END AS dy FROM tp),
p AS (SELECT user_id, f, sum(dx) OVER w AS px, sum(dy) OVER w AS py FROM s WINDOW w AS (PARTITION BY user_id ORDER BY f ROWS UNBOUNDED PRECEDING))
SELECT cast(user_id AS integer) AS block, f AS frame, cast(200 - px AS integer) AS x, cast(300 - py AS integer) AS y FROM p""")
def q_centres_file(spark, sf):
    """Centres of a well that follows the drift, as tab text by block and frame, written and read back (SNK5)."""
    path, first = fresh_dir(spark, "centres"), F.col("f") == 1
    steps = tracks(spark, sf).select("user_id", "f", F.when(first, 0).otherwise(F.floor("x").cast("int") % 5 - 2).alias("dx"), F.when(first, 0).otherwise(F.col("y") % 5 - 2).alias("dy"))
    moved = wells.drift_path(steps, ["user_id"], "f").select(F.col("user_id").alias("block"), F.col("f").alias("frame"), "px", "py")
    found = moved.select("block").distinct().select("block", F.lit(200).alias("x"), F.lit(300).alias("y"))
    tables.write_centres(found, moved, path)
    return manifest.read_tab(spark, path, "block int, frame int, x int, y int")


@query("SELECT user_id, round(avg(value), 6) AS m FROM events GROUP BY user_id")
def q_table_file(spark, sf):
    """A feature table as tab text, written over an older one and read back (SNK6)."""
    path = fresh_dir(spark, "table")
    for rows in (table(spark, sf, "events").limit(1), table(spark, sf, "events")):
        tables.write_tab(rows.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("m")), path)
    return manifest.read_tab(spark, path, "user_id long, m double")


@query(f"WITH {PX} SELECT x, y, cast(vec_id AS integer) AS z FROM px WHERE i >= 1200")
def q_points_file(spark, sf):
    """A list of points that counts from one, written and read back (LG26, LG28)."""
    path = fresh_dir(spark, "points")
    volume.write_points(pixels(spark, sf).where("i >= 1200").select("x", "y", F.col("vec_id").cast("int").alias("z")), path)
    return volume.read_points(spark, path)


def _tiff_files(spark, sf):
    """The stacks of ``_stack`` as files: label, content."""
    path = fresh_dir(spark, "tiff")
    tiff.write_stacks(tiff.stacks(_stack(spark, sf).withColumn("width", F.lit(8)), ["label"]), ["label"], path)
    label = F.regexp_extract("path", "label=([0-9]+)/", 1).cast("int")
    return tiff.files_of(spark, path, "part-*").select(label.alias("label"), "content")


@query("SELECT DISTINCT cast(label AS integer) AS label FROM embeddings")
def q_file_list(spark, sf):
    """The files of a folder, without their contents (SRC1)."""
    path = fresh_dir(spark, "list")
    tiff.write_stacks(tiff.stacks(_stack(spark, sf).withColumn("width", F.lit(8)), ["label"]), ["label"], path)
    return manifest.list_frames(spark, path, "part-*").select(F.regexp_extract("path", "label=([0-9]+)/", 1).cast("int").alias("label"))


@query(f"WITH {PX}, {FRAME} SELECT label, frame, cast(8 AS integer) AS width, cast(8 AS integer) AS height, pos, i FROM px JOIN fr USING (vec_id, label)")
def q_tiff_stacks(spark, sf):
    """A TIFF file per label, its frames in order, written, listed and read again (SRC1, SRC7, SNK1, SNK2)."""
    rows = tiff.decode_frames(_tiff_files(spark, sf), ["label"])
    return rows.select("label", F.col("page").alias("frame"), "width", "height", F.posexplode("px").alias("pos", "i"))


@query(f"WITH {PX}, {FRAME} SELECT label, frame, pos, i FROM px JOIN fr USING (vec_id, label) WHERE frame < 3")
def q_tiff_first_pages(spark, sf):
    """The first three pages of each TIFF; later ones are not decoded (SRC8)."""
    return tiff.decode_frames(_tiff_files(spark, sf), ["label"], first=3).select("label", F.col("page").alias("frame"), F.posexplode("px").alias("pos", "i"))


@query(f"WITH {SD}, m AS (SELECT frame, x % 8 AS x, y % 8 AS y FROM sd GROUP BY ALL) SELECT f.frame, cast(p AS integer) AS pos, CASE WHEN m.x IS NULL THEN 0 ELSE 255 END AS v FROM (SELECT DISTINCT frame FROM sd) f, unnest(range(64)) AS t(p) LEFT JOIN m ON m.frame = f.frame AND m.x = p % 8 AND m.y = p // 8")
def q_seed_map(spark, sf):
    """The debug image of a frame's seeds (SNK7): 255 at seeds, 0 elsewhere, as a TIFF and decoded again."""
    rows = seeds(spark, sf).select("frame", (F.col("x") % 8).alias("x"), (F.col("y") % 8).alias("y"))
    files = tiff.stacks(stack.seed_maps(rows, ["frame"], 8, 8).withColumnRenamed("frame", "day").withColumn("frame", F.lit(0)), ["day"], bits=8)
    return tiff.decode_frames(files, ["day"]).select(F.col("day").alias("frame"), F.posexplode("px").alias("pos", "v"))


@query(f"WITH {PX}, {FRAME} SELECT label, frame, pos, i FROM px JOIN fr USING (vec_id, label)")
def q_long_stacks(spark, sf):
    """A BigTIFF per label, written page by page by a task that holds two of them, and read again (SNK1, SNK2)."""
    path = fresh_dir(spark, "long")
    tiff.write_long_stacks(_stack(spark, sf).withColumn("width", F.lit(8)), ["label"], path)
    files = tiff.files_of(spark, path, "part-*").select(F.regexp_extract("path", "label=([0-9]+)/", 1).cast("int").alias("label"), "content")
    return tiff.decode_frames(files, ["label"]).select("label", F.col("page").alias("frame"), F.posexplode("px").alias("pos", "i"))


@query(f"WITH {PX}, {FRAME} SELECT label, frame, pos, i FROM px JOIN fr USING (vec_id, label)")
def q_nrrd_stacks(spark, sf):
    """A gzip NRRD volume per label, written, read and decoded again (SRC7)."""
    path = fresh_dir(spark, "nrrd")
    packed = _stack(spark, sf).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("frame", "px"))).alias("f"))

    def build(batches):
        for batch in batches:
            made = [nrrd.volume([_square(x["px"]) for x in f]) for f in batch.column("f").to_pylist()]
            yield pa.record_batch({"label": batch.column("label"), "content": pa.array(made, pa.binary())})

    tiff.write_stacks(packed.mapInArrow(build, "label int, content binary"), ["label"], path)
    files = tiff.files_of(spark, path, "part-*").select(F.regexp_extract("path", "label=([0-9]+)/", 1).cast("int").alias("label"), "content")
    # the newline of the writer is no part of a gzip body
    rows = nrrd.decode_planes(files.withColumn("content", F.expr("substr(content, 1, length(content) - 1)")), ["label"])
    return rows.select("label", F.col("page").alias("frame"), F.posexplode("px").alias("pos", "i")).withColumn("i", F.col("i").cast("int"))


def _square(px):
    return np.array(px).reshape(8, 8)


@query(f"""WITH {SD}, v AS (SELECT user_id, frame, min(cast(x AS double)) AS v FROM sd GROUP BY ALL), f AS (SELECT u.user_id, k AS frame FROM (SELECT DISTINCT user_id FROM sd) u, unnest(range((SELECT max(frame) + 1 FROM sd))) AS t(k))
SELECT user_id, count(*) AS n, sum(coalesce(v, -1000.0)) AS total, sum(f.frame * coalesce(v, -1000.0)) AS moment FROM f LEFT JOIN v USING (user_id, frame) GROUP BY user_id""")
def q_wide_file(spark, sf):
    """A line of text per well with a value for every frame, written by streaming tasks and read again (TB1, TB3)."""
    path = fresh_dir(spark, "wide")
    tables.write_wide(seeds(spark, sf).withColumn("v", F.col("x").cast("double")), ["user_id"], path, "v")
    parts = F.split("value", "\t")
    values = F.transform(F.slice(parts, 2, F.size(parts)), lambda v: v.cast("double"))
    rows = spark.read.text(path).select(parts[0].cast("long").alias("user_id"), F.posexplode(values).alias("frame", "v"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("frame") * F.col("v")).alias("moment"))


@query(f"""WITH {SD}, w AS (SELECT y % 5 AS row, x % 5 AS col, min(x) AS x, min(y) AS y FROM sd WHERE x % 5 <> 3 GROUP BY ALL), g AS (SELECT p // 6 AS row, p % 6 AS col FROM unnest(range(36)) AS t(p))
SELECT cast(g.row AS integer) AS row, cast(g.col AS integer) AS col, coalesce(w.x, 0) AS x, coalesce(w.y, 0) AS y FROM g LEFT JOIN w ON w.row = g.row AND w.col = g.col""")
def q_well_centres_file(spark, sf):
    """The centres of a grid of wells as the next stage reads them, with the cells that have none (SNK5)."""
    path = fresh_dir(spark, "well-centres")
    own = seeds(spark, sf).where("x % 5 <> 3").groupBy((F.col("y") % 5).alias("row"), (F.col("x") % 5).alias("col")).agg(F.min("x").alias("x"), F.min("y").alias("y"))
    tables.write_well_centres(own, 6, path)
    return manifest.read_tab(spark, path, "row int, col int, x int, y int")


@query(f"WITH {TP}, s AS (SELECT f - 1 AS frame, cast(floor(x) AS integer) % 5 - 2 AS dx, y % 5 - 2 AS dy FROM tp WHERE user_id = (SELECT min(user_id) FROM tp)) SELECT cast(frame AS integer) AS frame, CASE WHEN frame = 0 THEN 0 ELSE dx END AS dx, CASE WHEN frame = 0 THEN 0 ELSE dy END AS dy FROM s")
def q_shifts_file(spark, sf):
    """The shifts of one block, here the first user, against the frame before, as the next stage reads them (SNK5)."""
    path = fresh_dir(spark, "shifts")
    own = tracks(spark, sf).join(tracks(spark, sf).agg(F.min("user_id").alias("user_id")), "user_id")
    tables.write_shifts(own.select((F.col("f") - 1).alias("frame"), (F.floor("x").cast("int") % 5 - 2).alias("dx"), (F.col("y") % 5 - 2).alias("dy")), path)
    return manifest.read_tab(spark, path, "frame int, dx int, dy int")


@query("""SELECT cast(l_quantity AS integer) AS c1, cast(round(l_discount * 100) AS integer) AS c2, count(*) % 65536 AS n FROM lineitem WHERE cast(l_quantity AS integer) < 45 AND round(l_discount * 100) < 45 GROUP BY ALL""")
def q_scatter_image(spark, sf):
    """The scatter image of two channels, made as tiles from sparse counts, and its counts again (SNK7)."""
    own = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("c1"), F.round(F.col("l_discount") * 100).cast("int").alias("c2"))
    counts = histogram.joint_histogram(own, F.col("c1"), F.col("c2"), 45)
    tiles = stack.count_tiles(counts, [], 45, 16)
    px = tiles.select("top", "left", "width", F.posexplode("px").alias("pos", "n")).where("n > 0")
    return px.select((F.col("left") + F.col("pos") % F.col("width")).alias("c1"), (F.col("top") + F.floor(F.col("pos") / F.col("width"))).cast("int").alias("c2"), F.col("n").cast("long").alias("n"))


@query(f"WITH {SD}, w AS (SELECT frame, x % 8 AS x, y % 8 AS y, row_number() OVER (PARTITION BY frame, y % 8 // 4, x % 8 // 4 ORDER BY y % 8, x % 8) AS k FROM sd) SELECT f.frame, cast(p AS integer) AS pos, CASE WHEN w.x IS NULL THEN 0 ELSE 255 END AS v FROM (SELECT DISTINCT frame FROM sd) f, unnest(range(64)) AS t(p) LEFT JOIN w ON w.frame = f.frame AND w.k = 1 AND w.x = p % 8 AND w.y = p // 8")
def q_well_map(spark, sf):
    """The debug image of the wells of a frame, the first of each quarter (SNK7): 255 at their centres, as a TIFF and decoded again."""
    x, y = F.col("x") % 8, F.col("y") % 8
    own = Window.partitionBy("frame", F.floor(y / 4), F.floor(x / 4)).orderBy(y, x)
    found = seeds(spark, sf).withColumn("k", F.row_number().over(own)).where("k = 1").select("frame", x.alias("x"), y.alias("y"))
    files = tiff.stacks(stack.seed_maps(found, ["frame"], 8, 8).withColumnRenamed("frame", "day").withColumn("frame", F.lit(0)), ["day"], bits=8)
    return tiff.decode_frames(files, ["day"]).select(F.col("day").alias("frame"), F.posexplode("px").alias("pos", "v"))
