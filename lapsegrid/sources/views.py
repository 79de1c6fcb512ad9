"""Analogue views of the driver's tables: pixels, tracks and seeds, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapsegrid.sources.scratch import shuffled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8x8 frame per row: vec_id, label, px."""
    level = lambda v: F.floor((v.cast("double") + 1.0) * 1000.0).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", level).alias("px"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, pos, x, y, i."""
    rows = frames(spark, sf_dir).select("vec_id", "label", F.posexplode("px").alias("pos", "i"))
    return rows.select("vec_id", "label", "pos", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"), "i")


def frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, frame: time index within a label. As many rows as frames, so that joins shuffle it."""
    own = Window.partitionBy("label").orderBy("vec_id")
    return shuffled(table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.row_number().over(own) - 1).alias("frame")))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ts, f, x, y: one track per user."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    y = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return table(spark, sf_dir, "events").select("user_id", "ts", F.row_number().over(own).alias("f"), F.col("value").alias("x"), y.alias("y"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, frame (day), x, y."""
    y = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", day.alias("frame"), F.floor("value").cast("int").alias("x"), y.alias("y"))


PX = """px AS MATERIALIZED (SELECT vec_id, label, cast(p AS integer) AS pos, cast(p % 8 AS integer) AS x, cast(p // 8 AS integer) AS y,
  cast(floor((cast(embedding[p + 1] AS double) + 1.0) * 1000.0) AS integer) AS i FROM embeddings, unnest(range(64)) AS t(p))"""
FRAME = "fr AS (SELECT vec_id, label, cast(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS integer) AS frame FROM embeddings)"
TP = """tp AS (SELECT user_id, ts, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS integer) AS f, value AS x,
  cast(regexp_extract(props, '[0-9]+') AS integer) AS y FROM events)"""
SD = """sd AS (SELECT event_id, user_id, cast(date_diff('day', DATE '2024-01-01', cast(ts AS date)) AS integer) AS frame,
  cast(floor(value) AS integer) AS x, cast(regexp_extract(props, '[0-9]+') AS integer) AS y FROM events)"""
