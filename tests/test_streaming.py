"""Streaming forms against their batch forms."""

from pyspark.sql import functions as F

from lapsegrid.operators import tracking
from lapsegrid.sources.views import tracks
from lapsegrid.streaming import streams

SF = "/root/testdata/sf0.001"


def drain(spark, frame, name, mode):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def source(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return streams.event_stream(spark, SF, schema, "events.parquet", 1)


def test_windowed_counts(spark):
    got = drain(spark, streams.windowed_counts(source(spark), ["event_type"], "value", "1 day"), "w1", "complete")
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()
    assert sorted((str(r.start)[:10], r.event_type, r.n) for r in got) == sorted((str(r.d), r.event_type, r.n) for r in batch)
    sliding = drain(spark, streams.windowed_counts(source(spark), ["event_type"], "value", "1 day", "12 hours"), "w2", "complete")
    assert sum(r.n for r in sliding) == 2 * sum(r.n for r in batch)


def test_session_counts(spark):
    got = drain(spark, streams.session_counts(source(spark), ["user_id"], "2 hours"), "s1", "complete")
    assert sum(r.n for r in got) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_track_steps(spark):
    points = source(spark).select("user_id", "ts", F.col("value").alias("x"), F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("y"))
    got = {(r.track, r.f): round(r.step, 6) for r in drain(spark, streams.track_steps(points, "user_id"), "t1", "append")}
    batch = tracking.displacement(tracks(spark, SF), ["user_id"], "f").collect()
    last = {}
    for r in batch:
        last[r.user_id] = max(last.get(r.user_id, 0), r.f)
    for r in batch:
        if r.f < last[r.user_id]:
            assert abs(got[r.user_id, r.f + 1] - r.displacement) < 1e-6
