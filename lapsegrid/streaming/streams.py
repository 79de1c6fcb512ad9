"""Streaming forms of the frame-sequential operators (an addition: the batch forms are the
measured ones). State is per well and of fixed size; late rows go by the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of parquet files with event time ``ts``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(rows: DataFrame, keys: list[str], value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and mean of ``value`` per key and event-time window (tumbling, or sliding with ``slide``)."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    own = rows.withWatermark("ts", late).groupBy(window, *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return own.select(F.col("window.start").alias("start"), *keys, "n", "mean")


def session_counts(rows: DataFrame, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per key and session."""
    own = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))
    return own.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def _steps(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
    last = state.get if state.exists else (None, None, 0)
    out = []
    for r in rows.itertuples():
        x0, y0, n = last
        step = 0.0 if x0 is None else ((r.x - x0) ** 2 + (r.y - y0) ** 2) ** 0.5
        out.append((key[0], r.ts, n + 1, step))
        last = (float(r.x), float(r.y), n + 1)
    state.update(last)
    yield pd.DataFrame(out, columns=["track", "ts", "f", "step"])


def track_steps(points: DataFrame, key: str) -> DataFrame:
    """(track, ts, f, step): distance of each point from the one before it on its track; the
    previous point and the count are the state. points: key, ts, x, y, in order per micro-batch."""
    return points.withColumn("track", F.col(key).cast("long")).groupBy("track").applyInPandasWithState(
        _steps, "track long, ts timestamp, f long, step double", "x double, y double, n long", "append", GroupStateTimeout.NoTimeout
    )
