"""Feature tables in long and wide form."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Value of missing features in exported tables.
MISSING = -1000.0
#: Row numbers of the well block: effector rows, five targets of eight rows, two bead rows, frame numbers.
BLOCK_ROWS = {"effector": 0, "targets": 6, "beads": 46, "frame": 48}


def wide(long: DataFrame, keys: list[str], frames: list[int], value: str) -> DataFrame:
    """One column f1..fN per frame; the given frames spare the pivot a pass over the data."""
    found = long.groupBy(*keys).pivot("frame", frames).agg(F.first(value))
    return found.select(*keys, *(F.coalesce(F.col(str(f)), F.lit(MISSING)).alias(f"f{k}") for k, f in enumerate(frames, 1)))


def every_frame(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What ``wide`` holds for all frames up to the data's largest, in rows: keys, frame, value."""
    last = long.agg(F.max("frame")).first()[0]  # one number
    spine = long.select(*keys).distinct().withColumn("frame", F.explode(F.sequence(*(F.lit(k).cast(long.schema["frame"].dataType) for k in (0, last or 0)))))
    found = long.groupBy(*keys, "frame").agg(F.first(value).alias(value))
    return spine.join(found, [*keys, "frame"], "left").select(*keys, "frame", F.coalesce(value, F.lit(MISSING)).alias(value))


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def well_block(features: DataFrame, keys: list[str], frames: list[int]) -> DataFrame:
    """The 49-row block of each well, from long features (keys, part, target, name, frame, value).

    part is effector, target or bead; effector rows are x, y, ratio, displacement, death and a
    separator; each of five targets has the same five, a separator, assoc and a separator; two
    bead rows; a row of frame numbers. Missing values are MISSING.
    """
    names = {"x": 0, "y": 1, "ratio": 2, "displacement": 3, "death": 4, "assoc": 6}
    offset = F.create_map(*(F.lit(v) for kv in names.items() for v in kv))[F.col("name")]
    line = F.when(F.col("part") == "effector", offset).when(F.col("part") == "target", 6 + 8 * F.col("target") + offset).otherwise(46 + F.col("target"))
    values = wide(features.withColumn("line", line), [*keys, "line"], frames, "value")
    spine = features.select(*keys).distinct().withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(48))))
    fixed: Column = F.when(F.col("line") == 5, -1.0).when((F.col("line") >= 6) & (F.col("line") < 46) & ((F.col("line") - 6) % 8 == 5), -1.0)
    fixed = fixed.when((F.col("line") >= 6) & (F.col("line") < 46) & ((F.col("line") - 6) % 8 == 7), -2.0)
    rows = spine.join(values, [*keys, "line"], "left").withColumn("fixed", fixed)
    return rows.select(*keys, "line", *(F.when(F.col("line") == 48, F.lit(float(k))).otherwise(F.coalesce("fixed", f"f{k}", F.lit(MISSING))).alias(f"f{k}") for k in range(1, len(frames) + 1)))


def write_seeds(seeds: DataFrame, path: str) -> None:
    """Seeds (frame, x, y) as tab text in the order of frame, row and column, whatever the tasks did."""
    write_tab(seeds.select("frame", "x", "y").orderBy("frame", "y", "x"), path)


def write_centres(wells: DataFrame, shifts: DataFrame, path: str) -> None:
    """Centres (block, frame, x, y) of wells (block, x, y, ...) along the summed shifts (block, frame, px, py), as
    tab text in the order of block, frame, row and column."""
    rows = wells.join(shifts, "block").select("block", "frame", (F.col("x") - F.col("px")).alias("x"), (F.col("y") - F.col("py")).alias("y"))
    write_tab(rows.orderBy("block", "frame", "y", "x"), path)


def write_wide(long: DataFrame, keys: list[str], path: str, value: str = "value", last: int | None = None) -> None:
    """Write what ``wide`` holds as headerless tab text, keys then a value per frame 0..``last`` (default: the data's largest), for any
    number of frames (TB1, TB3). Rows are sorted by keys and frame, and a task makes each line from them in turn: no column per frame
    is planned. Of several values of a frame the first in order counts."""
    last = last if last is not None else long.agg(F.max("frame")).first()[0]  # one number
    rows = long.select(*keys, F.col("frame").cast("int").alias("frame_"), F.col(value).cast("double").alias("value_"))
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "frame_", F.col("value_").asc_nulls_last())
    shown = lambda v: "" if v is None else str(v)

    def lines(batches):
        own, held, done = None, [], []

        def close():
            done.append("\t".join([*map(shown, own), *held, *[repr(MISSING)] * ((last or 0) + 1 - len(held))]))

        for batch in batches:
            for *key, frame, v in zip(*(batch.column(c).to_pylist() for c in (*keys, "frame_", "value_")), strict=True):
                if key != own:
                    if own is not None:
                        close()
                    own, held = key, []
                if frame is not None and len(held) <= frame <= (last or 0):
                    held += [repr(MISSING)] * (frame - len(held))
                    held.append(repr(MISSING if v is None else v))
            if done:
                yield pa.record_batch({"value": pa.array(done)})
                done = []
        if own is not None:
            close()
            yield pa.record_batch({"value": pa.array(done)})

    dealt.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def write_well_centres(wells: DataFrame, per_row: int, path: str) -> None:
    """Centres of one block's wells (row, col, x, y) as the next stage reads them: a line "row col x y" for each cell of the grid, zeros
    where no well was found (SNK5)."""
    spark = wells.sparkSession
    grid = spark.range(per_row * per_row).select((F.col("id") / per_row).cast("int").alias("row"), (F.col("id") % per_row).cast("int").alias("col"))
    rows = grid.join(wells.select("row", "col", "x", "y"), ["row", "col"], "left").na.fill(0, ["x", "y"])
    write_tab(rows.orderBy("row", "col").coalesce(1), path)


def write_shifts(shifts: DataFrame, path: str) -> None:
    """Shifts of one block (frame, dx, dy) against the frame before, a line "frame dx dy" each, zeros at the first (SNK5)."""
    first = F.col("frame") == F.lit(0)
    rows = shifts.select("frame", *(F.when(first, 0).otherwise(F.coalesce(c, F.lit(0))).alias(c) for c in ("dx", "dy")))
    write_tab(rows.orderBy("frame").coalesce(1), path)


def write_tab(table: DataFrame, path: str) -> None:
    """Headerless tab-delimited text, replacing what was there."""
    table.write.mode("overwrite").csv(path, sep="\t", header=False)
