"""Acquisition manifests, parameter files and small text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Lines of a parameter file and channel tokens of an experiment, at most; more raise an error.
MOST_LINES, MOST_CHANNELS = 10_000, 100


def list_frames(spark: SparkSession, folder: str, glob: str = "*.[tT][iI][fF]") -> DataFrame:
    """(path, name) of image files; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path")
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1))


def padded_block(block: Column, digits: int) -> Column:
    return F.lpad(block.cast("string"), digits, "0")


def time_before(name: Column, mark: str, digits: int, missing: int) -> Column:
    """The first run of digits in the last ``digits`` characters before the first ``mark``."""
    head = F.substring_index(name, mark, 1)
    found = F.regexp_extract(F.substring(head, -digits, digits), "[0-9]+", 0)
    return F.when(F.instr(name, mark) <= 1, F.lit(missing)).otherwise(F.coalesce(F.nullif(found, F.lit("")).cast("int"), F.lit(missing)))


def _matched(own: DataFrame, channels: DataFrame) -> DataFrame:
    """Names with the roles whose token they contain. Channels are a handful of tokens, which is checked."""
    tokens = channels.where("token <> ''")
    if tokens.count() > MOST_CHANNELS:
        raise ValueError(f"more than {MOST_CHANNELS} channel tokens")
    return own.join(F.broadcast(tokens), F.col("name").contains(F.col("token")))


def zeiss(names: DataFrame, channels: DataFrame, digits: int = 3, time_digits: int = 2) -> DataFrame:
    """(block, role, frame) and the columns of ``names`` (name and any others) of names like
    <exp>_s003t07c3_ORG.tif. channels: role, token."""
    block = F.regexp_extract("name", f"_s([0-9]{{{digits}}})", 1)
    own = names.where(F.col("name").contains(".tif")).withColumn("block", F.nullif(block, F.lit("")).cast("int")).where("block is not null")
    return _matched(own, channels).select("block", "role", time_before(F.col("name"), "c", time_digits, 0).alias("frame"), *names.columns)


def leica(names: DataFrame, channels: DataFrame, digits: int = 3, time_digits: int = 3) -> DataFrame:
    """As ``zeiss`` for names like <exp>012_w2CH_t003.TIF; names without a time are dropped."""
    block = F.regexp_extract("name", f"_t([0-9]{{{digits}}})\\.TIF", 1)
    own = names.withColumn("block", F.nullif(block, F.lit("")).cast("int")).where("block is not null")
    found = _matched(own, channels)
    return found.select("block", "role", time_before(F.col("name"), "_w", time_digits, -1).alias("frame"), *names.columns).where("frame >= 0")


def in_order(manifest: DataFrame) -> DataFrame:
    """Adds place: files of a block and channel by frame, then name."""
    own = Window.partitionBy("block", "role").orderBy("frame", "name")
    return manifest.withColumn("place", F.row_number().over(own))


def read_options(spark: SparkSession, path: str) -> dict[str, str]:
    """A key-value parameter file; the last of several lines with one key counts."""
    return {r.kv[0]: r.kv[1] for r in _few_lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("kv")).where("size(kv) >= 2").collect()}


def _few_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a parameter file. A file of more than MOST_LINES is none, and an error."""
    lines = spark.read.text(path)
    if (n := lines.limit(MOST_LINES + 1).count()) > MOST_LINES:
        raise ValueError(f"{path} has {n} lines or more, which is no parameter file")
    return lines


def read_mixing_matrix(spark: SparkSession, path: str) -> tuple[float, float, float, float]:
    a11, a12, a21, a22 = (float(v) for r in _few_lines(spark, path).collect() for v in r.value.split())
    return a11, a12, a21, a22


def read_tab(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headerless tab-delimited numbers."""
    return spark.read.csv(path, sep="\t", schema=schema)


def block_folders(names: DataFrame) -> DataFrame:
    """(name, block, ordinal) of block folders. The block is parsed from the name; the place
    in name order, which some tables use instead, is the ordinal (one row per folder)."""
    found = names.where(F.col("name").rlike("^B[0-9]+$"))
    return found.select("name", F.substring("name", 2, 20).cast("int").alias("block"), F.row_number().over(Window.orderBy("name")).alias("ordinal"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One folder of file names per block and channel, replacing what was there."""
    manifest.select("block", "role", "frame", "name").write.mode("overwrite").partitionBy("block", "role").csv(path, sep="\t")


def list_files(spark: SparkSession, folder: str, glob: str = "*.[tT][iI][fF]") -> DataFrame:
    """(path, length, modificationTime) of the files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", "modificationTime")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file, on any file system."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own)
