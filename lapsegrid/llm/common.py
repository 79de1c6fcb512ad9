"""Shared pieces of the training-data operators: shared-folder tables and byte-level text helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from lapsegrid.sources.scratch import fresh_dir

#: Rows and bytes of one Arrow batch: long texts must not pile up in a Python worker.
BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20
#: 64-bit words of a Bloom filter at most: 16 MB, whatever the input.
BLOOM_WORDS = 1 << 21


#: Folders made in the shared folder by this process, in order.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = fresh_dir(spark, name)
    _made.append(path)
    return path


def staged(frame: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and a
    lost executor costs a re-read, not a recomputation."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.option("compression", codec).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def row_by_row(writer: DataFrameWriter) -> DataFrameWriter:
    """Of tables whose rows are chunks of MBs: a row group for each. By default a writer looks at the size of a group after a
    hundred rows only, so that it and its readers would hold hundreds of MB."""
    return writer.option("compression", "zstd").option("parquet.block.row.count.limit", "1")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove(frame: DataFrame) -> None:
    """Delete the files of a staged frame that nothing needs any more."""
    for folder in {f.rpartition("/")[0] for f in frame.inputFiles()}:
        _delete(frame.sparkSession, folder)


def mark() -> int:
    """A place in the list of folders made, for ``sweep``."""
    return len(_made)


def sweep(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the working folders made since a mark, but for those that ``keep`` is read from. Results that
    have not been written yet are read from such folders: sweep when they have been."""
    kept = {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()} if keep is not None else set()
    for folder in [f for f in _made[since:] if f.rpartition("/")[2] not in kept]:
        _made.remove(folder)
        _delete(spark, folder)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small for text columns: an upper bound, a smaller setting of the session stays.
    Both settings are read when a query starts, and results are lazy, so they are set on the session."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = str(spark.conf.get(key, None))
        if not (now.isdecimal() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def columns(batch, *names) -> Iterator[tuple]:
    """Rows of an Arrow batch as tuples of the named columns."""
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 of a text with A-Z lower-cased and every other code point kept; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# -- sets of keys ---------------------------------------------------------
class Bloom:
    """A set of 64-bit hash keys of at most BLOOM_WORDS words: it may hold more than was put in,
    never less. What it lets through is always decided by an exact join afterwards; beyond some
    ten million keys it lets more through, no key is lost."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def of(keys: DataFrame, n: int, most: int | None = None) -> Bloom:
        """The filter of the ``n`` values of the column ``key`` (long): each sets four bits of one word."""
        size = min(most or BLOOM_WORDS, 1 << max(6, (max(1, n) * 16 // 64 - 1).bit_length()))
        bit = lambda shift: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {shift}) & 63 as int))")
        mask = bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12)).bitwiseOR(bit(18))
        word = F.expr(f"shiftrightunsigned(key, 24) & {size - 1}")
        rows = keys.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(size, dtype=np.uint64)
        words[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
        return Bloom(words)

    def might(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys (unsigned 64-bit) may be in the set."""
        one, low = np.uint64(1), np.uint64(63)
        mask = np.zeros(len(keys), dtype=np.uint64)
        for shift in (0, 6, 12, 18):
            mask |= one << ((keys >> np.uint64(shift)) & low)
        return (self.words[(keys >> np.uint64(24)) & np.uint64(len(self.words) - 1)] & mask) == mask


def text_digests(text: Column) -> list[Column]:
    """Two differently seeded hashes: 128 bits that tell texts apart."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def fresh_names(frame: DataFrame, *names: str) -> list[str]:
    """Names, lengthened until no column of the frame is called so in any case."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(rows: DataFrame, keys: list[Column], lost: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows whose two hash keys aren't a row of ``lost`` (d0, d1: long, distinct, staged).

    Few lost keys are joined as they are (16 bytes each, counted before). With more, a Bloom filter
    lets pass what it rules out. Of the others only the keys are compared with ``lost``; those that
    were let in wrongly fill a second filter, and only rows behind both meet the exact anti-join: what
    is kept or lost is never shuffled whole, but for that small share.
    """
    names = fresh_names(rows, "d0", "d1", "maybe", "again")
    keyed = rows.select("*", *(d.alias(n) for d, n in zip(keys, names, strict=False)))
    right = lost.select(F.col("d0").alias(names[0]), F.col("d1").alias(names[1]))
    n = right.count()
    if n <= broadcast_rows:
        return keyed.join(F.broadcast(right), names[:2], "left_anti").select(*rows.columns)
    marked = keyed.withColumn(names[2], _tester(rows.sparkSession, Bloom.of(lost.select(F.col("d0").alias("key")), n))(F.col(names[0])))
    doubtful = staged(marked.where(F.col(names[2])).select(*names[:2]).join(right, names[:2], "left_anti").select(F.col(names[0]).alias("key")).distinct(), "doubtful")
    sure = marked.where(~F.col(names[2])).select(*rows.columns)
    wrong = doubtful.count()
    if not wrong:
        return sure
    rest = marked.where(F.col(names[2])).withColumn(names[3], _tester(rows.sparkSession, Bloom.of(doubtful, wrong))(F.col(names[0]))).where(F.col(names[3]))
    return sure.unionByName(rest.join(right, names[:2], "left_anti").select(*rows.columns))


def _tester(spark: SparkSession, bloom: Bloom):
    words = spark.sparkContext.broadcast(bloom.words)

    @F.arrow_udf("boolean")
    def might(keys: pa.Array) -> pa.Array:
        return pa.array(Bloom(words.value).might(keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    return might
