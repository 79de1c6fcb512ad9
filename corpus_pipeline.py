"""Corpus pipeline: toxicity, near copies, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of their docs. The last returns the packed training sequences.

Every stage takes null and empty texts, texts of any length, null ids and ids of any type, repeated rows, further columns of
any name, and empty tables, which give empty results. What becomes of them is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsegrid.llm import decontam, packing, secrets, simhash, toxicity
from lapsegrid.llm.common import mark, read, remove, staged, sweep


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier doesn't predict to be toxic. Null and empty texts have no evidence and
    stay; repeated rows stay or go together. Ids of ``labels`` are read as the type of ``doc_id``."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest doc_id, of each class of near copies: null ids come last, ties go by content.
    Null and empty texts are one class, so one of them stays; of repeated rows one stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which no window of a benchmark item occurs. Null and empty texts hold none and stay, as do
    repeated rows without a hit; null items have no windows."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts by marks; all documents stay, null texts as they are. ``n_chars``, where there is such a
    column, is counted anew."""
    out = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the permitted lengths that hold every token once. Null and empty texts are one end token;
    very long texts are cut into pieces; repeated rows are placed like any other. The same documents give the same sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Toxicity, fingerprints and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over all rows of ``documents``. When a stage's rows are written, what it worked with is deleted."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        since = mark()
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", "snappy")
        sweep(spark, since, keep=docs)
        if last is not None:
            remove(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
