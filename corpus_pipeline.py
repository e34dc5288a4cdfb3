"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes the documents that the one before kept, written as Parquet below the checkpoint folder
and read again; the files stay there. All but the last return
the columns of the documents; the last returns where each piece of each document goes.

Defined results: a null text counts as empty; empty texts are one text to the exact dedup, and a document without
words is not taken by the mix. A document without a label or a number is scored like any other. Of
equal texts and of a class of near copies the smallest doc_id stays, null numbers last; repeated rows are copies. Null
sources are one source of the mix and conflict with nothing in the packing. Very long texts are read whole by every stage.
Extra columns pass through to the packing under their own names. Without documents every stage returns no rows, without
labels no document is rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.llm import exact_dedup, jaccard, mixing, packing, toxicity
from epispark.llm.common import kept, table, whole_text


def toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labelled ones."""
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    model = toxicity.fit(docs.select(F.col("doc_id").alias("id"), "text"), labels)
    return model.score(docs).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of equal texts, that of the smallest identifier."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest identifier."""
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them, none more than twice."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, size, piece, start, length, bin, at."""
    rows = docs.select(F.col("doc_id").alias("id"), mixing.word_count(F.col("text")).alias("size"), "source",
                       F.hex(F.xxhash64(whole_text(F.col("text")))).alias("cluster"))
    return packing.pack(rows).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("ngram_jaccard", near), ("mixing", mix), ("packing", pack)]
#: A trained model decides in the first stage, so no SQL states the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
