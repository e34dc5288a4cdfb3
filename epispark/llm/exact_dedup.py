"""Exact duplicates by a content sort.

Rows are range-partitioned by sampled splitters over (first characters, digest) of the text and
sorted outside memory, so equal texts lie side by side; the window walks the sorted rows and compares
each whole text with its neighbour's. The splitter key has a bounded length, so what the sampler
sends to the driver does not grow with the texts.

A text with more copies than one partition should hold is cut into several runs by a hash of its
identifier. How many copies it has and which identifier wins are counted first, combined in the map
tasks; by construction at most one such text exists per shuffle partition, so that table is broadcast.

Defined results: a null text counts as empty; rows without an identifier lose against rows with one;
of rows that repeat both text and identifier exactly one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.llm.common import packed, shuffle_partitions, unpacked, whole_text

#: Characters of the text in the splitter key.
KEY_CHARS = 32


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "min",
               normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each row with its group of equal normalised texts.

    Columns: row (the input row), id, keep_id, group_size, kept, digest (sha256 of the normalised
    text). `keep` says whether the smallest or the largest identifier stays."""
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    text = whole_text(df[text_col])
    rows = packed(df, id=df[id_col], text=normalise(text) if normalise else text)
    rows = rows.withColumn("digest", F.sha2("text", 256))
    parts = shuffle_partitions(df.sparkSession)
    share = max(1, df.count() // parts)
    hot = (rows.groupBy("digest").agg(F.count("*").alias("copies"), (F.min if keep == "min" else F.max)("id").alias("winner"))
           .where(F.col("copies") > share)
           .withColumn("runs", F.ceil(F.col("copies") / share)))
    dealt = (rows.join(F.broadcast(hot), "digest", "left")
             .withColumn("run", F.when(F.col("runs").isNotNull(), F.pmod(F.xxhash64("id"), F.col("runs"))).otherwise(F.lit(0)))
             .withColumn("head", F.substring("text", 1, KEY_CHARS))
             .repartitionByRange("head", "digest", "run"))
    same = Window.partitionBy("head", "digest", "run", "text")
    order = F.col("id").asc_nulls_last() if keep == "min" else F.col("id").desc_nulls_last()
    ranked = same.orderBy(order)
    best = F.first("id").over(ranked)
    return dealt.select(
        "row", "id", "digest",
        F.when(F.col("runs").isNull(), best).otherwise(F.col("winner")).alias("keep_id"),
        F.coalesce("copies", F.count("*").over(same)).alias("group_size"),
        ((F.row_number().over(ranked) == 1) & (F.col("runs").isNull() | F.col("id").eqNullSafe(F.col("winner")))).alias("kept"),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with the columns of the input."""
    return unpacked(duplicates(df, id_col, text_col, **options).where("kept"))
