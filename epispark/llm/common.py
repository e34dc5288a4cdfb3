"""Helpers of the text operators: session settings, checkpoints, safe column handling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from the files.

    The folder is the one in `spark.checkpoint.dir`. Only a local master that names none gets a
    folder of its own, as in tests; elsewhere that is an error."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet to a fresh folder below the shared checkpoint folder and read them again."""
    path = f"{_shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
            folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """The whole row in one struct column `row`, beside helper columns.

    The helpers can then not clash with columns of the input, whatever those are called."""
    row = F.struct(*[df[f"`{c}`"] for c in df.columns]) if df.columns else F.struct(F.lit(None).alias("none"))
    return df.select(row.alias("row"), *[c.alias(name) for name, c in extra.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def whole_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves `part` when divided by `parts`; a null key does not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
