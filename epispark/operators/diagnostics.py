"""Data profile, samples of values, row counts, fingerprints, geometry bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epispark.literals import literal_rows
from epispark.operators.counts import multi_counts
from epispark.presets.tuberculosis import DEFAULT_BOUNDS


def column_profile(df: DataFrame) -> DataFrame:
    """(posicao, coluna, tipo, preenchidos, distintos_aprox), all columns in one pass."""
    fields = list(df.schema)
    aggs = []
    for i, f in enumerate(fields):
        aggs += [F.count(F.col(f"`{f.name}`")).alias(f"_n{i}"),
                 F.approx_count_distinct(F.col(f"`{f.name}`")).alias(f"_d{i}")]
    rows = [F.struct(F.lit(i + 1).alias("posicao"), F.lit(f.name).alias("coluna"),
                     F.lit(f.dataType.simpleString()).alias("tipo"), F.col(f"_n{i}").alias("preenchidos"),
                     F.col(f"_d{i}").alias("distintos_aprox")) for i, f in enumerate(fields)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def row_count_by_year(df: DataFrame, year: str) -> DataFrame:
    """(ano, total) with the grand total in the row whose year is null."""
    return df.rollup(F.col(year).alias("ano")).agg(F.count(F.lit(1)).alias("total"))


def sample_values(df: DataFrame, columns: Sequence[str], n: int = 15) -> DataFrame:
    """(coluna, posicao, valor, erro): the first ``n`` sorted distinct values of each column; a
    column the table does not have gives one row with ``erro``."""
    present = [c for c in columns if c in df.columns]
    missing = [c for c in columns if c not in df.columns]
    values = (multi_counts(df, {c: [c] for c in present})
              .select(F.col("bloco").alias("coluna"), F.col("k1").alias("valor"))
              .where(F.col("valor").isNotNull()))
    order = W.partitionBy("coluna").orderBy("valor")
    out = (values.withColumn("posicao", F.row_number().over(order)).where(F.col("posicao") <= n)
           .select("coluna", "posicao", "valor", F.lit(None).cast("string").alias("erro")))
    if missing:
        absent = literal_rows(df.sparkSession, [(c,) for c in missing], "coluna string")
        out = out.unionByName(absent.select("coluna", F.lit(None).cast("int").alias("posicao"),
                                            F.lit(None).cast("string").alias("valor"),
                                            F.lit("coluna ausente").alias("erro")))
    return out


def content_fingerprint(df: DataFrame, column: str) -> DataFrame:
    """(linhas, colunas, soma): order-insensitive hash sum of a column, and the shape.

    The hash is the first 32 bits of MD5, which other engines can recompute."""
    head = F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 8), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("linhas"), F.lit(len(df.columns)).alias("colunas"),
                  F.coalesce(F.sum(head), F.lit(0).cast("decimal(38,0)")).cast("string").alias("soma"))


def content_fingerprint_fast(df: DataFrame, column: str) -> DataFrame:
    """Same with Spark's own 64-bit hash: faster, comparable between Spark runs only."""
    value = F.xxhash64(F.col(column)).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("linhas"), F.lit(len(df.columns)).alias("colunas"),
                  F.coalesce(F.sum(value), F.lit(0).cast("decimal(38,0)")).cast("string").alias("soma"))


def feature_bounds(points: DataFrame, default=DEFAULT_BOUNDS) -> DataFrame:
    """(sul, oeste, norte, leste) of a (lon, lat) table; the default box when it is empty."""
    box = points.agg(F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).toDF("sul", "oeste", "norte", "leste")
    return box.select(*[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in zip(box.columns, default)])
