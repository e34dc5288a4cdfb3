"""Batch jobs: raw extract -> treated table -> history tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.functions.clean import (
    attach_area, coerce_dates, coerce_small_ints, drop_if_present, month_of, parse_age, whole_number)
from epispark.operators.counts import multi_counts, selection_choices
from epispark.operators.history import history_annual, history_by_area, history_indicators, history_monthly
from epispark.sources.cases import replace_years
from epispark.spec import TB, AreaDim, CaseSpec


def prepare(df: DataFrame, spec: CaseSpec = TB, unmatched_age_as_zero: bool = False) -> DataFrame:
    """Drops administrative columns, types dates and small integers, parses the age text.
    Acts only on columns the table has."""
    df = coerce_dates(drop_if_present(df))
    if spec.age_text in df.columns:
        df = df.withColumn(spec.age, parse_age(F.col(spec.age_text), unmatched_age_as_zero)).drop(spec.age_text)
    return coerce_small_ints(df)


def build_treated(raw: DataFrame, path: str, years: Sequence[int], spec: CaseSpec = TB,
                  clustered: bool = False) -> None:
    """One job over all chosen years. A year without rows in the raw table has none afterwards
    either; the folders of years not asked for stay as they are. A raw table read from year folders is ``clustered``."""
    chosen = raw.where(whole_number(F.col(spec.year)).isin(list(years)))
    replace_years(prepare(chosen, spec), path, years, spec, clustered)


def history_tables(df: DataFrame, dim: AreaDim, first: int, last: int, spec: CaseSpec = TB) -> dict[str, DataFrame]:
    """The four history tables over a range of years. Each reads only the few columns it needs."""
    rows = df.where(F.col(spec.year).between(first, last))
    return {"mensal": history_monthly(rows, spec), "estadual": history_by_area(rows, dim, spec),
            "anual": history_annual(rows, spec), "indicadores": history_indicators(rows, spec)}


def history_counts_long(df: DataFrame, dim: AreaDim, spec: CaseSpec = TB) -> DataFrame:
    """(tabela, nu_ano, chave, casos): the three count tables from one scan, in long form."""
    rows = attach_area(df, dim, spec, "left").select(
        F.col(spec.year).cast("int").alias("nu_ano"), month_of(F.col(spec.date)).alias("mes_num"), "sigla")
    long = multi_counts(rows, {"mensal": ["nu_ano", "mes_num"], "estadual": ["nu_ano", "sigla"], "anual": ["nu_ano"]})
    kept = long.where((F.col("bloco") == "anual") | F.col("k2").isNotNull())
    return kept.select(F.col("bloco").alias("tabela"), F.col("k1").cast("int").alias("nu_ano"),
                       F.col("k2").alias("chave"), F.col("n").alias("casos"))


def write_history(df: DataFrame, dim: AreaDim, path: str, first: int, last: int, spec: CaseSpec = TB) -> None:
    """All four history tables from two passes: one for the three count tables, one for the indicators."""
    rows = df.where(F.col(spec.year).between(first, last))
    history_counts_long(rows, dim, spec).write.mode("overwrite").partitionBy("tabela").parquet(f"{path}/contagens")
    history_indicators(rows, spec).write.mode("overwrite").parquet(f"{path}/indicadores")


def write_choices(df: DataFrame, path: str, spec: CaseSpec = TB) -> None:
    """Calendar years and filter choices of the whole series, for ``composites.meta``."""
    selection_choices(df, spec).write.mode("overwrite").parquet(f"{path}/opcoes")


def read_choices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bloco string, valor string").parquet(f"{path}/opcoes")


def read_history(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What ``write_history`` left, by table name."""
    counts = spark.read.schema("nu_ano int, chave string, casos long, tabela string").parquet(f"{path}/contagens")

    def table(name: str, *columns: str) -> DataFrame:
        return counts.where(F.col("tabela") == name).selectExpr("nu_ano", *columns, "casos")

    return {"mensal": table("mensal", "int(chave) AS mes_num"), "estadual": table("estadual", "chave AS uf_sigla"),
            "anual": table("anual"), "indicadores": spark.read.parquet(f"{path}/indicadores")}
