"""Refresh of the years that changed.

A table of fingerprints, one row per year, says what the published tables were built from. A refresh
takes the fingerprints of the cases as they are now, in one pass over the columns that the tables use, and
rebuilds the years whose fingerprint is new or other; a year that has gone loses its folders. The
folders of all other years are not touched. Fingerprints are written last, so a run that breaks off is made
up for by the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.literals import literal_rows
from epispark.operators.history import history_indicators
from epispark.plans.batch import history_counts_long
from epispark.plans.cells import HELD, cells_of
from epispark.sources.cases import replace_years
from epispark.spec import TB, AreaDim, CaseSpec

FINGERPRINTS = "ano int, linhas long, soma string"
NEW, CHANGED, SAME, GONE = "novo", "alterado", "igual", "removido"


def history_columns(spec: CaseSpec = TB) -> list[str]:
    """What the history tables read of a case."""
    return [spec.year, spec.date, spec.area, spec.outcome, spec.hiv, spec.entry, spec.form,
            "agravo_aids", "agravo_alcoolismo", "populacao_situacao_rua", "populacao_privada_liberdade"]


def year_fingerprints(df: DataFrame, columns: Sequence[str] | None = None, spec: CaseSpec = TB) -> DataFrame:
    """(ano, linhas, soma): rows of each year and the sum of a hash of their columns, whatever their order.

    The hash is the first 60 bits of MD5 over the columns as text, each with its length, which other engines can recompute;
    sums, not exclusive ors, so a row that is doubled shows."""
    def part(c: str):
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0"))
        return F.concat(F.length(text).cast("string"), F.lit(":"), text)

    names = sorted(df.columns if columns is None else columns)
    head = F.conv(F.substring(F.md5(F.concat(*map(part, names))), 1, 15), 16, 10).cast("decimal(38,0)")
    return (df.where(F.col(spec.year).isNotNull()).groupBy(F.col(spec.year).cast("int").alias("ano"))
            .agg(F.count(F.lit(1)).alias("linhas"), F.sum(head).cast("string").alias("soma")))


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """The stored fingerprints; none before the first refresh."""
    try:
        return spark.read.schema(FINGERPRINTS).parquet(f"{path}/impressoes")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return literal_rows(spark, [], FINGERPRINTS)


def compare_years(now: DataFrame, before: DataFrame) -> DataFrame:
    """(ano, estado): new, changed, same or gone."""
    both = now.join(before.select("ano", F.col("linhas").alias("_n"), F.col("soma").alias("_s")), "ano", "full")
    state = (F.when(F.col("_n").isNull(), NEW).when(F.col("linhas").isNull(), GONE)
             .when((F.col("linhas") == F.col("_n")) & (F.col("soma") == F.col("_s")), SAME).otherwise(CHANGED))
    return both.select("ano", state.alias("estado"))


def _write_history(rows: DataFrame, dim: AreaDim, path: str, years: Sequence[int], spec: CaseSpec) -> None:
    counts = history_counts_long(rows, dim, spec).where(F.col("nu_ano").isNotNull())
    replace_years(counts.hint("rebalance", F.col("nu_ano")), f"{path}/contagens", years, column="nu_ano", order=("nu_ano", "tabela", "chave"))
    replace_years(history_indicators(rows, spec).hint("rebalance", F.col("nu_ano")), f"{path}/indicadores", years, column="nu_ano", order=("nu_ano",))


def refresh_history(df: DataFrame, dim: AreaDim, path: str, spec: CaseSpec = TB, cells: bool = False, held: Sequence[str] = HELD) -> DataFrame:
    """Brings the history tables, and with ``cells`` the published cells, below ``path`` up to date with the
    cases, year by year, and returns (ano, estado) of this run. ``batch.read_history`` reads the result.

    What reaches the driver is calendar years and their fingerprints."""
    spark = df.sparkSession
    now = year_fingerprints(df, None if cells else history_columns(spec), spec)
    found = literal_rows(spark, now.collect(), FINGERPRINTS)  # a row per calendar year; the cases are read once for it
    states = compare_years(found, read_fingerprints(spark, path)).collect()
    stale = sorted(r["ano"] for r in states if r["estado"] != SAME)
    if stale:
        rows = df.where(F.col(spec.year).isin(stale))
        _write_history(rows, dim, path, stale, spec)
        if cells:
            replace_years(cells_of(rows, dim, spec, held).hint("rebalance", F.col("ano")), f"{path}/celulas", stale, column="ano", order=("ano", "bloco", "sigla"))
        found.coalesce(1).write.mode("overwrite").parquet(f"{path}/impressoes")
    return literal_rows(spark, states, "ano int, estado string")
