"""Waiting times. Rows are first counted per day, so every statistic below works on a table
of at most a few hundred rows whatever the number of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.functions.clean import band, band_grid, clip_upper, is_closed, wait_days
from epispark.functions.measures import pct1
from epispark.functions.predicates import PLAUSIBLE_DURATION, PLAUSIBLE_START, plausible
from epispark.operators.counts import zero_fill
from epispark.spec import TB, CaseSpec


def start_wait(spec: CaseSpec = TB):
    return wait_days(F.col(spec.diagnosed), F.col(spec.started))


def duration(spec: CaseSpec = TB):
    return wait_days(F.col(spec.date), F.col(spec.closed))


def days_histogram(df: DataFrame, days, limits: tuple[int, int]) -> DataFrame:
    """(dias, n) of the plausible waits; at most ``limits`` wide."""
    rows = df.select(days.alias("dias")).where(plausible(F.col("dias"), limits))
    return rows.groupBy("dias").agg(F.count(F.lit(1)).alias("n"))


def start_histogram(df: DataFrame, spec: CaseSpec = TB) -> DataFrame:
    return days_histogram(df, start_wait(spec), PLAUSIBLE_START)


def duration_histogram(df: DataFrame, spec: CaseSpec = TB, limits: tuple[int, int] = PLAUSIBLE_DURATION,
                       closed_only: bool = True) -> DataFrame:
    rows = df.where(is_closed(spec)) if closed_only else df
    return days_histogram(rows, duration(spec), limits)


def median_of(approximate: bool = False):
    """Median of a (dias, n) table: exact, or a sketch for continuous values."""
    if approximate:
        return F.approx_percentile("dias", 0.5, 10000).cast("double")
    return F.percentile("dias", 0.5, F.col("n")).cast("double")


def wait_stats(histogram: DataFrame) -> DataFrame:
    """(n, mediana_inicio, pct_ate_7d, pct_acima_30d); no row when nothing is plausible."""
    s = histogram.agg(F.sum("n").alias("n"), median_of().alias("mediana_inicio"),
                      F.sum(F.when(F.col("dias") <= 7, F.col("n")).otherwise(0)).alias("_ate"),
                      F.sum(F.when(F.col("dias") > 30, F.col("n")).otherwise(0)).alias("_acima"))
    return s.where(F.col("n") > 0).select(
        "n", "mediana_inicio", pct1(F.col("_ate"), F.col("n")).alias("pct_ate_7d"),
        pct1(F.col("_acima"), F.col("n")).alias("pct_acima_30d"))


def wait_histogram(histogram: DataFrame, spec: CaseSpec = TB) -> DataFrame:
    """(faixa, casos) over the seven buckets, empty ones included."""
    counts = (histogram.groupBy(band("dias", spec.wait_buckets).alias("faixa"))
              .agg(F.sum("n").alias("casos")))
    return zero_fill(counts, band_grid(histogram.sparkSession, spec.wait_buckets), ["casos"])


def wait_histogram_daily(histogram: DataFrame, limit: int = 30) -> DataFrame:
    """(dias, casos) for 0..limit; the last bin pools everything from ``limit`` up."""
    counts = histogram.groupBy(clip_upper(F.col("dias"), limit).alias("dias")).agg(F.sum("n").alias("casos"))
    grid = histogram.sparkSession.range(limit + 1).select(F.col("id").cast("int").alias("dias"))
    return zero_fill(counts, grid, ["casos"])


def duration_median(histogram: DataFrame) -> DataFrame:
    return histogram.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), median_of().alias("duracao_mediana"))


def wait_median_approx(df: DataFrame, spec: CaseSpec = TB) -> DataFrame:
    """Sketch-based median straight from the rows, for columns with too many distinct values."""
    days = start_wait(spec)
    rows = df.select(days.alias("dias")).where(plausible(F.col("dias"), PLAUSIBLE_START))
    return rows.agg(median_of(approximate=True).alias("mediana_inicio"))
