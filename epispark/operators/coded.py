"""Indicators on the coded (text) extract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.functions.clean import digits_only
from epispark.functions.measures import pct1_min1
from epispark.functions.predicates import lab_confirmed_new_pulmonary, new_pulmonary
from epispark.operators.areas import n_if

# Years of the older rule, which a caller passes.
LEGACY_YEARS = ("2001", "2025")


def _by_year(df: DataFrame, years: tuple[str, str] | None) -> DataFrame:
    return df.where(F.col("nu_ano").between(*years)) if years else df


def lab_confirmation_series(df: DataFrame, years: tuple[str, str] | None = None) -> DataFrame:
    """Laboratory-confirmed share of the new pulmonary cases, per year."""
    by = _by_year(df, years).groupBy("nu_ano").agg(
        n_if(new_pulmonary(), "pulm_total"), n_if(lab_confirmed_new_pulmonary(), "pulm_conf_lab"))
    return (by.withColumn("nu_ano", F.col("nu_ano").try_cast("int")).where(F.col("nu_ano").isNotNull())
            .withColumn("pct_pulm_conf_lab", pct1_min1(F.col("pulm_conf_lab"), F.col("pulm_total"))))


def contacts_examined_series(df: DataFrame, years: tuple[str, str] | None = None) -> DataFrame:
    """Examined over identified contacts of confirmed cases, per year; rows whose counts are
    not all digits are left out."""
    rows = _by_year(df, years).where(
        lab_confirmed_new_pulmonary() & digits_only(F.col("nu_contato")) & digits_only(F.col("nu_comu_ex")))
    by = rows.groupBy("nu_ano").agg(F.sum(F.col("nu_contato").try_cast("double")).alias("contatos_id"),
                                    F.sum(F.col("nu_comu_ex").try_cast("double")).alias("contatos_exam"))
    whole = F.when(F.col("contatos_id") == 0, F.lit(1.0)).otherwise(F.col("contatos_id"))
    return (by.withColumn("nu_ano", F.col("nu_ano").try_cast("int")).where(F.col("nu_ano").isNotNull())
            .withColumn("pct_contatos_exam", F.round(F.col("contatos_exam") / whole * 100.0, 1)))


def join_indicator_series(annual: DataFrame, *series: DataFrame) -> DataFrame:
    """Annual indicators with further per-year series attached on ``nu_ano``."""
    for s in series:
        annual = annual.join(s, "nu_ano", "left")
    return annual
