"""Ratios, rates and change measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("double")


def pct1(part, whole) -> Column:
    """Percentage with one decimal; 0.0 over an empty whole."""
    ratio = F.try_divide(_double(part), _double(whole)) * 100.0
    return F.round(F.coalesce(ratio, F.lit(0.0)), 1)


def pct1_min1(part, whole) -> Column:
    """Percentage with one decimal over ``max(whole, 1)``."""
    return F.round(_double(part) / F.greatest(_double(whole), F.lit(1.0)) * 100.0, 1)


def pct1_sql(part: str, whole: str) -> str:
    """``pct1`` as SQL text, for rows assembled in SQL."""
    return f"round(coalesce(try_divide(double({part}), double({whole})) * 100D, 0D), 1)"


def pct1_min1_sql(part: str, whole: str) -> str:
    return f"round(double({part}) / greatest(double({whole}), 1D) * 100D, 1)"


def rate_per_100k(events, population, years: int = 1) -> Column:
    """Annualised rate per 100,000; 0.0 without a population."""
    ratio = F.try_divide(_double(events), _double(population) * float(max(years, 1))) * 100000.0
    return F.round(F.coalesce(ratio, F.lit(0.0)), 1)


def variation_pct(current, base, decimals: int | None = 1) -> Column:
    """Percent change against a base; null over a zero base."""
    change = F.try_divide(_double(current) - _double(base), _double(base)) * 100.0
    return change if decimals is None else F.round(change, decimals)


def direction(variation: Column, limit: float = 5.0) -> Column:
    return (F.when(variation.isNull(), F.lit("Sem histórico"))
            .when(variation > limit, F.lit("Para mais"))
            .when(variation < -limit, F.lit("Para menos"))
            .otherwise(F.lit("Estável")))


def delta_vs_previous(current: Column, previous: Column, good_when_up: bool = False) -> tuple[Column, Column]:
    """(change %, 'good' | 'bad' | 'flat'); both null without a usable previous value."""
    change = variation_pct(current, previous, None)
    good = (change > 0) if good_when_up else (change <= 0)
    status = (F.when(change.isNull(), F.lit(None).cast("string"))
              .when(F.abs(change) < 0.1, F.lit("flat"))
              .when(good, F.lit("good")).otherwise(F.lit("bad")))
    return F.round(change, 1), status


def cure_target(pct: Column, goal: float = 85.0) -> Column:
    return pct >= goal


def dropout_breach(pct: Column, limit: float = 5.0) -> Column:
    return pct >= limit
