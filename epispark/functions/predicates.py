"""Row conditions used by the indicators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from epispark.spec import TB, CaseSpec

# Plausible days from diagnosis to treatment, and from notification to closure.
PLAUSIBLE_START = (0, 365)
PLAUSIBLE_DURATION = (1, 1000)
PLAUSIBLE_DURATION_LEGACY = (0, 1095)


def plausible(days: Column, limits: tuple[int, int] = PLAUSIBLE_START) -> Column:
    return days.between(*limits)


def cause_prefix(cause: Column, prefix: str = "A1") -> Column:
    return cause.startswith(prefix)


def has_residence(code: Column) -> Column:
    return code.isNotNull() & (F.length(F.trim(code)) >= 2)


def new_pulmonary() -> Column:
    """Coded extract: new pulmonary case with a valid outcome (a null outcome fails)."""
    return (F.col("forma").isin("1", "3") & F.col("tratamento").isin("1", "4", "6")
            & ~F.col("situa_ence").isin("7", " 7"))


def lab_positive() -> Column:
    tests = [F.col(c) == "1" for c in ("bacilosc_e", "bacilos_e2", "bacilosc_o", "cultura_es")]
    out = F.col("test_molec").isin("1", "2")
    for test in tests:
        out = out | test
    return out


def lab_confirmed_new_pulmonary() -> Column:
    return new_pulmonary() & lab_positive()


def known_status(spec: CaseSpec = TB) -> Column:
    return F.col(spec.hiv).isin(spec.positive, spec.negative)


def incident(spec: CaseSpec = TB) -> Column:
    return F.col(spec.entry).isin(*spec.incidence_entries)


def before_current_year(year: Column, as_of_year: int) -> Column:
    """Drops the running, incomplete year. The date is a parameter, never the clock."""
    return year < as_of_year


def baseline_years(year: Column, first: int, reference: int) -> Column:
    return year.between(first, reference - 1)


def incomplete_month(year: Column, month: Column, as_of) -> Column:
    return (year == as_of.year) & (month == as_of.month)
