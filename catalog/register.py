"""Name -> (Spark query, SQL twin)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.views import sql
from epispark.presets import tuberculosis as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Years of the cases, and their number, in the twins.
ALL_YEARS = "SELECT DISTINCT ano_notificacao FROM cases"
N_YEARS = "(SELECT count(DISTINCT ano_notificacao) FROM cases)"


def query(name: str, body: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if body is not None:
            ORACLES[name] = sql(body)
        return fn
    return add


def pct(n: str, d: str) -> str:
    """SQL percentage, 0.0 over an empty whole."""
    return f"round(coalesce(CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0), 0) * 100, 1)"


def pct_min1(n: str, d: str) -> str:
    return f"round(CAST({n} AS DOUBLE) / greatest(CAST({d} AS DOUBLE), 1) * 100, 1)"


def rate(n: str, pop: str, years: int | str) -> str:
    return f"round(coalesce(CAST({n} AS DOUBLE) / nullif(CAST({pop} AS DOUBLE) * {years}, 0), 0) * 100000, 1)"


def n_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def total(expr: str) -> str:
    return f"CAST(sum({expr}) AS BIGINT)"


# SQL label clean-up, and accent folding to a key.
WS = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' '"


def fold(expr: str) -> str:
    return f"trim(lower(regexp_replace(strip_accents({expr}), '[^\\x00-\\x7F]', '', 'g')), {WS})"


def label(expr: str) -> str:
    return (f"CASE WHEN {expr} IS NULL OR lower(trim({expr})) IN ('nan', 'none', 'undefined', '') "
            f"OR lower(strip_accents(trim({expr}))) = 'nao informado' THEN 'Não informado' ELSE trim({expr}) END")


# Fixed values of the preset as SQL conditions.
DEATH = "desfecho = 'Óbito por TB'"
CURE = "desfecho = 'Cura'"
DROPOUT = "desfecho IN ('Abandono', 'Abandono Primário')"
CLOSED = "desfecho <> 'Em acompanhamento'"
INCIDENT = "tipo_entrada IN ('Caso Novo', 'Não Sabe', 'Nao Sabe', 'Pós-óbito', 'Pos-obito')"
RETREATED = "tipo_entrada IN ('Recidiva', 'Reingresso após Abandono', 'Reingresso Após Abandono')"
KNOWN = "status_hiv IN ('Positivo', 'Negativo')"
GROUPS = "(VALUES ('Cura'), ('Interrupção'), ('Óbito'), ('Não avaliado')) g(grupo)"
COMORBIDITIES, POPULATIONS = tb.COMORBIDITIES, tb.POPULATIONS


def yes(column: str) -> str:
    return f"lower({column}) = 'sim'"
