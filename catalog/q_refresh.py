"""Refresh of the years that changed, against full builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.q_aggregates import SERIES_SQL
from catalog.q_cells import KEYS
from catalog.q_composites import FIRST, LAST
from catalog.register import query
from catalog.views import append, area_dim, cases, years
from epispark.operators import history
from epispark.plans.batch import read_history
from epispark.plans.cells import read_cells
from epispark.plans.refresh import history_columns, refresh_history, year_fingerprints
from epispark.session import scratch_dir

PRINTED = ("ano_notificacao", "data_notificacao", "estado_notificacao", "raca_cor")
_PART = " || ".join(f"length({t}) || ':' || {t}" for t in (f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in sorted(PRINTED)))


@query("year_fingerprints", f"""SELECT ano_notificacao AS ano, count(*) AS linhas,
CAST(sum(CAST('0x' || substr(md5({_PART}), 1, 15) AS BIGINT)) AS VARCHAR) AS soma FROM cases GROUP BY 1""")
def fingerprints(spark, sf):
    return year_fingerprints(cases(spark, sf, *PRINTED))


def before_and_now(spark, sf, *columns):
    """The cases as an earlier extract had them, and as they are: the first year is new, the last one changed, the
    second has gone, one came in another order."""
    rows, known = cases(spark, sf, *columns), years(spark, sf)
    year, number = F.col("ano_notificacao"), F.col("case_id")
    return (rows.where((year != known[0]) & ~((year == known[-1]) & (number % 2 == 0))).orderBy(F.desc("case_id")), rows.where(year != known[1]))


def refreshed(spark, sf, cells=False):
    path, dim = scratch_dir(spark, "refresh"), area_dim(spark, sf)
    columns = () if cells else ("case_id", *history_columns())
    before, now = before_and_now(spark, sf, *columns)
    refresh_history(before, dim, path, cells=cells)
    return path, refresh_history(now, dim, path, cells=cells)


@query("refresh_states", f"""SELECT ano_notificacao AS ano, CASE WHEN ano_notificacao = {FIRST} THEN 'novo' WHEN ano_notificacao = {LAST} THEN 'alterado'
WHEN ano_notificacao = (SELECT min(ano_notificacao) FROM cases WHERE ano_notificacao > {FIRST}) THEN 'removido' ELSE 'igual' END AS estado FROM cases GROUP BY 1""")
def refresh_states(spark, sf):
    return refreshed(spark, sf)[1]


NOW = f", picked AS (SELECT * FROM cases WHERE ano_notificacao <> (SELECT min(ano_notificacao) FROM cases WHERE ano_notificacao > {FIRST})) "


@query("refresh_history", NOW + ("""SELECT 'anual' AS tabela, ano_notificacao AS nu_ano, CAST(NULL AS VARCHAR) AS chave, CAST(count(*) AS DOUBLE) AS valor FROM cases GROUP BY 2
UNION ALL SELECT 'estadual', ano_notificacao, uf, count(*) FROM cases WHERE uf IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'mensal', ano_notificacao, CAST(mes AS VARCHAR), count(*) FROM cases GROUP BY 2, 3
UNION ALL SELECT 'indicadores', nu_ano, indicador, valor FROM (""" + SERIES_SQL + ")").replace("FROM cases", "FROM picked cases"))
def merged_history(spark, sf):
    """History after a refresh that rebuilt three years of it: as a full build of the cases as they are."""
    h = read_history(spark, refreshed(spark, sf)[0])
    parts = [("anual", h["anual"], "string(NULL)", "casos"), ("estadual", h["estadual"], "uf_sigla", "casos"),
             ("mensal", h["mensal"], "string(mes_num)", "casos"), ("indicadores", history.indicator_series_long(h["indicadores"]), "indicador", "valor")]
    return append([t.selectExpr(f"'{n}' AS tabela", "nu_ano", f"{k} AS chave", f"double({v}) AS valor") for n, t, k, v in parts])


@query("refresh_cells", NOW + " UNION ALL ".join(
    f"SELECT '{block}' AS bloco, count(*) AS celulas, CAST(sum(n) AS BIGINT) AS casos, round(count(*) / sum(n) * 1000, 1) AS celulas_por_mil FROM "
    f"(SELECT count(*) AS n FROM picked cases GROUP BY ano_notificacao, uf, sexo, {keys})" for block, keys in KEYS.items()))
def merged_cells(spark, sf):
    """Cells after a refresh of three years."""
    return read_cells(spark, f"{refreshed(spark, sf, cells=True)[0]}/celulas").report()
