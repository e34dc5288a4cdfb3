"""Composites from published cells: the same twins as those from the cases."""

from __future__ import annotations

from dataclasses import replace

from catalog.q_aggregates import AREA_INPUT, SUMMARY_INPUT, area_sql, summary_sql
from catalog.q_composites import CLINICAL, COMORBID, DETAIL, PROFILE, TREND, WOMEN, stored_history
from catalog.q_requests import LATEST, picked
from catalog.q_sources import deaths
from catalog.register import ALL_YEARS, N_YEARS, query
from catalog.views import area_dim, cases, every_year, years
from epispark.functions.filters import Filters
from epispark.plans import composites
from epispark.plans.batch import read_history
from epispark.plans.cells import Cells, read_cells, write_cells
from epispark.session import scratch_dir

_paths: dict[tuple[str, str], str] = {}


def stored_cells(spark, sf) -> Cells:
    """The cells of all cases, written once per application and input, as published ones are."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _paths:
        path = scratch_dir(spark, "cells")
        write_cells(cases(spark, sf), area_dim(spark, sf), path, years(spark, sf))
        _paths[key] = path
    return read_cells(spark, _paths[key])


def given(spark, sf):
    return cases(spark, sf), area_dim(spark, sf)


WOMEN_ONLY = "sexo = 'Feminino'"


@query("cells_resumo", summary_sql(WOMEN_ONLY, N_YEARS, ALL_YEARS))
def resumo(spark, sf):
    return composites.resumo(*given(spark, sf), deaths(spark, sf), replace(every_year(spark, sf), sexes=("Feminino",)), cells=stored_cells(spark, sf))


@query("cells_resumo_no_year", summary_sql("true", 1, LATEST))
def resumo_no_year(spark, sf):
    return composites.resumo(*given(spark, sf), deaths(spark, sf), Filters(), cells=stored_cells(spark, sf))


@query("cells_resumo_not_held", summary_sql("status_hiv = 'Positivo'", N_YEARS, ALL_YEARS))
def resumo_not_held(spark, sf):
    """The cells do not hold the status as a filter, so the cases are read."""
    return composites.resumo(cases(spark, sf, *SUMMARY_INPUT), area_dim(spark, sf), deaths(spark, sf), replace(every_year(spark, sf), hiv=("Positivo",)), cells=stored_cells(spark, sf))


@query("cells_mapa", area_sql(N_YEARS, ALL_YEARS, where=WOMEN_ONLY))
def mapa(spark, sf):
    return composites.mapa(cases(spark, sf, "ano_notificacao", "sexo", *AREA_INPUT), area_dim(spark, sf), deaths(spark, sf),
                           replace(every_year(spark, sf), sexes=("Feminino",)), cells=stored_cells(spark, sf))


@query("cells_detalhe_uf", DETAIL)
def detalhe_uf(spark, sf):
    return composites.detalhe_uf(*given(spark, sf), every_year(spark, sf), "N07", cells=stored_cells(spark, sf))


SOME = tuple(f"N{k:02d}" for k in range(0, 20, 2))
_SOME = ", ".join(f"'{a}'" for a in SOME)
for _name, _build, _body in (("perfil", composites.perfil, PROFILE), ("clinico", composites.clinico, CLINICAL), ("comorbidades", composites.comorbidades, COMORBID)):
    query(f"cells_{_name}", _body)(
        lambda spark, sf, build=_build: build(*given(spark, sf), every_year(spark, sf), cells=stored_cells(spark, sf)))
    query(f"cells_{_name}_some", picked(_body, f"SELECT ano_notificacao FROM cases WHERE ano_notificacao IN ({LATEST})").replace(
        "picked AS (SELECT * FROM cases WHERE", f"picked AS (SELECT * FROM cases WHERE uf IN ({_SOME}) AND"))(
        lambda spark, sf, build=_build: build(*given(spark, sf), Filters(areas=(*SOME, "ZZ")), cells=stored_cells(spark, sf)))


@query("cells_tendencia", TREND)
def tendencia(spark, sf):
    known = years(spark, sf)
    return composites.tendencia(*given(spark, sf), read_history(spark, stored_history(spark, sf)), deaths(spark, sf),
                                WOMEN.for_years(*known[-2:]), known[0], cells=stored_cells(spark, sf))


KEYS = {"sexo": "sexo", "forma": "forma", "tipo_entrada": "tipo_entrada", "escolaridade": "escolaridade", "raca": "raca_cor, situacao_encerramento",
        "idade": "CASE WHEN sexo IN ('Masculino', 'Feminino') THEN faixa END, coalesce(situacao_encerramento IN ('Óbito por TB', 'Obito por TB'), false)",
        "hiv": "status_hiv, situacao_encerramento", "baciloscopia": "baciloscopia_primeira_amostra", "teste_molecular": "teste_molecular",
        "espera": "CASE WHEN espera BETWEEN 0 AND 365 THEN espera END", "duracao": "CASE WHEN desfecho <> 'Em acompanhamento' AND duracao BETWEEN 1 AND 1000 THEN duracao END",
        "situacao": "tipo_entrada, situacao_encerramento, status_hiv",
        "lugar": "tipo_entrada, situacao_encerramento, status_hiv, municipio_notificacao", "mes": "mes", "agravos": "situacao_encerramento"}


@query("cells_report", " UNION ALL ".join(
    f"SELECT '{block}' AS bloco, count(*) AS celulas, CAST(sum(n) AS BIGINT) AS casos, round(count(*) / sum(n) * 1000, 1) AS celulas_por_mil FROM "
    f"(SELECT count(*) AS n FROM cases GROUP BY ano_notificacao, uf, sexo, {keys})" for block, keys in KEYS.items()))
def report(spark, sf):
    """How many cells a thousand cases have, by block."""
    return stored_cells(spark, sf).report()
