"""Composite queries in long form, over the whole series unless filters are the point."""

from __future__ import annotations

from catalog.q_aggregates import (
    BUCKETS, COHORT, KNOWN, MEMBERS, MONTHLY, OK_LENGTH, OK_START, RACE, SERIES_SQL, group_sql)
from catalog.q_sources import deaths
from catalog.register import (
    COMORBIDITIES, CURE, DEATH, DROPOUT, GROUPS, POPULATIONS, fold, label, n_if, pct, pct_min1, query, yes)
from catalog.views import area_dim, cases, every_year, years
from epispark.functions.filters import Filters
from epispark.plans import composites
from epispark.plans.batch import read_choices, read_history, write_choices, write_history
from epispark.session import scratch_dir

NONE = "CAST(NULL AS VARCHAR)"
NO_PCT = "CAST(NULL AS DOUBLE)"
CHOICES = {"sexo": "sexo", "formas": "forma", "racas": "raca_cor", "entradas": "tipo_entrada", "hiv": "status_hiv"}

META = " UNION ALL ".join(
    [f"SELECT DISTINCT 'anos' AS bloco, CAST(ano_notificacao AS VARCHAR) AS valor, {NONE} AS rotulo, {NONE} AS grupo FROM cases",
     f"SELECT 'ano_parcial', CAST(max(ano_notificacao) AS VARCHAR), {NONE}, {NONE} FROM cases"]
    + [f"SELECT DISTINCT '{k}', trim({c}), {NONE}, {NONE} FROM cases WHERE {c} IS NOT NULL" for k, c in CHOICES.items()]
    + ["SELECT 'ufs', sigla, nome, regiao FROM area_dim"]
    + [f"SELECT 'vulneraveis', '{c}', '{t}', {NONE}" for c, t in POPULATIONS.items()]
    + [f"SELECT 'agravos', '{c}', '{t}', {NONE}" for c, t in COMORBIDITIES.items()])


@query("meta", META)
def meta(spark, sf):
    return composites.meta(cases(spark, sf, "ano_notificacao", *CHOICES.values()), area_dim(spark, sf))


@query("meta_published", META)
def meta_published(spark, sf):
    path = scratch_dir(spark, "choices")
    rows = cases(spark, sf, "ano_notificacao", *CHOICES.values())
    write_choices(rows, path)
    return composites.meta(rows, area_dim(spark, sf), choices=read_choices(spark, path))


PLACE_ITEMS = {"casos": "count(*)", "cura_pct": pct(n_if(CURE), "count(*)"), "abandono_pct": pct(n_if(DROPOUT), "count(*)"),
               "obito_pct": pct(n_if(DEATH), "count(*)"), "hiv_pct": pct(n_if("status_hiv = 'Positivo'"), n_if(KNOWN))}
DETAIL = " UNION ALL ".join(
    [f"SELECT 'municipios' AS bloco, trim(municipio_notificacao) AS rotulo, {fold('municipio_notificacao')} AS nm_norm, '{k}' AS indicador, CAST({v} AS DOUBLE) AS valor FROM cases WHERE uf = 'N07' GROUP BY 2, 3"
     for k, v in PLACE_ITEMS.items()]
    + [f"SELECT 'kpis', {NONE}, {NONE}, '{k}', CAST({v} AS DOUBLE) FROM cases WHERE uf = 'N07'" for k, v in COHORT.items()])


@query("detalhe_uf", DETAIL)
def detalhe_uf(spark, sf):
    return composites.detalhe_uf(cases(spark, sf), area_dim(spark, sf), every_year(spark, sf), "N07")


@query("detalhe_uf_empty", " UNION ALL ".join(
    f"SELECT 'kpis' AS bloco, {NONE} AS rotulo, {NONE} AS nm_norm, '{k}' AS indicador, CAST({v} AS DOUBLE) AS valor FROM cases WHERE uf = 'N07' AND sexo = 'ninguém'"
    for k, v in COHORT.items()))
def detalhe_uf_empty(spark, sf):
    """A selection without cases still has the record of the area, all zero."""
    return composites.detalhe_uf(cases(spark, sf), area_dim(spark, sf), Filters(sexes=("ninguém",)), "N07")


def labels_sql(block: str, column: str) -> str:
    return f"SELECT '{block}' AS bloco, {label(column)} AS categoria, {NONE} AS grupo, CAST(count(*) AS DOUBLE) AS valor, {NO_PCT} AS pct FROM cases GROUP BY 2"


def cross_sql(block: str, category: str, where: str) -> str:
    return f"SELECT '{block}', categoria, grupo, CAST(n AS DOUBLE), pct FROM ({group_sql(category, where)})"


BAND_LIST = "(VALUES ('0-4'),('5-9'),('10-14'),('15-19'),('20-29'),('30-39'),('40-49'),('50-59'),('60-69'),('70-79'),('80+')) b(fx), (VALUES ('Masculino'), ('Feminino')) s(sx)"


def tower_sql(block: str, where: str) -> str:
    return f"SELECT '{block}', fx, sx, CAST((SELECT count(*) FROM cases WHERE faixa = fx AND sexo = sx AND {where}) AS DOUBLE), {NO_PCT} FROM {BAND_LIST}"


PROFILE = " UNION ALL ".join(
    [labels_sql(c, c) for c in ("sexo", "forma", "tipo_entrada", "escolaridade", "raca_cor", "desfecho")]
    + [labels_sql("desfecho_grupo", "grupo").replace("GROUP BY 2", "GROUP BY cases.grupo"), cross_sql("desfecho_por_raca", "trim(raca_cor)", RACE),
       tower_sql("piramide_casos", "true"), tower_sql("piramide_obitos", DEATH)])


@query("perfil", PROFILE)
def perfil(spark, sf):
    return composites.perfil(cases(spark, sf), area_dim(spark, sf), every_year(spark, sf))


POSITIVE = "status_hiv = 'Positivo'"
CLINICAL = " UNION ALL ".join(
    [labels_sql("status_hiv", "status_hiv"), labels_sql("baciloscopia", "baciloscopia_primeira_amostra"),
     labels_sql("teste_molecular", "teste_molecular"), cross_sql("desfecho_por_hiv", "status_hiv", KNOWN),
     f"SELECT 'coinfeccao_uf', uf, 'positivos', CAST({n_if(POSITIVE)} AS DOUBLE), {pct(n_if(POSITIVE), n_if(KNOWN))} FROM cases WHERE uf IS NOT NULL GROUP BY 2",
     f"SELECT 'coinfeccao_uf', uf, 'n_testado', CAST({n_if(KNOWN)} AS DOUBLE), {NO_PCT} FROM cases WHERE uf IS NOT NULL GROUP BY 2"]
    + [f"SELECT 'tempo_tratamento', '{k}', {NONE}, CAST({v} AS DOUBLE), {p} FROM cases WHERE {OK_START}" for k, v, p in (
        ("n", "count(*)", NO_PCT), ("mediana_inicio", "quantile_cont(espera, 0.5)", NO_PCT),
        ("ate_7d", n_if("espera <= 7"), pct(n_if("espera <= 7"), "count(*)")),
        ("acima_30d", n_if("espera > 30"), pct(n_if("espera > 30"), "count(*)")))]
    + [f"SELECT 'tempo_tratamento', 'duracao_mediana', {NONE}, quantile_cont(duracao, 0.5), {NO_PCT} FROM cases WHERE {OK_LENGTH}",
       f"SELECT 'histograma', b.faixa, {NONE}, CAST(count(espera) AS DOUBLE), {NO_PCT} FROM {BUCKETS} LEFT JOIN (SELECT espera FROM cases WHERE {OK_START}) c ON espera BETWEEN de AND ate GROUP BY 2"])


@query("clinico", CLINICAL)
def clinico(spark, sf):
    return composites.clinico(cases(spark, sf), area_dim(spark, sf), every_year(spark, sf))


COMORBID = " UNION ALL ".join(
    [f"SELECT 'total' AS bloco, 'total' AS categoria, {NONE} AS grupo, CAST(count(*) AS DOUBLE) AS valor, {NO_PCT} AS pct FROM cases"]
    + [f"SELECT '{b}', '{t}', {NONE}, CAST({n_if(yes(c))} AS DOUBLE), {pct_min1(n_if(yes(c)), 'count(*)')} FROM cases"
       for b, flags in (("agravos", COMORBIDITIES), ("populacoes", POPULATIONS)) for c, t in flags.items()]
    + [f"SELECT 'desfecho_por_vulneravel', categoria, g.grupo, CAST({n_if('c.grupo = g.grupo')} AS DOUBLE), round({n_if('c.grupo = g.grupo')} / count(*) * 100, 1) FROM ({MEMBERS}) c, {GROUPS} GROUP BY 2, 3"]
    + [f"SELECT 'heatmap_uf', uf, '{t}', CAST({n_if(yes(c))} AS DOUBLE), {pct(n_if(yes(c)), 'count(*)')} FROM cases WHERE uf IS NOT NULL GROUP BY 2"
       for c, t in COMORBIDITIES.items()])


@query("comorbidades", COMORBID)
def comorbidades(spark, sf):
    return composites.comorbidades(cases(spark, sf), area_dim(spark, sf), every_year(spark, sf))


@query("comorbidades_empty", " UNION ALL ".join(
    [f"SELECT 'total' AS bloco, 'total' AS categoria, {NONE} AS grupo, CAST(count(*) AS DOUBLE) AS valor, {NO_PCT} AS pct FROM cases WHERE sexo = 'ninguém'"]
    + [f"SELECT '{b}', '{t}', {NONE}, CAST({n_if(yes(c))} AS DOUBLE), {pct_min1(n_if(yes(c)), 'count(*)')} FROM cases WHERE sexo = 'ninguém'"
       for b, flags in (("agravos", COMORBIDITIES), ("populacoes", POPULATIONS)) for c, t in flags.items()]))
def comorbidades_empty(spark, sf):
    return composites.comorbidades(cases(spark, sf), area_dim(spark, sf), Filters(sexes=("ninguém",)))


_histories: dict[tuple[str, str], str] = {}


def stored_history(spark, sf) -> str:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _histories:
        path = scratch_dir(spark, "history")
        known = years(spark, sf)
        write_history(cases(spark, sf), area_dim(spark, sf), path, known[0], known[-1])
        _histories[key] = path
    return _histories[key]


FIRST, LAST = (f"(SELECT {f}(ano_notificacao) FROM cases)" for f in ("min", "max"))
CURRENT = f"ano_notificacao = {LAST} AND sexo = 'Feminino'"
BASE = f"nu_ano BETWEEN {FIRST} AND {LAST} - 1"
MONTH = "(['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez'])[CAST(m AS INTEGER)]"
AREA_BASE = f"(SELECT uf, avg(n) AS media FROM (SELECT ano_notificacao, uf, count(*) AS n FROM cases WHERE uf IS NOT NULL AND ano_notificacao BETWEEN {FIRST} AND {LAST} - 1 GROUP BY 1, 2) GROUP BY 1) b"
AREA_NOW = f"(SELECT uf, count(*) AS casos FROM cases WHERE {CURRENT} GROUP BY 1) a"
YEARLY = f"(SELECT avg(s) AS media, (SELECT count(*) FROM cases WHERE {CURRENT}) AS t FROM (SELECT nu_ano, sum(casos) AS s FROM {MONTHLY} WHERE {BASE} GROUP BY 1))"
TREND = " UNION ALL ".join([
    f"SELECT 'mensal' AS bloco, {MONTH} AS categoria, 'casos' AS indicador, CAST((SELECT count(*) FROM cases WHERE {CURRENT} AND mes = m) AS DOUBLE) AS valor FROM range(1, 13) t(m)",
    f"SELECT 'mensal', {MONTH}, 'media_hist', coalesce(round((SELECT avg(casos) FROM {MONTHLY} WHERE {BASE} AND mes_num = m), 0), 0) FROM range(1, 13) t(m)",
    f"SELECT 'kpis', 'ano', 'total_ano', CAST(t AS DOUBLE) FROM {YEARLY}", f"SELECT 'kpis', 'ano', 'media_anual_hist', round(media, 0) FROM {YEARLY}",
    f"SELECT 'kpis', 'ano', 'variacao_pct', round((t - media) / media * 100, 1) FROM {YEARLY}",
    f"SELECT 'estadual', b.uf, 'casos', CAST(coalesce(casos, 0) AS DOUBLE) FROM {AREA_BASE} LEFT JOIN {AREA_NOW} ON a.uf = b.uf",
    f"SELECT 'estadual', b.uf, 'media_hist', round(media, 0) FROM {AREA_BASE}",
    f"SELECT 'estadual', b.uf, 'variacao_pct', round((coalesce(casos, 0) - media) / media * 100, 1) FROM {AREA_BASE} LEFT JOIN {AREA_NOW} ON a.uf = b.uf",
    "SELECT 'anual', CAST(ano_notificacao AS VARCHAR), 'casos', CAST(count(*) AS DOUBLE) FROM cases GROUP BY 2",
    "SELECT 'obitos_anual', CAST(ano AS VARCHAR), 'obitos', CAST(sum(obitos) AS DOUBLE) FROM deaths GROUP BY 2",
    f"SELECT 'indicadores', CAST(nu_ano AS VARCHAR), indicador, valor FROM ({SERIES_SQL})"])


WOMEN = Filters(sexes=("Feminino",))


@query("tendencia", TREND)
def tendencia(spark, sf):
    """On a history that was written before, as a published one is; written once per application."""
    history, known = read_history(spark, stored_history(spark, sf)), years(spark, sf)
    return composites.tendencia(cases(spark, sf), area_dim(spark, sf), history, deaths(spark, sf), WOMEN.for_years(*known[-2:]), known[0])


@query("tendencia_without_history", " UNION ALL ".join([
    f"SELECT 'mensal' AS bloco, {MONTH} AS categoria, 'casos' AS indicador, CAST((SELECT count(*) FROM cases WHERE {CURRENT} AND mes = m) AS DOUBLE) AS valor FROM range(1, 13) t(m)",
    f"SELECT 'mensal', {MONTH}, 'media_hist', CAST(NULL AS DOUBLE) FROM range(1, 13) t(m)",
    f"SELECT 'kpis', 'ano', 'total_ano', CAST(count(*) AS DOUBLE) FROM cases WHERE {CURRENT}",
    "SELECT 'kpis', 'ano', 'media_anual_hist', 0.0", "SELECT 'kpis', 'ano', 'variacao_pct', CAST(NULL AS DOUBLE)"]))
def tendencia_without_history(spark, sf):
    known = years(spark, sf)
    return composites.tendencia(cases(spark, sf), area_dim(spark, sf), None, None, WOMEN.for_years(*known[-2:]), known[0])
