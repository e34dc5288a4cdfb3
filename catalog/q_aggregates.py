"""Aggregations and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.q_joins import area_history, current_by_area
from catalog.q_sources import deaths
from catalog.register import (
    ALL_YEARS, CLOSED, COMORBIDITIES, CURE, DEATH, DROPOUT, GROUPS, INCIDENT, KNOWN, N_YEARS, POPULATIONS, RETREATED,
    fold, label, n_if, pct, pct_min1, query, rate, yes)
from catalog.views import FIRST_YEAR, REFERENCE_YEAR, append, area_dim, cases, coded, every_year, registry, table, years
from epispark.functions.clean import with_outcome
from epispark.functions.filters import Filters
from epispark.operators import areas, coded as lab, counts, diagnostics, history, kpis, outcomes, waits
from epispark.operators import registry as reg
from epispark.plans import composites
from epispark.plans.batch import history_counts_long, history_tables, read_history, write_history
from epispark.presets import tuberculosis as tb
from epispark.session import scratch_dir
from epispark.spec import TB

AREA_INPUT = ("estado_notificacao", "tipo_entrada", "situacao_encerramento")
PLACE_INPUT = ("estado_notificacao", "municipio_notificacao", "situacao_encerramento", "status_hiv")
SUMMARY_INPUT = ("ano_notificacao", *PLACE_INPUT, "tipo_entrada", "sexo")
PROFILE = ("sexo", "forma", "tipo_entrada", "raca_cor", "escolaridade")


@query("value_counts", f"SELECT {label('forma')} AS label, count(*) AS valor FROM cases GROUP BY 1")
def value_counts(spark, sf):
    return counts.value_counts(cases(spark, sf, "forma"), "forma")


@query("multi_value_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS dimensao, {label(c)} AS label, count(*) AS valor FROM cases GROUP BY 2" for c in PROFILE))
def multi_value_counts(spark, sf):
    return counts.multi_value_counts(cases(spark, sf, *PROFILE), PROFILE)


@query("conditional_counts", f"""SELECT count(*) AS total, {n_if(CURE)} AS cura, {n_if(DROPOUT)} AS abandono, {n_if(DEATH)} AS obito_tb,
{n_if("status_hiv = 'Positivo'")} AS hiv_pos, {n_if(INCIDENT)} AS casos_novos FROM cases""")
def conditional_counts(spark, sf):
    return kpis.conditional_counts(cases(spark, sf, "situacao_encerramento", "status_hiv", "tipo_entrada"))


@query("distinct_count", "SELECT count(DISTINCT municipio_notificacao) AS municipios FROM cases")
def distinct_count(spark, sf):
    return counts.distinct_places(cases(spark, sf, "municipio_notificacao"))


@query("distinct_count_by_area", "SELECT count(DISTINCT uf || '|' || municipio_notificacao) AS municipios FROM cases")
def distinct_count_by_area(spark, sf):
    return counts.distinct_places(cases(spark, sf, "municipio_notificacao", "estado_notificacao"), dim=area_dim(spark, sf))


@query("population_at_risk", """SELECT (SELECT CAST(sum(populacao) AS BIGINT) FROM area_dim) AS todas,
(SELECT CAST(sum(populacao) AS BIGINT) FROM area_dim WHERE sigla IN ('N01', 'N02')) AS duas,
(SELECT CAST(sum(populacao) AS BIGINT) FROM area_dim) AS desconhecida""")
def population_at_risk(spark, sf):
    dim = area_dim(spark, sf)
    return spark.range(1).select(dim.population_at_risk().alias("todas"), dim.population_at_risk(("N01", "N02")).alias("duas"),
                                 dim.population_at_risk(("ZZ",)).alias("desconhecida"))


@query("incidence_rate", f"SELECT n AS casos_novos, p AS populacao, {rate('n', 'p', N_YEARS)} AS incidencia FROM (SELECT {n_if(INCIDENT)} AS n, (SELECT CAST(sum(populacao) AS BIGINT) FROM area_dim) AS p FROM cases)")
def incidence_rate(spark, sf):
    return kpis.incidence_rate(cases(spark, sf, *SUMMARY_INPUT), area_dim(spark, sf), every_year(spark, sf))


@query("incidence_rate_mapped", f"SELECT n AS casos_novos, p AS populacao, {rate('n', 'p', N_YEARS)} AS incidencia FROM (SELECT {n_if(INCIDENT + ' AND uf IS NOT NULL')} AS n, (SELECT CAST(sum(populacao) AS BIGINT) FROM area_dim) AS p FROM cases)")
def incidence_rate_mapped(spark, sf):
    return kpis.incidence_rate(cases(spark, sf, *SUMMARY_INPUT), area_dim(spark, sf), every_year(spark, sf), mapped_only=True)


def summary_sql(where: str, years: int | str, year_list: str, areas_cond: str = "true", pop_cond: str = "true") -> str:
    return f"""SELECT total, total_base, {pct('total', 'total_base')} AS pct_filtrado, cura, abandono,
CASE WHEN sim > 0 THEN sim ELSE mortes END AS obitos, CASE WHEN sim > 0 THEN 'SIM' ELSE 'SINAN' END AS fonte_obitos,
hiv_pos, municipios, {rate('novos', 'pop', years)} AS incidencia, {rate('CASE WHEN sim > 0 THEN sim ELSE mortes END', 'pop', years)} AS mortalidade
FROM (SELECT {n_if(where)} AS total, count(*) AS total_base, {n_if(f'{where} AND {CURE}')} AS cura, {n_if(f'{where} AND {DROPOUT}')} AS abandono,
{n_if(f'{where} AND {DEATH}')} AS mortes, {n_if(f"{where} AND status_hiv = 'Positivo'")} AS hiv_pos,
count(DISTINCT CASE WHEN {where} THEN municipio_notificacao END) AS municipios, {n_if(f'{where} AND {INCIDENT}')} AS novos,
(SELECT CAST(coalesce(sum(obitos), 0) AS BIGINT) FROM deaths WHERE ano IN ({year_list}) AND {areas_cond}) AS sim,
(SELECT CAST(sum(populacao) AS BIGINT) FROM area_dim WHERE {pop_cond}) AS pop FROM cases WHERE ano_notificacao IN ({year_list}))"""


@query("summary_kpis", summary_sql("true", N_YEARS, ALL_YEARS))
def summary_kpis(spark, sf):
    return kpis.summary_kpis(cases(spark, sf, *SUMMARY_INPUT), area_dim(spark, sf), deaths(spark, sf), every_year(spark, sf))


SOME = Filters(years=(1999, 2000), areas=("N01", "N07"), sexes=("Feminino",))


@query("resumo", summary_sql("uf IN ('N01', 'N07') AND sexo = 'Feminino'", 2, "1999, 2000", "uf IN ('N01', 'N07')", "sigla IN ('N01', 'N07')"))
def resumo(spark, sf):
    return composites.resumo(cases(spark, sf, *SUMMARY_INPUT), area_dim(spark, sf), deaths(spark, sf), SOME)


@query("resumo_with_history", summary_sql("uf IN ('N01', 'N07') AND sexo = 'Feminino'", 2, "1999, 2000", "uf IN ('N01', 'N07')", "sigla IN ('N01', 'N07')"))
def resumo_with_history(spark, sf):
    annual = history.history_annual(cases(spark, sf, "ano_notificacao"))
    return composites.resumo(cases(spark, sf, *SUMMARY_INPUT), area_dim(spark, sf), deaths(spark, sf), SOME, annual=annual)


@query("resumo_without_registry", summary_sql("uf IN ('N01', 'N07') AND sexo = 'Feminino'", 2, "1999, 2000", "false", "sigla IN ('N01', 'N07')"))
def resumo_without_registry(spark, sf):
    return composites.resumo(cases(spark, sf, *SUMMARY_INPUT), area_dim(spark, sf), None, SOME)


@query("mortality_rate", f"SELECT obitos, fonte_obitos, mortalidade FROM ({summary_sql('true', N_YEARS, ALL_YEARS)})")
def mortality_rate(spark, sf):
    return kpis.mortality_rate(cases(spark, sf, *SUMMARY_INPUT), area_dim(spark, sf), deaths(spark, sf), every_year(spark, sf))


@query("mortality_rate_fallback", f"""SELECT m AS obitos, 'SINAN' AS fonte_obitos, {rate('m', 'p', N_YEARS)} AS mortalidade
FROM (SELECT {n_if(DEATH)} AS m, (SELECT sum(populacao) FROM area_dim) AS p FROM cases)""")
def mortality_rate_fallback(spark, sf):
    """A registry without rows for these years."""
    none = deaths(spark, sf).withColumn("ano", F.col("ano") - 100)
    return kpis.mortality_rate(cases(spark, sf, *SUMMARY_INPUT), area_dim(spark, sf), none, every_year(spark, sf))


def area_sql(years: int | str, year_list: str, official: bool = True, where: str = "true") -> str:
    return f"""SELECT c.uf, nome, casos, casos_novos, {'coalesce(n, 0)' if official else 'mortes'} AS obitos,
{rate('casos_novos', 'populacao', years)} AS incidencia, {rate('coalesce(n, 0)' if official else 'mortes', 'populacao', years)} AS mortalidade,
{pct('cura', 'casos')} AS cura_pct, {pct('abandono', 'casos')} AS abandono_pct, '{'SIM' if official else 'SINAN'}' AS fonte_obitos
FROM (SELECT uf, count(*) AS casos, {n_if(INCIDENT)} AS casos_novos, {n_if(DEATH)} AS mortes, {n_if(CURE)} AS cura, {n_if(DROPOUT)} AS abandono
FROM cases WHERE uf IS NOT NULL AND ano_notificacao IN ({year_list}) AND {where} GROUP BY 1) c JOIN area_dim ON sigla = c.uf
LEFT JOIN (SELECT uf, CAST(sum(obitos) AS BIGINT) AS n FROM deaths WHERE ano IN ({year_list}) GROUP BY 1) d ON d.uf = c.uf"""


@query("area_indicators", area_sql(N_YEARS, ALL_YEARS))
def area_indicators(spark, sf):
    rows = cases(spark, sf, "ano_notificacao", *AREA_INPUT)
    return areas.area_indicators(rows, area_dim(spark, sf), deaths(spark, sf), years(spark, sf))


@query("area_indicators_fallback", area_sql(N_YEARS, ALL_YEARS, official=False))
def area_indicators_fallback(spark, sf):
    none = deaths(spark, sf).withColumn("ano", F.col("ano") - 100)
    return areas.area_indicators(cases(spark, sf, *AREA_INPUT), area_dim(spark, sf), none, years(spark, sf))


@query("mapa", area_sql(2, "1999, 2000", where="sexo = 'Feminino'"))
def mapa(spark, sf):
    rows = cases(spark, sf, "ano_notificacao", "sexo", *AREA_INPUT)
    return composites.mapa(rows, area_dim(spark, sf), deaths(spark, sf), Filters(years=(1999, 2000), sexes=("Feminino",)))


@query("area_indicators_legacy", f"""SELECT c.uf, casos, casos_novos, coalesce(n, 0) AS obitos, populacao,
round(casos_novos / (populacao::DOUBLE * {N_YEARS}) * 100000, 1) AS incidencia, round(coalesce(n, 0) / (populacao::DOUBLE * {N_YEARS}) * 100000, 1) AS mortalidade
FROM (SELECT coalesce(uf, '?') AS uf, count(*) AS casos, {n_if("tipo_entrada IN ('Caso Novo', 'Não Sabe', 'Pós-óbito')")} AS casos_novos FROM cases GROUP BY 1) c
LEFT JOIN area_dim ON sigla = c.uf LEFT JOIN (SELECT uf, CAST(sum(obitos) AS BIGINT) AS n FROM deaths WHERE ano IN ({ALL_YEARS}) GROUP BY 1) d ON d.uf = c.uf""")
def area_indicators_legacy(spark, sf):
    return areas.area_indicators_legacy(cases(spark, sf, *AREA_INPUT), area_dim(spark, sf), deaths(spark, sf), years(spark, sf))


@query("municipality_indicators", f"""SELECT uf, municipio, {fold('municipio')} AS nm_norm, casos, cura_pct, abandono_pct, obito_pct, hiv_pct FROM (
SELECT uf, trim(municipio_notificacao) AS municipio, count(*) AS casos, {pct(n_if(CURE), 'count(*)')} AS cura_pct,
{pct(n_if(DROPOUT), 'count(*)')} AS abandono_pct, {pct(n_if(DEATH), 'count(*)')} AS obito_pct,
{pct(n_if("status_hiv = 'Positivo'"), n_if(KNOWN))} AS hiv_pct FROM cases WHERE uf IS NOT NULL GROUP BY 1, 2)""")
def municipality_indicators(spark, sf):
    return areas.municipality_indicators(cases(spark, sf, *PLACE_INPUT), area_dim(spark, sf))


@query("municipality_pct_legacy", f"""SELECT uf, {fold('municipio_notificacao')} AS municipio_norm, count(*) AS casos,
{pct(n_if(CURE), 'count(*)')} AS cura, {pct(n_if("desfecho = 'Abandono'"), 'count(*)')} AS abandono, {pct(n_if(DEATH), 'count(*)')} AS obitos,
{pct(n_if("status_hiv = 'Positivo'"), 'count(*)')} AS hiv_pos FROM cases WHERE uf IS NOT NULL GROUP BY 1, 2""")
def municipality_pct_legacy(spark, sf):
    return areas.municipality_pct_legacy(cases(spark, sf, *PLACE_INPUT), area_dim(spark, sf))


NEW = "tipo_entrada = 'Caso Novo'"
COHORT = {
    "total": "count(*)", "total_municipios": "count(DISTINCT trim(municipio_notificacao))", "encerrados": n_if(CLOSED),
    "cura_pct": pct_min1(n_if(CURE), n_if(CLOSED)), "abandono_pct": pct_min1(n_if(DROPOUT), n_if(CLOSED)),
    "obito_pct": pct_min1(n_if(DEATH), n_if(CLOSED)),
    "cura_novo_pct": pct_min1(n_if(f"{NEW} AND {CURE}"), n_if(f"{NEW} AND {CLOSED}")), "n_enc_novo": n_if(f"{NEW} AND {CLOSED}"),
    "cura_retrat_pct": pct_min1(n_if(f"{RETREATED} AND {CURE}"), n_if(f"{RETREATED} AND {CLOSED}")),
    "n_enc_retrat": n_if(f"{RETREATED} AND {CLOSED}"),
    "hiv_pct": pct_min1(n_if("status_hiv = 'Positivo'"), n_if(KNOWN)), "n_hiv_conhecido": n_if(KNOWN),
}


@query("cohort_kpis", "SELECT uf, " + ", ".join(f"{v} AS {k}" for k, v in COHORT.items()) + " FROM cases WHERE uf IS NOT NULL GROUP BY 1")
def cohort_kpis(spark, sf):
    return areas.cohort_kpis(cases(spark, sf, *PLACE_INPUT, "tipo_entrada"), area_dim(spark, sf))


BANDS = "(VALUES (0,'0-4'),(1,'5-9'),(2,'10-14'),(3,'15-19'),(4,'20-29'),(5,'30-39'),(6,'40-49'),(7,'50-59'),(8,'60-69'),(9,'70-79'),(10,'80+')) b(ordem, faixa)"
BANDS17 = "(SELECT CAST(i AS INTEGER) AS ordem, CASE WHEN i = 16 THEN '80+' ELSE CAST(i * 5 AS VARCHAR) || '-' || CAST(i * 5 + 4 AS VARCHAR) END AS faixa FROM range(17) t(i)) b"


def pyramid_sql(bands: str = BANDS, column: str = "faixa", where: str = "true") -> str:
    return f"""SELECT b.ordem, b.faixa, coalesce(m, 0) AS masculino, coalesce(f, 0) AS feminino FROM {bands} LEFT JOIN (
SELECT {column} AS fx, {n_if("sexo = 'Masculino'")} AS m, {n_if("sexo = 'Feminino'")} AS f FROM cases WHERE {where} GROUP BY 1) c ON c.fx = b.faixa"""


AGED = ("idade_anos", "sexo", "situacao_encerramento")


@query("age_sex_pyramid", pyramid_sql())
def age_sex_pyramid(spark, sf):
    return outcomes.age_sex_pyramid(cases(spark, sf, *AGED))


@query("age_sex_pyramid_deaths", pyramid_sql(where=DEATH))
def age_sex_pyramid_deaths(spark, sf):
    return outcomes.age_sex_pyramid(cases(spark, sf, *AGED), deaths_only=True)


@query("age_sex_pyramid_17", pyramid_sql(BANDS17, "faixa17"))
def age_sex_pyramid_17(spark, sf):
    return outcomes.age_sex_pyramid(cases(spark, sf, *AGED), bands=tb.AGE_BANDS_17)


def group_sql(category: str, where: str) -> str:
    return f"""SELECT categoria, g.grupo, {n_if('c.grupo = g.grupo')} AS n, count(*) AS total,
round({n_if('c.grupo = g.grupo')} / count(*) * 100, 1) AS pct FROM (SELECT {category} AS categoria, grupo FROM cases WHERE {where}) c, {GROUPS} GROUP BY 1, 2"""


RACE = "raca_cor IS NOT NULL AND trim(raca_cor) <> 'Nao informado'"


@query("outcome_group_by", group_sql("trim(raca_cor)", RACE))
def outcome_group_by(spark, sf):
    return outcomes.outcome_group_by(cases(spark, sf, "raca_cor", "situacao_encerramento"), "raca_cor")


@query("outcome_group_by_hiv", group_sql("status_hiv", KNOWN))
def outcome_group_by_hiv(spark, sf):
    return outcomes.outcome_group_by(cases(spark, sf, "status_hiv", "situacao_encerramento"), "status_hiv", only=("Positivo", "Negativo"))


@query("positivity_by_area", f"SELECT uf, {pct(n_if(chr(39).join(['status_hiv = ', 'Positivo', ''])), n_if(KNOWN))} AS pct, {n_if(KNOWN)} AS n_testado FROM cases WHERE uf IS NOT NULL GROUP BY 1")
def positivity_by_area(spark, sf):
    return areas.positivity_by_area(cases(spark, sf, "estado_notificacao", "status_hiv"), area_dim(spark, sf))


START = ("data_diagnostico", "data_inicio_tratamento")
LENGTH = ("data_notificacao", "data_encerramento", "situacao_encerramento")
OK_START = "espera BETWEEN 0 AND 365"
OK_LENGTH = f"duracao BETWEEN 1 AND 1000 AND {CLOSED}"


@query("wait_stats", f"""SELECT n, mediana_inicio, {pct('a', 'n')} AS pct_ate_7d, {pct('b', 'n')} AS pct_acima_30d FROM (
SELECT count(*) AS n, quantile_cont(espera, 0.5) AS mediana_inicio, {n_if('espera <= 7')} AS a, {n_if('espera > 30')} AS b FROM cases WHERE {OK_START}) WHERE n > 0""")
def wait_stats(spark, sf):
    return waits.wait_stats(waits.start_histogram(cases(spark, sf, *START)))


@query("wait_stats_none", f"""SELECT count(*) AS n, quantile_cont(espera, 0.5) AS mediana_inicio, {pct(n_if("espera <= 7"), "count(*)")} AS pct_ate_7d,
{pct(n_if("espera > 30"), "count(*)")} AS pct_acima_30d FROM (SELECT date_diff('day', d, d - 1) AS espera FROM (SELECT CAST(data_notificacao AS DATE) AS d FROM cases))
WHERE espera BETWEEN 0 AND 365 HAVING count(*) > 0""")
def wait_stats_none(spark, sf):
    """Every case treated before its diagnosis: no plausible wait, no record."""
    rows = cases(spark, sf, *START).withColumn("data_inicio_tratamento", F.date_sub("data_diagnostico", 1))
    return waits.wait_stats(waits.start_histogram(rows))


BUCKETS = ("(VALUES (0,'Mesmo dia',0,0),(1,'1–3 dias',1,3),(2,'4–7 dias',4,7),(3,'8–15 dias',8,15),(4,'16–30 dias',16,30),"
           "(5,'31–60 dias',31,60),(6,'> 60 dias',61,100000)) b(ordem, faixa, de, ate)")


@query("wait_histogram", f"""SELECT b.faixa, count(espera) AS casos FROM {BUCKETS}
LEFT JOIN (SELECT espera FROM cases WHERE {OK_START}) c ON espera BETWEEN de AND ate GROUP BY 1""")
def wait_histogram(spark, sf):
    return waits.wait_histogram(waits.start_histogram(cases(spark, sf, *START)))


@query("wait_histogram_daily", f"""SELECT CAST(d AS INTEGER) AS dias, count(espera) AS casos FROM range(31) t(d)
LEFT JOIN (SELECT least(espera, 30) AS espera FROM cases WHERE {OK_START}) c ON espera = d GROUP BY 1""")
def wait_histogram_daily(spark, sf):
    return waits.wait_histogram_daily(waits.start_histogram(cases(spark, sf, *START)))


@query("duration_median", f"SELECT count(*) AS n, quantile_cont(duracao, 0.5) AS duracao_mediana FROM cases WHERE {OK_LENGTH}")
def duration_median(spark, sf):
    return waits.duration_median(waits.duration_histogram(cases(spark, sf, *LENGTH)))


@query("duration_median_legacy", "SELECT count(*) AS n, quantile_cont(duracao, 0.5) AS duracao_mediana FROM cases WHERE duracao BETWEEN 0 AND 1095")
def duration_median_legacy(spark, sf):
    return waits.duration_median(waits.duration_histogram(cases(spark, sf, *LENGTH), limits=(0, 1095), closed_only=False))


@query("wait_median_approx", f"SELECT quantile_cont(espera, 0.5) AS mediana_inicio, true AS perto FROM cases WHERE {OK_START}")
def wait_median_approx(spark, sf):
    """The exact median, and whether the sketched one is within a day of it."""
    rows = cases(spark, sf, *START)
    sketched = waits.wait_median_approx(rows).select("mediana_inicio").scalar()
    exact = waits.wait_stats(waits.start_histogram(rows)).select("mediana_inicio")
    return exact.select("mediana_inicio", (F.abs(F.col("mediana_inicio") - sketched) <= 1).alias("perto"))


FLAGS = {**COMORBIDITIES, **POPULATIONS}


@query("flag_prevalence", " UNION ALL ".join(
    f"SELECT '{c}' AS coluna, '{text}' AS label, {n_if(yes(c))} AS valor, count(*) AS total, {pct_min1(n_if(yes(c)), 'count(*)')} AS pct FROM cases" for c, text in FLAGS.items()))
def flag_prevalence(spark, sf):
    return outcomes.flag_prevalence(cases(spark, sf, *TB.flags), TB.flags)


@query("flag_prevalence_trimmed", " UNION ALL ".join(
    f"SELECT '{c}' AS coluna, '{text}' AS label, {n_if(f'lower(trim({c})) = {chr(39)}sim{chr(39)}')} AS valor, count(*) AS total, "
    f"{pct_min1(n_if(f'lower(trim({c})) = {chr(39)}sim{chr(39)}'), 'count(*)')} AS pct FROM cases" for c, text in COMORBIDITIES.items()))
def flag_prevalence_trimmed(spark, sf):
    return outcomes.flag_prevalence(cases(spark, sf, *tb.COMORBIDITIES), tb.COMORBIDITIES, trim=True)


MEMBERS = " UNION ALL ".join(f"SELECT '{text}' AS categoria, grupo FROM cases WHERE {yes(c)}" for c, text in POPULATIONS.items())


@query("outcome_by_membership", f"""SELECT categoria, g.grupo, {n_if('c.grupo = g.grupo')} AS n, count(*) AS total,
round({n_if('c.grupo = g.grupo')} / count(*) * 100, 1) AS pct FROM ({MEMBERS}) c, {GROUPS} GROUP BY 1, 2""")
def outcome_by_membership(spark, sf):
    return outcomes.outcome_by_membership(cases(spark, sf, "situacao_encerramento", *tb.POPULATIONS), tb.POPULATIONS)


@query("flag_area_heatmap", "SELECT uf, count(*) AS casos, " + ", ".join(f"{pct(n_if(yes(c)), 'count(*)')} AS {c}" for c in COMORBIDITIES)
       + " FROM cases WHERE uf IS NOT NULL GROUP BY 1")
def flag_area_heatmap(spark, sf):
    return outcomes.flag_area_heatmap(cases(spark, sf, "estado_notificacao", *tb.COMORBIDITIES), area_dim(spark, sf), tb.COMORBIDITIES)


LEGACY_FLAGS = ("agravo_aids", "agravo_alcoolismo", "agravo_drogas_ilicitas", "agravo_tabagismo")


@query("flag_area_heatmap_legacy", "SELECT coalesce(uf, '?') AS uf, count(forma) AS total, "
       + ", ".join(f"{pct_min1(n_if(yes(c)), 'count(forma)')} AS {c}" for c in LEGACY_FLAGS) + " FROM cases GROUP BY 1")
def flag_area_heatmap_legacy(spark, sf):
    return outcomes.flag_area_legacy(cases(spark, sf, "estado_notificacao", "forma", *LEGACY_FLAGS), area_dim(spark, sf), LEGACY_FLAGS)


DATED = ("ano_notificacao", "data_notificacao")
MONTHLY = "(SELECT ano_notificacao AS nu_ano, mes AS mes_num, count(*) AS casos FROM cases GROUP BY 1, 2)"
MONTHS_SQL = "['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez']"


@query("monthly_cases", """SELECT CAST(m AS INTEGER) AS mes, count(case_id) AS casos FROM range(1, 13) t(m)
LEFT JOIN (SELECT case_id, mes FROM cases WHERE ano_notificacao = 2001) ON mes = m GROUP BY 1""")
def monthly_cases(spark, sf):
    return history.monthly_cases(cases(spark, sf, *DATED), REFERENCE_YEAR)


@query("monthly_baseline", f"""SELECT CAST(m AS INTEGER) AS mes_num, coalesce(round(avg(casos), 0), 0) AS media_hist FROM range(1, 13) t(m)
LEFT JOIN {MONTHLY} ON mes_num = m AND nu_ano BETWEEN 1995 AND 2000 GROUP BY 1""")
def monthly_baseline(spark, sf):
    return history.monthly_baseline(history.history_monthly(cases(spark, sf, *DATED)), FIRST_YEAR, REFERENCE_YEAR)


SPAN = f"(SELECT mes_num, round(sum(casos) / 6.0::DOUBLE, 0) AS media_hist FROM {MONTHLY} WHERE nu_ano BETWEEN 1995 AND 2000 GROUP BY 1)"


@query("monthly_baseline_span", f"SELECT mes_num, media_hist FROM {SPAN}")
def monthly_baseline_span(spark, sf):
    return history.monthly_baseline(history.history_monthly(cases(spark, sf, *DATED)), FIRST_YEAR, REFERENCE_YEAR, "span")


@query("annual_baseline", f"""SELECT t AS total_ano, round(m, 0) AS media_anual_hist, round((t - m) / m * 100, 1) AS variacao_pct FROM (
SELECT (SELECT count(*) FROM cases WHERE ano_notificacao = 2001) AS t, avg(s) AS m FROM (SELECT nu_ano, sum(casos) AS s FROM {MONTHLY}
WHERE nu_ano BETWEEN 1995 AND 2000 GROUP BY 1))""")
def annual_baseline(spark, sf):
    rows = cases(spark, sf, *DATED)
    current = rows.where(F.col("ano_notificacao") == REFERENCE_YEAR).agg(F.count(F.lit(1))).scalar()
    return history.annual_baseline(history.history_monthly(rows), current, FIRST_YEAR, REFERENCE_YEAR)


@query("area_variation", """SELECT b.uf, coalesce(casos, 0) AS casos, round(m, 0) AS media_hist, round((coalesce(casos, 0) - m) / m * 100, 1) AS variacao_pct
FROM (SELECT uf, avg(n) AS m FROM (SELECT ano_notificacao, uf, count(*) AS n FROM cases WHERE uf IS NOT NULL AND ano_notificacao BETWEEN 1995 AND 2000
GROUP BY 1, 2) GROUP BY 1) b LEFT JOIN (SELECT uf, count(*) AS casos FROM cases WHERE ano_notificacao = 2001 GROUP BY 1) a ON a.uf = b.uf""")
def area_variation(spark, sf):
    return history.area_variation(area_history(spark, sf), current_by_area(spark, sf), FIRST_YEAR, REFERENCE_YEAR)


@query("month_variation", f"""SELECT mes_num, ({MONTHS_SQL})[mes_num] AS mes_label, casos, media_hist, variacao,
CASE WHEN variacao > 5 THEN 'Para mais' WHEN variacao < -5 THEN 'Para menos' ELSE 'Estável' END AS direcao FROM (
SELECT mes_num, casos, media_hist, round((casos - media_hist) / CASE WHEN media_hist = 0 THEN 1 ELSE media_hist END * 100, 1) AS variacao FROM (
SELECT coalesce(a.mes_num, b.mes_num) AS mes_num, coalesce(casos, 0) AS casos, coalesce(media_hist, 0) AS media_hist
FROM (SELECT mes_num, casos FROM {MONTHLY} WHERE nu_ano = 2001) a FULL JOIN {SPAN} b ON a.mes_num = b.mes_num))""")
def month_variation(spark, sf):
    monthly = history.history_monthly(cases(spark, sf, *DATED))
    current = monthly.where(F.col("nu_ano") == REFERENCE_YEAR).select(F.col("mes_num").alias("mes"), "casos")
    return history.month_variation(current, history.monthly_baseline(monthly, FIRST_YEAR, REFERENCE_YEAR, "span"))


@query("history_monthly", MONTHLY[1:-1])
def history_monthly(spark, sf):
    return history.history_monthly(cases(spark, sf, *DATED))


@query("history_by_area", "SELECT ano_notificacao AS nu_ano, uf AS uf_sigla, count(*) AS casos FROM cases WHERE uf IS NOT NULL GROUP BY 1, 2")
def history_by_area(spark, sf):
    return area_history(spark, sf)


@query("history_annual", "SELECT ano_notificacao AS nu_ano, count(*) AS casos FROM cases GROUP BY 1")
def history_annual(spark, sf):
    return history.history_annual(cases(spark, sf, "ano_notificacao"))


def indicators_sql(cure: str, dropout: str, death: str, closed: str) -> str:
    c = {"hiv_pos": "lower(trim(status_hiv)) = 'positivo'", "hiv_testado": "lower(trim(status_hiv)) IN ('positivo', 'negativo')",
         "cura": cure, "abandono": dropout, "obito_tb": death, "encerrados": closed, "caso_novo": "trim(tipo_entrada) = 'Caso Novo'",
         "pulmonar": "trim(forma) = 'Pulmonar'", "aids": "lower(trim(agravo_aids)) = 'sim'", "alcool": "lower(trim(agravo_alcoolismo)) = 'sim'",
         "pop_rua": "lower(trim(populacao_situacao_rua)) = 'sim'", "pop_liber": "lower(trim(populacao_privada_liberdade)) = 'sim'"}
    r = {"pct_hiv": ("hiv_pos", "hiv_testado"), "pct_test_hiv": ("hiv_testado", "total"), "pct_cura": ("cura", "encerrados"),
         "pct_abandon": ("abandono", "encerrados"), "pct_obito": ("obito_tb", "encerrados"), "pct_novo": ("caso_novo", "total"),
         "pct_pulm": ("pulmonar", "total"), "pct_aids": ("aids", "total"), "pct_alcool": ("alcool", "total")}
    return (f"SELECT *, {', '.join(f'{pct_min1(n, d)} AS {k}' for k, (n, d) in r.items())} FROM (SELECT ano_notificacao AS nu_ano, count(*) AS total, "
            f"{', '.join(f'{n_if(v)} AS {k}' for k, v in c.items())} FROM cases GROUP BY 1)")


IND = indicators_sql(CURE, DROPOUT, DEATH, CLOSED)
IND_INPUT = ("ano_notificacao", "situacao_encerramento", "status_hiv", "tipo_entrada", "forma", "agravo_aids", "agravo_alcoolismo",
             "populacao_situacao_rua", "populacao_privada_liberdade")


@query("history_indicators", IND)
def history_indicators(spark, sf):
    return history.history_indicators(cases(spark, sf, *IND_INPUT))


@query("history_indicators_raw", indicators_sql(
    "trim(situacao_encerramento) = 'Cura'", "trim(situacao_encerramento) IN ('Abandono', 'Abandono Primário')",
    "trim(situacao_encerramento) = 'Óbito por TB'", "trim(situacao_encerramento) NOT IN ('Não informado', 'Nao informado', '')"))
def history_indicators_raw(spark, sf):
    return history.history_indicators(cases(spark, sf, *IND_INPUT), canonical=False)


SERIES = {"pct_cura": "Taxa de cura (%)", "pct_abandon": "Taxa de abandono (%)", "pct_hiv": "Coinfecção HIV (%)", "pct_pulm": "Forma pulmonar (%)",
          "pct_test_hiv": "Testagem para HIV (%)", "pct_obito": "Óbito por TB (%)", "pct_novo": "Casos novos (%)", "pct_aids": "AIDS (%)",
          "pct_alcool": "Alcoolismo (%)"}
SERIES_SQL = " UNION ALL ".join(f"SELECT nu_ano, '{text}' AS indicador, {c} AS valor FROM ({IND})" for c, text in SERIES.items())


@query("indicator_series_long", SERIES_SQL)
def indicator_series_long(spark, sf):
    return history.indicator_series_long(history.history_indicators(cases(spark, sf, *IND_INPUT)))


@query("build_history", """SELECT 'anual' AS tabela, ano_notificacao AS nu_ano, CAST(NULL AS VARCHAR) AS chave, count(*) AS casos FROM cases GROUP BY 2
UNION ALL SELECT 'estadual', ano_notificacao, uf, count(*) FROM cases WHERE uf IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'mensal', ano_notificacao, CAST(mes AS VARCHAR), count(*) FROM cases GROUP BY 2, 3""")
def build_history(spark, sf):
    """The three count tables of the history from one scan; the fourth is ``history_indicators``."""
    return history_counts_long(cases(spark, sf, *DATED, "estado_notificacao"), area_dim(spark, sf))


@query("write_history", """SELECT 'anual' AS tabela, ano_notificacao AS nu_ano, CAST(NULL AS VARCHAR) AS chave, CAST(count(*) AS DOUBLE) AS valor FROM cases GROUP BY 2
UNION ALL SELECT 'estadual', ano_notificacao, uf, count(*) FROM cases WHERE uf IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'mensal', ano_notificacao, CAST(mes AS VARCHAR), count(*) FROM cases GROUP BY 2, 3
UNION ALL SELECT 'indicadores', nu_ano, indicador, valor FROM (""" + SERIES_SQL + ")")
def written_history(spark, sf):
    """The whole history written in two passes and read back."""
    path, known = scratch_dir(spark, "gold"), years(spark, sf)
    write_history(cases(spark, sf, *IND_INPUT, "data_notificacao", "estado_notificacao"), area_dim(spark, sf), path, known[0], known[-1])
    h = read_history(spark, path)
    long = history.indicator_series_long(h["indicadores"])
    parts = [("anual", h["anual"], "string(NULL)", "casos"), ("estadual", h["estadual"], "uf_sigla", "casos"),
             ("mensal", h["mensal"], "string(mes_num)", "casos"), ("indicadores", long, "indicador", "valor")]
    return append([t.selectExpr(f"'{n}' AS tabela", "nu_ano", f"{k} AS chave", f"double({v}) AS valor") for n, t, k, v in parts])


@query("build_history_indicators", IND + " WHERE nu_ano BETWEEN 1996 AND 2000")
def build_history_indicators(spark, sf):
    rows = cases(spark, sf, *IND_INPUT, "data_notificacao", "estado_notificacao")
    return history_tables(rows, area_dim(spark, sf), 1996, 2000)["indicadores"]


@query("registry_deaths_year_area", "SELECT ano, uf, obitos FROM deaths")
def registry_deaths_year_area(spark, sf):
    return deaths(spark, sf)


@query("registry_deaths_area", "SELECT uf AS uf_sigla, obitos AS obitos_sim FROM deaths WHERE ano = 2000")
def registry_deaths_area(spark, sf):
    return reg.registry_deaths_area(registry(spark, sf), area_dim(spark, sf), 2000)


@query("registry_deaths_national", "SELECT count(*) AS obitos FROM registry WHERE causabas LIKE 'A1%' AND substr(dtobito, 5, 4) = '2000'")
def registry_deaths_national(spark, sf):
    return reg.registry_deaths_national(registry(spark, sf), 2000)


@query("registry_deaths_series", "SELECT ano, CAST(sum(obitos) AS BIGINT) AS obitos FROM deaths GROUP BY 1")
def registry_deaths_series(spark, sf):
    return reg.registry_deaths_series(deaths(spark, sf))


@query("registry_deaths_series_legacy", """SELECT CAST(substr(dtobito, 5, 4) AS INTEGER) AS nu_ano, count(*) AS obitos_sim FROM registry
WHERE causabas LIKE 'A1%' AND substr(dtobito, 5, 4) BETWEEN '1995' AND '2024' GROUP BY 1""")
def registry_deaths_series_legacy(spark, sf):
    return reg.registry_deaths_series_legacy(registry(spark, sf), 1995, 2024)


@query("lab_confirmation_series", """SELECT CAST(nu_ano AS INTEGER) AS nu_ano, count(*) FILTER (WHERE pulm) AS pulm_total,
count(*) FILTER (WHERE pulm AND lab) AS pulm_conf_lab, round(count(*) FILTER (WHERE pulm AND lab) / greatest(count(*) FILTER (WHERE pulm), 1) * 100, 1) AS pct_pulm_conf_lab
FROM coded1 GROUP BY 1""")
def lab_confirmation_series(spark, sf):
    return lab.lab_confirmation_series(coded(spark, sf), ("1995", "2025"))


@query("contacts_examined_series", """SELECT CAST(nu_ano AS INTEGER) AS nu_ano, sum(CAST(nu_contato AS DOUBLE)) AS contatos_id, sum(CAST(nu_comu_ex AS DOUBLE)) AS contatos_exam,
round(sum(CAST(nu_comu_ex AS DOUBLE)) / CASE WHEN sum(CAST(nu_contato AS DOUBLE)) = 0 THEN 1 ELSE sum(CAST(nu_contato AS DOUBLE)) END * 100, 1) AS pct_contatos_exam
FROM coded1 WHERE pulm AND lab AND regexp_full_match(nu_contato, '[0-9]+') GROUP BY 1""")
def contacts_examined_series(spark, sf):
    return lab.contacts_examined_series(coded(spark, sf), ("1995", "2025"))


@query("share_of_total", f"""SELECT label, valor, round(valor / sum(valor) OVER () * 100, 1) AS pct FROM (
SELECT trim(raca_cor) AS label, count(*) AS valor FROM cases WHERE {RACE} GROUP BY 1)""")
def share_of_total(spark, sf):
    return counts.category_shares(cases(spark, sf, "raca_cor"), "raca_cor")


@query("share_of_total_groups", """SELECT grupo AS label, count(*) AS valor, round(count(*) / sum(count(*)) OVER () * 100, 1) AS pct FROM cases GROUP BY 1""")
def share_of_total_groups(spark, sf):
    rows = with_outcome(cases(spark, sf, "situacao_encerramento"))
    return counts.share_of_total(counts.count_by(rows, F.col("grupo").alias("label"), name="valor"))


@query("unknown_share", " UNION ALL ".join(
    f"SELECT '{d}' AS dimensao, {n_if(w)} AS n, count(*) AS total, {pct(n_if(w), 'count(*)')} AS pct FROM cases" for d, w in (
        ("sexo", "sexo = 'Ignorado'"), ("forma", "forma IS NULL"),
        ("status_hiv", "status_hiv IS NULL OR status_hiv NOT IN ('Positivo', 'Negativo')"), ("desfecho", "desfecho = 'Em acompanhamento'"))))
def unknown_share(spark, sf):
    return counts.unknown_share(cases(spark, sf, "sexo", "forma", "status_hiv", "situacao_encerramento"))


OPTIONS = ("sexo", "forma", "raca_cor", "tipo_entrada", "status_hiv")


@query("filter_options", " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS dimensao, trim({c}) AS valor FROM cases WHERE {c} IS NOT NULL AND trim({c}) <> 'nan'" for c in OPTIONS))
def filter_options(spark, sf):
    return counts.filter_options(cases(spark, sf, *OPTIONS), OPTIONS)


@query("row_count_by_year", "SELECT ano_notificacao AS ano, count(*) AS total FROM cases GROUP BY ROLLUP (ano_notificacao)")
def row_count_by_year(spark, sf):
    return diagnostics.row_count_by_year(cases(spark, sf, "ano_notificacao"), "ano_notificacao")


@query("sample_values", " UNION ALL ".join(
    f"""SELECT '{c}' AS coluna, CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS posicao, v AS valor, CAST(NULL AS VARCHAR) AS erro
FROM (SELECT DISTINCT {c} AS v FROM cases WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 15)""" for c in ("raca_cor", "municipio_notificacao", "status_hiv"))
    + " UNION ALL SELECT 'ausente', NULL, NULL, 'coluna ausente'")
def sample_values(spark, sf):
    rows = cases(spark, sf, "raca_cor", "municipio_notificacao", "status_hiv")
    return diagnostics.sample_values(rows, ["raca_cor", "municipio_notificacao", "status_hiv", "ausente"])


@query("content_fingerprint", """SELECT count(*) AS linhas, 6::INTEGER AS colunas,
CAST(sum(CAST('0x' || substr(md5(o_orderpriority || ''), 1, 8) AS BIGINT)) AS VARCHAR) AS soma FROM orders""")
def content_fingerprint(spark, sf):
    return diagnostics.content_fingerprint(table(spark, sf, "orders"), "o_orderpriority")


@query("content_fingerprint_fast", "SELECT count(*) AS linhas, 6::INTEGER AS colunas, true AS igual, true AS difere FROM orders")
def content_fingerprint_fast(spark, sf):
    """The hash sum does not depend on the order of rows, and changes when a row is missing."""
    rows = table(spark, sf, "orders")
    soma = lambda df: diagnostics.content_fingerprint_fast(df, "o_orderpriority").select("soma").scalar()
    less = rows.where(F.col("o_orderkey") != rows.agg(F.min("o_orderkey")).scalar())
    return diagnostics.content_fingerprint_fast(rows, "o_orderpriority").select(
        "linhas", "colunas", (F.col("soma") == soma(rows.orderBy(F.desc("o_totalprice")))).alias("igual"),
        (F.col("soma") != soma(less)).alias("difere"))


@query("fallback_month_mean", f"""SELECT mes_num, ({MONTHS_SQL})[mes_num] AS mes_label, casos, avg(casos) OVER () AS media
FROM {MONTHLY} WHERE nu_ano = 2001""")
def fallback_month_mean(spark, sf):
    return history.fallback_month_mean(cases(spark, sf, *DATED), REFERENCE_YEAR)


@query("population_present", """SELECT CAST(sum(populacao) AS BIGINT) AS populacao FROM area_dim
WHERE sigla IN (SELECT uf FROM cases WHERE uf IN ('N02', 'N03', 'N05'))""")
def population_present(spark, sf):
    dim = area_dim(spark, sf)
    rows = Filters(areas=("N02", "N03", "N05")).apply(cases(spark, sf, "estado_notificacao"), TB, dim)
    return kpis.population_present(rows, dim)


@query("mortality_rate_legacy", f"""SELECT n AS obitos, p AS populacao, {rate('n', 'p', N_YEARS)} AS mortalidade FROM (SELECT
(SELECT count(*) FROM registry WHERE causabas LIKE 'A1%' AND CAST(substr(dtobito, 5, 4) AS INTEGER) IN ({ALL_YEARS})) AS n,
(SELECT CAST(sum(populacao) AS BIGINT) FROM area_dim) AS p)""")
def mortality_rate_legacy(spark, sf):
    rows = cases(spark, sf, "estado_notificacao", "situacao_encerramento")
    return kpis.mortality_rate_legacy(rows, area_dim(spark, sf), registry(spark, sf), years(spark, sf))


@query("mortality_rate_legacy_areas", f"""SELECT n AS obitos, p AS populacao, {rate('n', 'p', N_YEARS)} AS mortalidade FROM (SELECT
(SELECT CAST(sum(obitos) AS BIGINT) FROM deaths WHERE ano IN ({ALL_YEARS}) AND uf IN ('N02', 'N03', 'N05')) AS n,
(SELECT CAST(sum(populacao) AS BIGINT) FROM area_dim WHERE sigla IN ('N02', 'N03', 'N05')) AS p)""")
def mortality_rate_legacy_areas(spark, sf):
    dim = area_dim(spark, sf)
    rows = Filters(areas=("N02", "N03", "N05")).apply(cases(spark, sf, "estado_notificacao", "situacao_encerramento"), TB, dim)
    return kpis.mortality_rate_legacy(rows, dim, registry(spark, sf), years(spark, sf))


@query("outcome_group_by_legacy", group_sql("status_hiv", "status_hiv IN ('Positivo', 'Negativo', 'Em andamento', 'Não realizado')"))
def outcome_group_by_legacy(spark, sf):
    return outcomes.outcome_group_by(cases(spark, sf, "status_hiv", "situacao_encerramento"), "status_hiv", only=tb.LEGACY_HIV, unmapped="drop")
