"""Filters and predicates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.register import fold, query
from catalog.views import FIRST_YEAR, REFERENCE_YEAR, append, area_dim, cases, coded, registry
from epispark.functions import clean, predicates
from epispark.functions.filters import PRESETS, Filters, apply_request, legacy_filters, parse_request, year_preset
from epispark.operators import counts, kpis
from epispark.operators.history import history_annual, monthly_cases
from epispark.operators.waits import duration, start_wait
from epispark.spec import TB

AS_OF = date(2001, 9, 1)
DIMENSIONS = ("case_id", "ano_notificacao", "estado_notificacao", "sexo", "forma", "raca_cor", "tipo_entrada",
              "status_hiv", "beneficiario_governo", "agravo_diabetes", "populacao_situacao_rua")
CHOSEN = Filters(years=(1998, 1999, 2000), areas=("N01", "N07", "N13"), sexes=("Feminino", "Masculino"),
                 forms=("Pulmonar",), races=("Branca", "Preta", "Indígena"), entries=("Caso Novo",),
                 hiv=("Negativo", "Positivo"), populations=("beneficiario_governo", "coluna_desconhecida"))


@query("apply_filters", """SELECT case_id FROM cases WHERE ano_notificacao IN (1998, 1999, 2000)
AND estado_notificacao IN (SELECT nome FROM area_names WHERE sigla IN ('N01', 'N07', 'N13'))
AND sexo IN ('Feminino', 'Masculino') AND forma IN ('Pulmonar') AND raca_cor IN ('Branca', 'Preta', 'Indígena')
AND tipo_entrada IN ('Caso Novo') AND status_hiv IN ('Negativo', 'Positivo') AND lower(beneficiario_governo) = 'sim'""")
def apply_filters(spark, sf):
    return CHOSEN.apply(cases(spark, sf, *DIMENSIONS), TB, area_dim(spark, sf)).select("case_id")


@query("apply_filters_empty", "SELECT count(*) AS n FROM cases")
def apply_filters_empty(spark, sf):
    rows = Filters().apply(cases(spark, sf, *DIMENSIONS), TB, area_dim(spark, sf))
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query("filter_area", "SELECT case_id FROM cases WHERE uf IN ('N03', 'N11')")
def filter_area(spark, sf):
    rows = cases(spark, sf, "case_id", "ano_notificacao", "estado_notificacao")
    return Filters(areas=("N03", "N11")).apply(rows, TB, area_dim(spark, sf)).select("case_id")


@query("filter_values", """SELECT case_id FROM cases WHERE sexo IN ('Feminino') AND forma IN ('Pulmonar', 'Extrapulmonar')
AND raca_cor IN ('Parda', 'Preta') AND tipo_entrada IN ('Caso Novo', 'Recidiva') AND status_hiv IN ('Negativo')""")
def filter_values(spark, sf):
    chosen = Filters(sexes=("Feminino",), forms=("Pulmonar", "Extrapulmonar"), races=("Parda", "Preta"),
                     entries=("Caso Novo", "Recidiva"), hiv=("Negativo",))
    return chosen.apply(cases(spark, sf, *DIMENSIONS), TB).select("case_id")


@query("filter_flags_all", "SELECT case_id FROM cases WHERE lower(beneficiario_governo) = 'sim' AND lower(agravo_diabetes) = 'sim'")
def filter_flags_all(spark, sf):
    chosen = Filters(populations=("beneficiario_governo",), comorbidities=("agravo_diabetes", "case_id"))
    return chosen.apply(cases(spark, sf, *DIMENSIONS), TB).select("case_id")


def catalog(spark, sf):
    """(ano): the calendar years present."""
    return cases(spark, sf, "ano_notificacao").select(F.col("ano_notificacao").alias("ano")).distinct()


@query("resolve_filters", """SELECT case_id FROM cases WHERE ano_notificacao IN (1997, 1999) AND uf IN ('N02', 'N05')
AND sexo = 'Feminino' AND lower(populacao_situacao_rua) = 'sim'""")
def resolved(spark, sf):
    dim = area_dim(spark, sf)
    f = parse_request(dim, TB, years="1999, x,2050,1997,1999", areas="N05,ZZ,N02",
                      sexes="Feminino", populations="populacao_situacao_rua,outra")
    return apply_request(cases(spark, sf, *DIMENSIONS), catalog(spark, sf), f, TB, dim).select("case_id")


@query("resolve_filters_latest", "SELECT case_id FROM cases WHERE ano_notificacao = (SELECT max(ano_notificacao) FROM cases)")
def resolved_latest(spark, sf):
    f = parse_request(area_dim(spark, sf), TB, years="abc,1800")
    return apply_request(cases(spark, sf, "case_id", "ano_notificacao"), catalog(spark, sf), f, TB).select("case_id")


@query("filter_region", "SELECT case_id FROM cases JOIN area_dim ON uf = sigla WHERE regiao = 'ASIA'")
def filter_region(spark, sf):
    dim = area_dim(spark, sf)
    rows = cases(spark, sf, "case_id", "estado_notificacao")
    return Filters(areas=dim.in_regions(["ASIA"])).apply(rows, TB, dim).select("case_id")


@query("year_preset", """SELECT 'last' AS preset, ano FROM (SELECT DISTINCT ano_notificacao AS ano FROM cases) WHERE ano = 2000
UNION ALL SELECT 'last3', ano FROM (SELECT DISTINCT ano_notificacao AS ano FROM cases) WHERE ano BETWEEN 1998 AND 2000
UNION ALL SELECT 'last10', ano FROM (SELECT DISTINCT ano_notificacao AS ano FROM cases) WHERE ano < 2001
UNION ALL SELECT 'all', ano FROM (SELECT DISTINCT ano_notificacao AS ano FROM cases)""")
def presets(spark, sf):
    years = catalog(spark, sf)
    return append([year_preset(years, name).select(F.lit(name).alias("preset"), "ano") for name in (*PRESETS, "all")])


@query("filter_legacy", """SELECT case_id FROM cases WHERE sexo IN ('Masculino', 'Feminino')
AND (forma IN ('Pulmonar', 'Extrapulmonar') OR forma IS NULL)
AND CASE WHEN raca_cor IS NULL THEN 'Não informado' ELSE raca_cor END IN ('Branca', 'Não informado')
AND status_hiv IN ('Positivo', 'Negativo', 'Em andamento', 'Não realizado', 'Ignorado') AND lower(beneficiario_governo) = 'sim'""")
def filter_legacy(spark, sf):
    return legacy_filters(cases(spark, sf, *DIMENSIONS), TB, forms=("Pulmonar", "Extrapulmonar"),
                          races=("Branca", "Não informado"), flags=("beneficiario_governo", "ausente")).select("case_id")


@query("plausible_wait", """SELECT case_id, espera BETWEEN 0 AND 365 AS inicio, duracao BETWEEN 1 AND 1000 AS encerramento,
duracao BETWEEN 0 AND 1095 AS encerramento_v1 FROM cases""")
def plausible_wait(spark, sf):
    rows = cases(spark, sf, "case_id", "data_diagnostico", "data_inicio_tratamento", "data_notificacao", "data_encerramento")
    return rows.select("case_id", predicates.plausible(start_wait()).alias("inicio"),
                       predicates.plausible(duration(), predicates.PLAUSIBLE_DURATION).alias("encerramento"),
                       predicates.plausible(duration(), predicates.PLAUSIBLE_DURATION_LEGACY).alias("encerramento_v1"))


@query("cause_prefix", "SELECT causabas, count(*) AS n FROM registry WHERE causabas LIKE 'A1%' GROUP BY 1")
def cause_prefix(spark, sf):
    rows = registry(spark, sf).where(predicates.cause_prefix(F.col("causabas")))
    return counts.count_by(rows, "causabas", name="n")


@query("has_residence", "SELECT causabas, count(*) AS n FROM registry WHERE codmunres IS NOT NULL AND length(trim(codmunres)) >= 2 GROUP BY 1")
def has_residence(spark, sf):
    rows = registry(spark, sf).where(predicates.has_residence(F.col("codmunres")))
    return counts.count_by(rows, "causabas", name="n")


@query("lab_confirmed_new_pulmonary", "SELECT nu_ano, situa_ence, count(*) AS n FROM coded1 WHERE pulm AND lab GROUP BY 1, 2")
def lab_confirmed(spark, sf):
    rows = coded(spark, sf).where(predicates.lab_confirmed_new_pulmonary())
    return counts.count_by(rows, "nu_ano", "situa_ence", name="n")


@query("closed_case", "SELECT case_id FROM cases WHERE desfecho <> 'Em acompanhamento'")
def closed_case(spark, sf):
    rows = cases(spark, sf, "case_id", "situacao_encerramento")
    return rows.where(clean.is_closed()).select("case_id")


@query("drop_invalid_labels", f"""SELECT case_id, raca_cor FROM cases WHERE raca_cor IS NOT NULL
AND {fold('raca_cor')} NOT IN ('nan', 'none', 'undefined', '', 'nao informado', 'ignorado')""")
def drop_invalid_labels(spark, sf):
    return counts.drop_invalid_labels(cases(spark, sf, "case_id", "raca_cor"), "raca_cor")


@query("drop_current_year", """SELECT ano_notificacao AS nu_ano, count(*) AS casos FROM cases WHERE ano_notificacao < 2001 GROUP BY 1""")
def drop_current_year(spark, sf):
    annual = history_annual(cases(spark, sf, "ano_notificacao"))
    return annual.where(predicates.before_current_year(F.col("nu_ano"), AS_OF.year))


@query("incomplete_month", """SELECT CAST(m AS INTEGER) AS mes, m = 9 AS incompleto,
(SELECT count(*) FROM cases WHERE ano_notificacao = 2001 AND mes = m) AS casos FROM range(1, 13) t(m)""")
def incomplete_month(spark, sf):
    rows = monthly_cases(cases(spark, sf, "ano_notificacao", "data_notificacao"), REFERENCE_YEAR)
    mark = predicates.incomplete_month(F.lit(REFERENCE_YEAR), F.col("mes"), AS_OF)
    return rows.withColumn("incompleto", mark)


@query("baseline_years", "SELECT ano_notificacao AS nu_ano, count(*) AS casos FROM cases WHERE ano_notificacao BETWEEN 1995 AND 2000 GROUP BY 1")
def baseline_years(spark, sf):
    annual = history_annual(cases(spark, sf, "ano_notificacao"))
    return annual.where(predicates.baseline_years(F.col("nu_ano"), FIRST_YEAR, REFERENCE_YEAR))


@query("base_total_share", """SELECT count(*) FILTER (WHERE sexo = 'Feminino' AND forma = 'Pulmonar') AS total, count(*) AS total_base,
round(count(*) FILTER (WHERE sexo = 'Feminino' AND forma = 'Pulmonar') / count(*) * 100, 1) AS pct_filtrado FROM cases""")
def base_total_share(spark, sf):
    rows = cases(spark, sf, "ano_notificacao", "sexo", "forma")
    return kpis.base_total_share(rows, Filters(sexes=("Feminino",), forms=("Pulmonar",)))
