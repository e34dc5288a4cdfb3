"""Cleaning and scalar operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog.register import (
    CURE, DROPOUT, fold, label, n_if, pct, pct_min1, query, rate, yes)
from catalog.views import area_dim, cases, coded, raw, registry, table
from epispark.functions import clean, measures
from epispark.functions.text import clean_label, fold_key, is_yes
from epispark.operators import areas, counts, outcomes
from epispark.operators.history import history_annual
from epispark.presets import tuberculosis as tb
from epispark.spec import TB


@query("drop_if_present", "SELECT case_id, ano_notificacao, idade_notificada, data_notificacao, numero_contatos FROM raw")
def drop_if_present(spark, sf):
    return clean.drop_if_present(raw(spark, sf))


@query("coerce_dates", "SELECT case_id, CAST(try_cast(data_notificacao AS DATE) AS VARCHAR) AS data_notificacao FROM raw")
def coerce_dates(spark, sf):
    rows = clean.coerce_dates(raw(spark, sf).select("case_id", "data_notificacao"))
    return rows.withColumn("data_notificacao", F.col("data_notificacao").cast("string"))


@query("coerce_small_ints", "SELECT case_id, CAST(try_cast(numero_contatos AS SMALLINT) AS INTEGER) AS numero_contatos FROM raw")
def coerce_small_ints(spark, sf):
    return clean.coerce_small_ints(raw(spark, sf).select("case_id", "numero_contatos"))


@query("parse_age_text", "SELECT case_id, idade_anos FROM treated")
def parse_age_text(spark, sf):
    return raw(spark, sf).select("case_id", clean.parse_age(F.col("idade_notificada")).alias("idade_anos"))


@query("parse_age_text_zero", "SELECT case_id, coalesce(idade_anos, 0) AS idade_anos FROM treated")
def parse_age_text_zero(spark, sf):
    return raw(spark, sf).select("case_id", clean.parse_age(F.col("idade_notificada"), True).alias("idade_anos"))


@query("canonical_outcome", "SELECT case_id, desfecho FROM cases")
def canonical_outcome(spark, sf):
    return clean.with_outcome(cases(spark, sf, "case_id", "situacao_encerramento")).select("case_id", "desfecho")


@query("canonical_outcome_plain", """SELECT case_id, CASE situacao_encerramento WHEN 'Nao informado' THEN 'Em acompanhamento'
WHEN 'Óbito por TB' THEN 'Obito por TB' ELSE situacao_encerramento END AS desfecho FROM cases""")
def canonical_outcome_plain(spark, sf):
    rows = cases(spark, sf, "case_id", "situacao_encerramento")
    return rows.select("case_id", clean.plain_outcome(F.col("situacao_encerramento")).alias("desfecho"))


@query("outcome_group", "SELECT case_id, grupo FROM cases")
def outcome_group(spark, sf):
    return clean.with_outcome(cases(spark, sf, "case_id", "situacao_encerramento")).select("case_id", "grupo")


@query("outcome_group_dropped", "SELECT case_id, grupo FROM cases WHERE desfecho IN ('Cura', 'Abandono', 'Abandono Primário', 'Óbito por TB', 'Transferência', 'Em acompanhamento')")
def outcome_group_dropped(spark, sf):
    rows = cases(spark, sf, "case_id", "situacao_encerramento")
    group = clean.outcome_group(clean.canonical_outcome(F.col("situacao_encerramento")), unmapped_as_null=True)
    return rows.select("case_id", group.alias("grupo")).where(F.col("grupo").isNotNull())


@query("area_code", "SELECT case_id, uf AS sigla FROM cases WHERE uf IS NOT NULL")
def area_code(spark, sf):
    rows = cases(spark, sf, "case_id", "estado_notificacao")
    return clean.attach_area(rows, area_dim(spark, sf)).select("case_id", "sigla")


@query("area_code_unknown", "SELECT case_id, coalesce(uf, '?') AS sigla FROM cases")
def area_code_unknown(spark, sf):
    rows = cases(spark, sf, "case_id", "estado_notificacao")
    return clean.attach_area(rows, area_dim(spark, sf), how="left", unknown="?").select("case_id", "sigla")


@query("age_band_11", "SELECT case_id, faixa FROM cases")
def age_band_11(spark, sf):
    return cases(spark, sf, "case_id", "idade_anos").select("case_id", clean.band("idade_anos", tb.AGE_BANDS_11).alias("faixa"))


@query("age_band_17", "SELECT case_id, faixa17 AS faixa FROM cases")
def age_band_17(spark, sf):
    return cases(spark, sf, "case_id", "idade_anos").select("case_id", clean.band("idade_anos", tb.AGE_BANDS_17).alias("faixa"))


@query("fold_key", f"SELECT doc_id, {fold('text')} AS chave FROM documents")
def fold_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fold_key(F.col("text")).alias("chave"))


@query("clean_labels", f"SELECT {label('raca_cor')} AS label, count(*) AS valor FROM cases GROUP BY 1")
def clean_labels(spark, sf):
    return counts.value_counts(cases(spark, sf, "raca_cor"), "raca_cor")


@query("clean_labels_rowwise", f"SELECT case_id, {label('escolaridade')} AS label FROM cases")
def clean_labels_rowwise(spark, sf):
    return cases(spark, sf, "case_id", "escolaridade").select("case_id", clean_label(F.col("escolaridade")).alias("label"))


@query("dedupe_spellings", """SELECT DISTINCT CASE WHEN n_nationkey = 24 THEN replace(n_name, 'NATION', 'Nação')
ELSE replace(n_name, 'NATION', 'Nação') END AS valor FROM nation
WHERE replace(n_name, 'NATION', 'Nação') IN (SELECT estado_notificacao FROM cases)
UNION ALL SELECT n_name FROM nation WHERE n_name IN (SELECT estado_notificacao FROM cases)
AND replace(n_name, 'NATION', 'Nação') NOT IN (SELECT estado_notificacao FROM cases)
UNION ALL SELECT n_name FROM nation WHERE n_name IN (SELECT estado_notificacao FROM cases)
AND replace(n_name, 'NATION', 'Nação') IN (SELECT estado_notificacao FROM cases)""")
def dedupe_spellings(spark, sf):
    values = counts.distinct_values(cases(spark, sf, "estado_notificacao"), "estado_notificacao")
    return counts.dedupe_spellings(values)


@query("month_of", "SELECT case_id, mes FROM cases")
def month_of(spark, sf):
    return cases(spark, sf, "case_id", "data_notificacao").select("case_id", clean.month_of(F.col("data_notificacao")).alias("mes"))


@query("month_label", """SELECT case_id, (['Jan','Fev','Mar','Abr','Mai','Jun','Jul','Ago','Set','Out','Nov','Dez'])[mes] AS mes_label FROM cases""")
def month_label(spark, sf):
    rows = cases(spark, sf, "case_id", "data_notificacao")
    return rows.select("case_id", clean.month_label(clean.month_of(F.col("data_notificacao"))).alias("mes_label"))


@query("is_yes", f"""SELECT case_id, coalesce({yes('agravo_aids')}, false) AS aids, coalesce({yes('agravo_tabagismo')}, false) AS tabagismo,
coalesce(lower(trim(agravo_tabagismo)) = 'sim', false) AS tabagismo_aparado FROM cases""")
def yes_flags(spark, sf):
    rows = cases(spark, sf, "case_id", "agravo_aids", "agravo_tabagismo")
    return rows.select("case_id", is_yes(F.col("agravo_aids")).alias("aids"), is_yes(F.col("agravo_tabagismo")).alias("tabagismo"),
                       is_yes(F.col("agravo_tabagismo"), trim=True).alias("tabagismo_aparado"))


@query("registry_keys", """SELECT ano, uf, count(*) AS n FROM (SELECT try_cast(substr(dtobito, 5, 4) AS INTEGER) AS ano, sigla AS uf
FROM registry JOIN area_dim ON codigo = substr(codmunres, 1, 2)) GROUP BY 1, 2""")
def registry_keys(spark, sf):
    dim = area_dim(spark, sf)
    rows = registry(spark, sf).select(clean.registry_year(F.col("dtobito")).alias("ano"),
                                      clean.registry_area_code(F.col("codmunres")).alias("codigo"))
    codes = F.broadcast(dim.table.select("codigo", F.col("sigla").alias("uf")))
    return counts.count_by(rows.where(F.col("ano").isNotNull()).join(codes, "codigo"), "ano", "uf", name="n")


@query("wait_days", "SELECT case_id, CAST(espera AS INTEGER) AS dias FROM cases")
def wait_days(spark, sf):
    rows = cases(spark, sf, "case_id", "data_diagnostico", "data_inicio_tratamento")
    return rows.select("case_id", clean.wait_days(F.col("data_diagnostico"), F.col("data_inicio_tratamento")).alias("dias"))


@query("clip_upper", "SELECT case_id, CASE WHEN espera IS NOT NULL THEN CAST(least(espera, 30) AS INTEGER) END AS dias FROM cases")
def clip_upper(spark, sf):
    rows = cases(spark, sf, "case_id", "data_diagnostico", "data_inicio_tratamento")
    days = clean.wait_days(F.col("data_diagnostico"), F.col("data_inicio_tratamento"))
    return rows.select("case_id", clean.clip_upper(days, 30).alias("dias"))


@query("numeric_text_guard", "SELECT CAST(nu_contato AS DOUBLE) AS nu_contato, count(*) AS n FROM coded WHERE regexp_full_match(nu_contato, '[0-9]+') GROUP BY 1")
def numeric_text_guard(spark, sf):
    rows = coded(spark, sf).where(clean.digits_only(F.col("nu_contato")))
    return counts.count_by(rows, clean.digits_to_double(F.col("nu_contato")).alias("nu_contato"), name="n")


@query("pct1", f"SELECT municipio_notificacao AS municipio, {pct(n_if(CURE), 'count(*)')} AS cura_pct, {pct(n_if(CURE), n_if('idade_anos > 200'))} AS sem_base FROM cases GROUP BY 1")
def pct_one_decimal(spark, sf):
    rows = clean.with_outcome(cases(spark, sf, "municipio_notificacao", "situacao_encerramento", "idade_anos"))
    by = rows.groupBy(F.col("municipio_notificacao").alias("municipio")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("desfecho") == TB.cure).alias("c"),
        F.count_if(F.col("idade_anos") > 200).alias("z"))
    return by.select("municipio", measures.pct1(F.col("c"), F.col("n")).alias("cura_pct"),
                     measures.pct1(F.col("c"), F.col("z")).alias("sem_base"))


@query("rate_per_100k", f"SELECT sigla AS uf, {rate('n', 'populacao', 7)} AS taxa FROM area_dim JOIN (SELECT uf, count(*) AS n FROM cases GROUP BY 1) ON uf = sigla")
def rate_per_100k(spark, sf):
    dim = area_dim(spark, sf)
    by = counts.count_by(clean.attach_area(cases(spark, sf, "estado_notificacao"), dim), F.col("sigla").alias("uf"), name="n")
    return areas.join_population(by, dim).select("uf", measures.rate_per_100k(F.col("n"), F.col("populacao"), 7).alias("taxa"))


YEAR_CHANGE = """(SELECT ano_notificacao AS nu_ano, casos, anterior,
round((CAST(casos AS DOUBLE) - anterior) / anterior * 100, 1) AS variacao, (CAST(casos AS DOUBLE) - anterior) / anterior * 100 AS bruta
FROM (SELECT ano_notificacao, casos, lag(casos) OVER (ORDER BY ano_notificacao) AS anterior
FROM (SELECT ano_notificacao, count(*) AS casos FROM cases GROUP BY 1)))"""


def year_changes(spark, sf):
    # One row per calendar year.
    annual = history_annual(cases(spark, sf, "ano_notificacao"))
    return annual.withColumn("anterior", F.lag("casos").over(W.partitionBy(F.lit(0)).orderBy("nu_ano")))


@query("direction", f"""SELECT nu_ano, variacao, CASE WHEN variacao IS NULL THEN 'Sem histórico' WHEN variacao > 5 THEN 'Para mais'
WHEN variacao < -5 THEN 'Para menos' ELSE 'Estável' END AS direcao FROM {YEAR_CHANGE}""")
def direction(spark, sf):
    rows = year_changes(spark, sf).select("nu_ano", measures.variation_pct(F.col("casos"), F.col("anterior")).alias("variacao"))
    return rows.withColumn("direcao", measures.direction(F.col("variacao")))


@query("delta_vs_previous", f"""SELECT nu_ano, variacao AS delta, CASE WHEN bruta IS NULL THEN NULL WHEN abs(bruta) < 0.1 THEN 'flat'
WHEN bruta <= 0 THEN 'good' ELSE 'bad' END AS situacao FROM {YEAR_CHANGE}""")
def delta_vs_previous(spark, sf):
    change, status = measures.delta_vs_previous(F.col("casos"), F.col("anterior"))
    return year_changes(spark, sf).select("nu_ano", change.alias("delta"), status.alias("situacao"))


@query("target_flag", f"""SELECT uf, cura_novo_pct >= 85 AS cura_na_meta, abandono_pct >= 5 AS abandono_acima FROM (
SELECT uf, {pct_min1(n_if(CURE + " AND tipo_entrada = 'Caso Novo'"), n_if("desfecho <> 'Em acompanhamento' AND tipo_entrada = 'Caso Novo'"))} AS cura_novo_pct,
{pct_min1(n_if(DROPOUT), n_if("desfecho <> 'Em acompanhamento'"))} AS abandono_pct FROM cases WHERE uf IS NOT NULL GROUP BY 1)""")
def target_flag(spark, sf):
    rows = cases(spark, sf, "estado_notificacao", "municipio_notificacao", "situacao_encerramento", "tipo_entrada", "status_hiv")
    k = areas.cohort_kpis(rows, area_dim(spark, sf))
    return k.select("uf", measures.cure_target(F.col("cura_novo_pct")).alias("cura_na_meta"),
                    measures.dropout_breach(F.col("abandono_pct")).alias("abandono_acima"))


@query("wide_to_triples", "SELECT CAST(row_number() OVER (ORDER BY uf) - 1 AS INTEGER) AS indice_area, i.indice_indicador, CASE i.indice_indicador WHEN 0 THEN a WHEN 1 THEN d END AS valor FROM ("
       f"SELECT uf, {pct(n_if(yes('agravo_aids')), 'count(*)')} AS a, {pct(n_if(yes('agravo_diabetes')), 'count(*)')} AS d FROM cases WHERE uf IS NOT NULL GROUP BY 1), (SELECT 0 AS indice_indicador) i"
       " UNION ALL SELECT CAST(row_number() OVER (ORDER BY uf) - 1 AS INTEGER), 1, d FROM ("
       f"SELECT uf, {pct(n_if(yes('agravo_diabetes')), 'count(*)')} AS d FROM cases WHERE uf IS NOT NULL GROUP BY 1)")
def wide_to_triples(spark, sf):
    flags = {c: tb.COMORBIDITIES[c] for c in ("agravo_aids", "agravo_diabetes")}
    wide = outcomes.flag_area_heatmap(cases(spark, sf, "estado_notificacao", *flags), area_dim(spark, sf), flags)
    return outcomes.wide_to_triples(wide, "uf", list(flags))


@query("enrich_cases", "SELECT case_id, coalesce(uf, '?') AS uf_sigla, desfecho AS situacao_enc_norm, mes AS mes_num FROM cases")
def enrich_cases(spark, sf):
    rows = cases(spark, sf, "case_id", "estado_notificacao", "situacao_encerramento", "data_notificacao")
    return clean.enrich_cases(rows, area_dim(spark, sf)).select("case_id", "uf_sigla", "situacao_enc_norm", "mes_num")


@query("young_flag", "SELECT case_id, faixa, faixa IN ('0-4', '5-9', '10-14') AS jovem FROM cases")
def young_flag(spark, sf):
    rows = age_band_11(spark, sf)
    return rows.withColumn("jovem", clean.young_flag(F.col("faixa")))


# Shared with the other catalog modules.
SUMMARY_INPUT = ("ano_notificacao", "estado_notificacao", "municipio_notificacao", "situacao_encerramento",
                 "tipo_entrada", "status_hiv")

