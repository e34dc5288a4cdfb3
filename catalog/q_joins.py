"""Joins, windows, orderings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.q_sources import deaths
from catalog.register import (
    CURE, DEATH, INCIDENT, KNOWN, N_YEARS, POPULATIONS, fold, n_if, pct, query, rate, yes)
from catalog.views import FIRST_YEAR, REFERENCE_YEAR, area_dim, cases, coded, registry, table, years
from epispark.functions import clean
from epispark.functions.measures import pct1
from epispark.functions.text import fold_key
from epispark.operators import areas, coded as lab, counts, history, outcomes, rankings
from epispark.operators import registry as reg
from epispark.presets import tuberculosis as tb
from epispark.sources import geo
from epispark.spec import TB

PLACES = ("estado_notificacao", "municipio_notificacao", "situacao_encerramento", "status_hiv")


@query("join_area_inner", "SELECT case_id, uf, regiao FROM cases JOIN area_dim ON uf = sigla")
def join_area_inner(spark, sf):
    dim = area_dim(spark, sf)
    rows = clean.attach_area(cases(spark, sf, "case_id", "estado_notificacao"), dim)
    regions = F.broadcast(dim.table.select("sigla", "regiao"))
    return rows.join(regions, "sigla").select("case_id", F.col("sigla").alias("uf"), "regiao")


@query("join_counts_left", f"""SELECT uf, count(*) AS casos, {n_if(INCIDENT)} AS casos_novos, {n_if(DEATH)} AS obitos,
{n_if("lower(populacao_privada_liberdade) = 'sim' AND lower(agravo_aids) = 'sim'")} AS raros FROM cases WHERE uf IS NOT NULL GROUP BY 1""")
def join_counts_left(spark, sf):
    """Totals with sub-counts, zero where there is none: one pass instead of left joins."""
    rows = clean.with_outcome(cases(spark, sf, "estado_notificacao", "tipo_entrada", "situacao_encerramento",
                                    "populacao_privada_liberdade", "agravo_aids"))
    rare = (F.lower("populacao_privada_liberdade") == "sim") & (F.lower("agravo_aids") == "sim")
    return (clean.attach_area(rows, area_dim(spark, sf)).groupBy(F.col("sigla").alias("uf"))
            .agg(F.count(F.lit(1)).alias("casos"), areas.n_if(F.col("tipo_entrada").isin(*TB.incidence_entries), "casos_novos"),
                 areas.n_if(F.col("desfecho") == TB.death, "obitos"), areas.n_if(rare, "raros")))


BASE_UF = """(SELECT uf, round(sum(n) / 6.0, 0) AS media_hist FROM (SELECT ano_notificacao, uf, count(*) AS n FROM cases
WHERE uf IS NOT NULL AND ano_notificacao BETWEEN 1995 AND 2000 GROUP BY 1, 2) GROUP BY 1)"""
VARIATION_V1 = """round((coalesce(casos, 0) - coalesce(media_hist, 0)) / CASE WHEN coalesce(media_hist, 0) = 0 THEN 1 ELSE media_hist END * 100, 1)"""


def direction_sql(v: str) -> str:
    return f"CASE WHEN {v} > 5 THEN 'Para mais' WHEN {v} < -5 THEN 'Para menos' ELSE 'Estável' END"


def current_by_area(spark, sf, how="inner"):
    rows = cases(spark, sf, "ano_notificacao", "estado_notificacao").where(F.col("ano_notificacao") == REFERENCE_YEAR)
    return counts.count_by(clean.attach_area(rows, area_dim(spark, sf), how=how, unknown="?"), F.col("sigla").alias("uf"))


def area_history(spark, sf):
    return history.history_by_area(cases(spark, sf, "ano_notificacao", "estado_notificacao"), area_dim(spark, sf))


@query("join_baseline_outer", f"""SELECT coalesce(a.uf, b.uf) AS uf, coalesce(casos, 0) AS casos, coalesce(media_hist, 0.0)::DOUBLE AS media_hist,
{VARIATION_V1} AS variacao, {direction_sql(VARIATION_V1)} AS direcao
FROM (SELECT uf, count(*) AS casos FROM cases WHERE uf IS NOT NULL AND ano_notificacao = 2001 GROUP BY 1) a
FULL JOIN {BASE_UF} b ON a.uf = b.uf""")
def join_baseline_outer(spark, sf):
    return history.area_variation_legacy(area_history(spark, sf), current_by_area(spark, sf, "left"), FIRST_YEAR, REFERENCE_YEAR)


@query("join_baseline_left", """SELECT b.uf, coalesce(casos, 0) AS casos, round(m, 0) AS media_hist,
round((coalesce(casos, 0) - m) / m * 100, 1) AS variacao_pct
FROM (SELECT uf, avg(n) AS m FROM (SELECT ano_notificacao, uf, count(*) AS n FROM cases WHERE uf IS NOT NULL
AND ano_notificacao BETWEEN 1995 AND 2000 GROUP BY 1, 2) GROUP BY 1) b
LEFT JOIN (SELECT uf, count(*) AS casos FROM cases WHERE ano_notificacao = 2001 GROUP BY 1) a ON a.uf = b.uf WHERE m > 0""")
def join_baseline_left(spark, sf):
    return history.area_variation(area_history(spark, sf), current_by_area(spark, sf), FIRST_YEAR, REFERENCE_YEAR)


@query("join_population", "SELECT uf, casos, populacao FROM (SELECT coalesce(uf, '?') AS uf, count(*) AS casos FROM cases GROUP BY 1) LEFT JOIN area_dim ON sigla = uf WHERE uf <> '?' "
       "UNION ALL SELECT '?', count(*), 0 FROM cases WHERE uf IS NULL")
def join_population(spark, sf):
    dim = area_dim(spark, sf)
    rows = clean.attach_area(cases(spark, sf, "estado_notificacao"), dim, how="left", unknown="?")
    return areas.join_population(counts.count_by(rows, F.col("sigla").alias("uf")), dim)


@query("join_registry", """SELECT sigla AS uf, coalesce(n, 0) AS obitos FROM area_dim LEFT JOIN
(SELECT uf, CAST(sum(obitos) AS BIGINT) AS n FROM deaths WHERE ano IN (1999, 2000) GROUP BY 1) ON uf = sigla""")
def join_registry(spark, sf):
    dim = area_dim(spark, sf)
    by = areas.deaths_in_years(deaths(spark, sf), area_dim(spark, sf), (1999, 2000))
    out = dim.table.select(F.col("sigla").alias("uf")).join(by, "uf", "left")
    return out.select("uf", F.coalesce("obitos", F.lit(0).cast("long")).alias("obitos"))


@query("join_both_counted_inner", f"""SELECT uf, hiv_pos, testados, {pct('hiv_pos', 'testados')} AS pct FROM (
SELECT coalesce(uf, '?') AS uf, {n_if("status_hiv = 'Positivo'")} AS hiv_pos, {n_if(KNOWN)} AS testados FROM cases GROUP BY 1) WHERE hiv_pos > 0""")
def join_both_counted_inner(spark, sf):
    return areas.positivity_both_counted(cases(spark, sf, "estado_notificacao", "status_hiv"), area_dim(spark, sf))


@query("join_features_by_name", f"""SELECT f.uf, f.nome, coalesce(casos, 0) AS casos, coalesce(cura_pct, 0) AS cura_pct FROM
(SELECT DISTINCT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS uf, lower(c_mktsegment) || ' ' || lower(replace(n_name, 'NATION', 'NÂTION')) AS nome
 FROM customer JOIN nation ON c_nationkey = n_nationkey) f LEFT JOIN
(SELECT uf, {fold('municipio_notificacao')} AS k, count(*) AS casos, {pct(n_if(CURE), 'count(*)')} AS cura_pct FROM cases
 WHERE uf IS NOT NULL AND lower(populacao_privada_liberdade) = 'sim' AND status_hiv = 'Positivo' GROUP BY 1, 2) m
ON m.uf = f.uf AND m.k = {fold('f.nome')}""")
def join_features_by_name(spark, sf):
    n = table(spark, sf, "nation")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    uf = F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    name = F.concat_ws(" ", F.lower("c_mktsegment"), F.lower(F.replace(F.col("n_name"), F.lit("NATION"), F.lit("NÂTION"))))
    features = c.select(uf.alias("uf"), name.alias("nome")).distinct().withColumn("nm_norm", fold_key(F.col("nome")))
    rows = cases(spark, sf, *PLACES, "populacao_privada_liberdade").where(
        (F.lower("populacao_privada_liberdade") == "sim") & (F.col("status_hiv") == "Positivo"))
    indicators = areas.municipality_indicators(rows, area_dim(spark, sf))
    return geo.join_features(features, indicators, ["uf", "nm_norm"], ["casos", "cura_pct"]).drop("nm_norm")


@query("join_features_by_code", f"""SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS uf, n_name AS nome, coalesce(casos, 0) AS casos,
coalesce(incidencia, 0) AS incidencia, coalesce(mortalidade, 0) AS mortalidade FROM nation LEFT JOIN (
SELECT c.uf, casos, {rate('novos', 'populacao', N_YEARS)} AS incidencia, {rate('coalesce(obitos, 0)', 'populacao', N_YEARS)} AS mortalidade
FROM (SELECT uf, count(*) AS casos, {n_if(INCIDENT)} AS novos FROM cases WHERE uf IS NOT NULL GROUP BY 1) c JOIN area_dim ON sigla = c.uf
LEFT JOIN (SELECT uf, sum(obitos) AS obitos FROM deaths GROUP BY 1) d ON d.uf = c.uf) i
ON i.uf = 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')""")
def join_features_by_code(spark, sf):
    code = F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    features = table(spark, sf, "nation").select(code.alias("uf"), F.col("n_name").alias("nome"))
    rows = cases(spark, sf, "estado_notificacao", "tipo_entrada", "situacao_encerramento")
    indicators = areas.area_indicators(rows, area_dim(spark, sf), deaths(spark, sf), n_years=len(years(spark, sf)))
    return geo.join_features(features, indicators, ["uf"], ["casos", "incidencia", "mortalidade"])


@query("join_indicator_series", """SELECT a.nu_ano, casos, round(c / greatest(t, 1) * 100 + t * 0, 1) AS pct_pulm_conf_lab,
round(ex / CASE WHEN id = 0 THEN 1 ELSE id END * 100, 1) AS pct_contatos_exam FROM
(SELECT ano_notificacao AS nu_ano, count(*) AS casos FROM cases GROUP BY 1) a
LEFT JOIN (SELECT CAST(nu_ano AS INTEGER) AS nu_ano, count(*) FILTER (WHERE pulm) AS t, count(*) FILTER (WHERE pulm AND lab) AS c FROM coded1
GROUP BY 1) p ON p.nu_ano = a.nu_ano
LEFT JOIN (SELECT CAST(nu_ano AS INTEGER) AS nu_ano, sum(CAST(nu_contato AS DOUBLE)) AS id, sum(CAST(nu_comu_ex AS DOUBLE)) AS ex FROM coded1
WHERE pulm AND lab AND nu_contato <> 'x' GROUP BY 1) k ON k.nu_ano = a.nu_ano""")
def join_indicator_series(spark, sf):
    annual = history.history_annual(cases(spark, sf, "ano_notificacao"))
    rows = coded(spark, sf)
    return lab.join_indicator_series(
        annual, lab.lab_confirmation_series(rows).select("nu_ano", "pct_pulm_conf_lab"),
        lab.contacts_examined_series(rows).select("nu_ano", "pct_contatos_exam"))


@query("semi_areas", """SELECT ano, uf, obitos FROM deaths WHERE uf IN (SELECT uf FROM cases
WHERE lower(populacao_privada_liberdade) = 'sim' AND status_hiv = 'Positivo' AND raca_cor = 'Indígena')""")
def semi_areas(spark, sf):
    rows = cases(spark, sf, "estado_notificacao", "populacao_privada_liberdade", "status_hiv", "raca_cor").where(
        (F.lower("populacao_privada_liberdade") == "sim") & (F.col("status_hiv") == "Positivo") & (F.col("raca_cor") == "Indígena"))
    present = clean.attach_area(rows, area_dim(spark, sf)).select(F.col("sigla").alias("uf"))
    return reg.deaths_of_present_areas(deaths(spark, sf), present)


CROSS = """SELECT status_hiv AS categoria, grupo, count(*) AS n FROM cases WHERE status_hiv IS NOT NULL GROUP BY 1, 2"""


def crossed(spark, sf):
    rows = clean.with_outcome(cases(spark, sf, "status_hiv", "situacao_encerramento"))
    return counts.count_by(rows.where(F.col("status_hiv").isNotNull()), F.col("status_hiv").alias("categoria"), "grupo", name="n")


for _name in ("join_group_total", "share_within_group"):
    @query(_name, f"""SELECT categoria, grupo, n, CAST(sum(n) OVER (PARTITION BY categoria) AS BIGINT) AS total,
round(n / sum(n) OVER (PARTITION BY categoria) * 100, 1) AS pct FROM ({CROSS})""")
    def share_in_group(spark, sf):
        return rankings.share_within_group(crossed(spark, sf), "categoria")


def place_counts(spark, sf):
    rows = clean.attach_area(cases(spark, sf, "estado_notificacao", "municipio_notificacao"), area_dim(spark, sf))
    return counts.count_by(rows, F.col("sigla").alias("uf"), F.trim("municipio_notificacao").alias("municipio"))


PLACE_SQL = "SELECT uf, trim(municipio_notificacao) AS municipio, count(*) AS casos FROM cases WHERE uf IS NOT NULL GROUP BY 1, 2"


@query("ranked_table", f"SELECT *, row_number() OVER (PARTITION BY uf ORDER BY casos DESC, municipio) AS posicao FROM ({PLACE_SQL})")
def ranked_table(spark, sf):
    return rankings.ranked_table(place_counts(spark, sf))


@query("top_n_per_area", f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY uf ORDER BY casos DESC, municipio) AS INTEGER) AS posicao FROM ({PLACE_SQL})) WHERE posicao <= 3")
def top_n_per_area(spark, sf):
    return rankings.top_n_per_area(place_counts(spark, sf), 3)


@query("top_municipalities", f"SELECT municipio, casos FROM ({PLACE_SQL}) ORDER BY casos DESC, municipio LIMIT 20")
def top_municipalities(spark, sf):
    return rankings.top_n(place_counts(spark, sf), 20).select("municipio", "casos")


@query("rank_by_metric", f"SELECT uf, {pct(n_if(CURE), 'count(*)')} AS cura_pct FROM cases WHERE uf IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1")
def rank_by_metric(spark, sf):
    rows = clean.with_outcome(cases(spark, sf, "estado_notificacao", "situacao_encerramento"))
    by = clean.attach_area(rows, area_dim(spark, sf)).groupBy(F.col("sigla").alias("uf")).agg(
        F.count(F.lit(1)).alias("n"), areas.n_if(F.col("desfecho") == TB.cure, "c"))
    return rankings.rank_by_metric(by.select("uf", pct1(F.col("c"), F.col("n")).alias("cura_pct")), "cura_pct", "uf")


HIV_COUNTS = "SELECT CASE WHEN status_hiv IS NULL THEN 'Não informado' ELSE status_hiv END AS label, count(*) AS valor FROM cases GROUP BY 1"


@query("top_categories_share", f"""SELECT label, valor, total, round(valor / total * 100, 1) AS pct_total,
round(valor / sum(valor) OVER () * 100, 1) AS pct_mostrado FROM (SELECT label, valor, CAST(sum(valor) OVER () AS BIGINT) AS total
FROM ({HIV_COUNTS}) ORDER BY valor DESC, label LIMIT 3)""")
def top_categories_share(spark, sf):
    return counts.top_categories(counts.value_counts(cases(spark, sf, "status_hiv"), "status_hiv"), 3)


@query("ordered_series", "SELECT ano_notificacao AS nu_ano, mes AS mes_num, count(*) AS casos FROM cases GROUP BY 1, 2 ORDER BY 1, 2")
def ordered_series(spark, sf):
    return rankings.ordered_series(history.history_monthly(cases(spark, sf, "ano_notificacao", "data_notificacao")), "nu_ano", "mes_num")


@query("largest_first_categories", """SELECT trim(raca_cor) AS categoria, count(*) AS total FROM cases
WHERE raca_cor IS NOT NULL AND trim(raca_cor) <> 'Nao informado' GROUP BY 1 ORDER BY 2 DESC, 1""")
def largest_first_categories(spark, sf):
    return outcomes.largest_first(outcomes.outcome_group_by(cases(spark, sf, "raca_cor", "situacao_encerramento"), "raca_cor"))


@query("union_all_groups", " UNION ALL ".join(
    f"SELECT '{label}' AS categoria, grupo, count(*) AS n FROM cases WHERE {yes(c)} GROUP BY 2" for c, label in POPULATIONS.items()))
def union_all_groups(spark, sf):
    return outcomes.union_all_groups(cases(spark, sf, "situacao_encerramento", *tb.POPULATIONS), tb.POPULATIONS)


@query("union_years_then_sum", "SELECT uf AS uf_sigla, CAST(sum(obitos) AS BIGINT) AS obitos_sim FROM deaths GROUP BY 1")
def union_years_then_sum(spark, sf):
    """The earlier half of the registry's years as a published table, the later ones from the registry."""
    source, dim, published = registry(spark, sf), area_dim(spark, sf), deaths(spark, sf)
    known = sorted(r["ano"] for r in published.select("ano").distinct().collect())  # calendar years
    half = len(known) // 2
    earlier = areas.deaths_in_years(published.where(F.col("ano").isin(known[:half])), dim).toDF("uf_sigla", "obitos_sim")
    return reg.sum_years([earlier, reg.registry_deaths_area(source, dim, *known[half:])])


@query("distinct_values", "SELECT DISTINCT raca_cor AS valor FROM cases WHERE raca_cor IS NOT NULL")
def distinct_values(spark, sf):
    return counts.distinct_values(cases(spark, sf, "raca_cor"), "raca_cor")
