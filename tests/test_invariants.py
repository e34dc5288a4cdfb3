"""Results that must agree whichever way they are computed, and behaviour under a hot key."""

import pytest
from pyspark.sql import functions as F

from catalog import views
from catalog.q_sources import deaths
from conftest import SF_DIR
from epispark import TB, Filters
from epispark.functions.clean import attach_area
from epispark.operators import areas, counts, history, outcomes, rankings, waits
from epispark.plans import composites
from epispark.plans.batch import history_counts_long, history_tables, read_history, write_history

EVERY = Filters(years=views.YEARS)


@pytest.fixture(scope="module")
def cases(spark):
    return views.cases(spark, SF_DIR).persist()


@pytest.fixture(scope="module")
def dim(spark):
    return views.area_dim(spark, SF_DIR)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_union_of_groups_equals_one_scan(cases):
    union = rows(outcomes.union_all_groups(cases, TB.populations), "categoria", "grupo", "n")
    single = outcomes.outcome_by_membership(cases, TB.populations).where("n > 0")
    assert rows(single, "categoria", "grupo", "n") == union


def test_area_sums_equal_the_whole(cases, dim):
    mapped = attach_area(cases, dim).count()
    found = areas.area_indicators(cases, dim, deaths(cases.sparkSession, SF_DIR), n_years=7)
    assert found.agg(F.sum("casos")).first()[0] == mapped < cases.count()
    by_place = areas.municipality_indicators(cases, dim)
    assert by_place.agg(F.sum("casos")).first()[0] == mapped


def test_shares_add_up(cases):
    sums = outcomes.outcome_group_by(cases, "status_hiv").groupBy("categoria").agg(F.sum("n").alias("n"), F.max("total").alias("t"), F.sum("pct").alias("p"))
    for r in sums.collect():
        assert r["n"] == r["t"] and abs(r["p"] - 100) <= 0.21


def test_profile_blocks_equal_single_operators(cases, dim):
    p = composites.perfil(cases, dim, EVERY)
    for block, column in (("sexo", "sexo"), ("raca_cor", "raca_cor"), ("escolaridade", "escolaridade")):
        single = counts.value_counts(cases, column).select(F.col("label"), F.col("valor").cast("double"))
        assert rows(p.where(F.col("bloco") == block), "categoria", "valor") == rows(single)
    tower = outcomes.age_sex_pyramid(cases, deaths_only=True).unpivot(["faixa"], ["masculino", "feminino"], "s", "n")
    assert rows(p.where("bloco = 'piramide_obitos'").select("categoria", F.lower("grupo"), "valor")) == rows(
        tower.select("faixa", "s", F.col("n").cast("double")))


def test_detail_equals_cohort_and_places(cases, dim):
    d = composites.detalhe_uf(cases, dim, EVERY, "N07")
    k = areas.cohort_kpis(cases, dim).where("uf = 'N07'").drop("uf")
    wide = k.select([F.col(c).cast("double").alias(c) for c in k.columns]).unpivot([], k.columns, "indicador", "valor")
    assert rows(d.where("bloco = 'kpis'"), "indicador", "valor") == rows(wide)


def test_exact_and_sketched_median_are_close(cases):
    exact = waits.wait_stats(waits.start_histogram(cases)).first()["mediana_inicio"]
    assert abs(waits.wait_median_approx(cases).first()[0] - exact) <= 1


def test_history_from_one_scan_equals_the_tables(cases, dim):
    t = history_tables(cases, dim, 1995, 2001)
    long = history_counts_long(cases, dim)
    assert rows(long.where("tabela = 'anual'"), "nu_ano", "casos") == rows(t["anual"])
    assert rows(long.where("tabela = 'mensal'").select("nu_ano", F.col("chave").cast("int"), "casos")) == rows(t["mensal"])


def test_written_history_equals_the_tables(spark, cases, dim, tmp_path):
    write_history(cases, dim, str(tmp_path), 1996, 2000)
    written, computed = read_history(spark, str(tmp_path)), history_tables(cases, dim, 1996, 2000)
    for name, table in computed.items():
        assert rows(written[name], *table.columns) == rows(table), name


def test_unknown_area_is_refused(cases, dim):
    with pytest.raises(ValueError):
        composites.detalhe_uf(cases, dim, EVERY, "ZZ")


def test_one_row_per_year_and_area_with_two_spellings(cases, dim):
    h = history.history_by_area(cases, dim)
    assert h.count() == h.select("nu_ano", "uf_sigla").distinct().count()


def test_older_and_newer_baselines_agree_when_every_month_is_there(spark):
    h = spark.range(12 * 3).selectExpr("int(2001 + id div 12) nu_ano", "int(id % 12 + 1) mes_num", "id * 7 casos")
    assert rows(history.monthly_baseline(h, 2001, 2004)) == rows(history.monthly_baseline(h, 2001, 2004, "span"))


def test_no_history(spark):
    none = spark.sql("SELECT 2001 nu_ano, 1 mes_num, 5L casos")
    assert {r[1] for r in history.monthly_baseline(none, 1990, 2000).collect()} == {None}
    assert tuple(history.annual_baseline(none, F.lit(7), 1990, 2000).first()) == (7, 0.0, None)


def test_baseline_averages_present_months_only(spark):
    h = spark.sql("SELECT * FROM VALUES (2001, 1, 10L), (2002, 1, 20L), (2002, 2, 9L) t(nu_ano, mes_num, casos)")
    present = dict(rows(history.monthly_baseline(h, 2001, 2003)))
    span = dict(rows(history.monthly_baseline(h, 2001, 2003, "span")))
    assert (present[1], present[2], present[3]) == (15.0, 9.0, 0.0)
    assert span == {1: 15.0, 2: 5.0}  # 4.5 rounds away from zero


def test_positions_match_a_plain_ranking_under_ties(spark):
    places = spark.range(500).selectExpr("if(id % 3 = 0, 'A', 'B') uf", "concat('m', id) municipio", "id % 7 casos")
    fast = rows(rankings.ranked_table(places), "uf", "municipio", "posicao")
    expected = []
    by_area = {}
    for r in places.collect():
        by_area.setdefault(r["uf"], []).append((-r["casos"], r["municipio"]))
    for uf, items in by_area.items():
        expected += [(uf, name, i) for i, (_, name) in enumerate(sorted(items), 1)]
    assert fast == sorted(expected, key=repr)


def test_empty_inputs(cases, dim):
    none = cases.where("false")
    assert waits.wait_stats(waits.start_histogram(none)).count() == 0
    assert waits.wait_histogram(waits.start_histogram(none)).agg(F.sum("casos"), F.count("*")).first() == (0, 7)
    assert outcomes.age_sex_pyramid(none).count() == 11
    assert history.monthly_cases(none, 2001).agg(F.sum("casos"), F.count("*")).first() == (0, 12)
    assert outcomes.flag_prevalence(none, TB.flags).agg(F.max("pct")).first()[0] == 0.0


def test_summary_falls_back_only_without_registry_deaths(cases, dim):
    some = deaths(cases.sparkSession, SF_DIR)
    with_registry = composites.resumo(cases, dim, some, EVERY).first()
    without = composites.resumo(cases, dim, some.where("false"), EVERY).first()
    assert (with_registry["fonte_obitos"], without["fonte_obitos"]) == ("SIM", "SINAN")
    assert without["obitos"] == cases.where(F.col("situacao_encerramento").isin("Óbito por TB", "Obito por TB")).count()


def test_hot_key(spark):
    """Most cases in one place of one area: counts stay exact."""
    hot = spark.range(20000).selectExpr(
        "if(id % 10 < 7, 'NATION_1', concat('Nação_', id % 24)) estado_notificacao", "if(id % 10 < 7, 'x', concat('m', id % 50)) municipio_notificacao",
        "if(id % 4 = 0, 'Cura', NULL) situacao_encerramento", "if(id % 5 = 0, 'Positivo', 'Negativo') status_hiv")
    d = views.area_dim(spark, SF_DIR)
    got = {r["municipio"]: r["casos"] for r in areas.municipality_indicators(hot, d).where("uf = 'N01'").collect()}
    assert got["x"] == 14000
    assert areas.positivity_by_area(hot, d).agg(F.sum("n_testado")).first()[0] == 20000
