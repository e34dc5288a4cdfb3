"""Shape of the plans: scans, pushed filters, broadcasts, no Python."""

import re

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES, views
from conftest import SF_DIR
from epispark import TB, Filters
from epispark.operators import areas, counts, history, kpis, outcomes, waits
from epispark.operators.rankings import top_n, top_n_per_area
from epispark.plans import composites
from epispark.sources.cases import CaseStore

EVERY = Filters(years=views.YEARS)


def plan(df) -> str:
    """Physical plan before execution."""
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df, folder="") -> int:
    return len(re.findall(rf"FileScan parquet[^\n]*{folder}", plan(df)))


@pytest.fixture(scope="module")
def treated(spark, tmp_path_factory):
    raw = views.cases(spark, SF_DIR)
    store = CaseStore(spark, f"{tmp_path_factory.mktemp('plans')}/treated", raw.drop("case_id").schema)
    store.write(raw)
    return store


@pytest.fixture(scope="module")
def dim(spark):
    return views.area_dim(spark, SF_DIR)


def test_no_python_in_any_plan(spark):
    for name, build in QUERIES.items():
        if not re.search("scan|export|read|write|build|prepare|snapshot|extract|catalog|features|bounds|union_by_name", name):
            text = plan(build(spark, SF_DIR))
            assert not re.search("ArrowEvalPython|BatchEvalPython|MapInPandas|CartesianProduct|FlatMapGroups", text), name


def test_years_prune_folders(treated):
    text = plan(treated.years([1999, 2000]))
    assert re.search(r"PartitionFilters: \[[^\]]*ano_notificacao#\d+ IN \(1999,2000\)", text)


def test_value_filters_reach_the_reader(treated, dim):
    f = Filters(years=(1999,), areas=("N01",), sexes=("Feminino",), forms=("Pulmonar",))
    text = plan(counts.value_counts(f.apply(treated.all_years(), TB, dim), "raca_cor"))
    pushed = text.split("PushedFilters: ")[1].split("ReadSchema")[0]
    assert "In(estado_notificacao" in pushed and "EqualTo(sexo,Feminino)" in pushed and "EqualTo(forma,Pulmonar)" in pushed


def test_only_needed_columns_are_read(treated):
    text = plan(outcomes.age_sex_pyramid(treated.all_years()))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"idade_anos", "sexo"}


def test_outcome_tests_reach_the_reader(treated):
    text = plan(outcomes.age_sex_pyramid(treated.all_years(), deaths_only=True))
    assert "In(situacao_encerramento" in text.split("PushedFilters")[1]


@pytest.mark.parametrize("name, build, most", [
    ("multi_value_counts", lambda c, d: counts.multi_value_counts(c, ["sexo", "forma", "raca_cor"]), 1),
    ("flag_prevalence", lambda c, d: outcomes.flag_prevalence(c, TB.flags), 1),
    ("outcome_by_membership", lambda c, d: outcomes.outcome_by_membership(c, TB.populations), 1),
    ("history_indicators", lambda c, d: history.history_indicators(c), 1),
    ("conditional_counts", lambda c, d: kpis.conditional_counts(c), 1),
    ("wait_stats", lambda c, d: waits.wait_stats(waits.start_histogram(c)), 1),
    ("cohort_kpis", lambda c, d: areas.cohort_kpis(c, d), 1),
    ("meta", lambda c, d: composites.meta(c, d), 1),
    ("detalhe_uf", lambda c, d: composites.detalhe_uf(c, d, EVERY, "N07"), 1),
    ("perfil", lambda c, d: composites.perfil(c, d, EVERY), 2),
    ("clinico", lambda c, d: composites.clinico(c, d, EVERY), 2),
    ("comorbidades", lambda c, d: composites.comorbidades(c, d, EVERY), 1),
])
def test_scans_of_the_case_table(treated, dim, name, build, most):
    assert scans(build(treated.all_years(), dim), "treated") == most


def test_trend_scans_the_reference_year_once(spark, treated, dim, tmp_path):
    from epispark.plans.batch import history_tables
    for n, t in history_tables(treated.all_years(), dim, 1995, 2001).items():
        t.write.parquet(f"{tmp_path}/{n}")
    gold = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("mensal", "estadual", "anual", "indicadores")}
    deaths = spark.sql("SELECT 2000 ano, 'N01' uf, 3L obitos")
    df = composites.tendencia(treated.all_years(), dim, gold, deaths, Filters(years=(2001,)), 1995)
    assert scans(df, "treated") == 1
    assert re.search(r"PartitionFilters: \[[^\]]*2001", plan(df))


def test_areas_are_broadcast_and_counts_combine_before_the_shuffle(treated, dim):
    text = plan(areas.positivity_by_area(treated.all_years(), dim))
    assert "BroadcastHashJoin" in text and "partial_count" in text and "SortMergeJoin" not in text


def test_labels_are_cleaned_after_counting(treated):
    text = plan(counts.value_counts(treated.all_years(), "raca_cor"))
    below = text[text.rindex("Exchange"):]
    assert "partial_count" in below and "translate" not in below


def test_top_lists_keep_few_rows_per_task(treated, dim):
    places = counts.count_by(treated.all_years(), F.col("estado_notificacao").alias("uf"), F.col("municipio_notificacao").alias("municipio"))
    assert "TakeOrderedAndProject" in plan(top_n(places, 10))
    assert "WindowGroupLimit" in plan(top_n_per_area(places, 3))


def test_base_total_reads_no_column(treated, dim):
    f = Filters(years=(1999, 2000), areas=("N01",), sexes=("Feminino",))
    df = kpis.base_total_share(treated.all_years(), f, dim)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))
    assert "" in schemas and any("sexo" in s for s in schemas)


def test_clustered_writes_do_not_shuffle(spark, treated, tmp_path):
    """Year folders in, year folders out: no exchange, rows ordered by area inside each file."""
    from epispark.plans.batch import build_treated
    source = spark.read.parquet(treated.path)
    build_treated(source, f"{tmp_path}/out", views.YEARS, clustered=True)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == source.count()
    numbered = back.select("estado_notificacao", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    from pyspark.sql import Window as W
    before = F.lag("estado_notificacao").over(W.partitionBy("f").orderBy("i"))
    assert numbered.withColumn("b", before).where("b > estado_notificacao").count() == 0


@pytest.mark.parametrize("build", [
    lambda c, d: counts.category_shares(c, "raca_cor"),
    lambda c, d: counts.filter_options(c, ["sexo", "raca_cor"]),
    lambda c, d: outcomes.outcome_group_by(c, "raca_cor"),
    lambda c, d: counts.unknown_share(c),
    lambda c, d: composites.meta(c, d),
    lambda c, d: composites.perfil(c, d, EVERY),
    lambda c, d: composites.clinico(c, d, EVERY),
    lambda c, d: composites.detalhe_uf(c, d, EVERY, "N07"),
])
def test_text_functions_run_on_counted_rows_only(treated, dim, build):
    """No accent folding between a scan of the cases and the first exchange above it."""
    for branch in re.split(r"FileScan parquet", plan(build(treated.all_years(), dim)))[:-1]:
        below = branch[branch.rindex("Exchange"):]
        assert "translate" not in below and "btrim" not in below.lower()
