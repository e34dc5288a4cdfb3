"""Column functions on small hand-computed values."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from epispark import TB, Filters, brazil
from epispark.functions import clean, measures, predicates
from epispark.functions.filters import apply_request, legacy_filters, parse_request, region_areas, year_preset
from epispark.functions.text import accent_table, clean_label, fold_key, is_yes, strip_ws
from epispark.presets import tuberculosis as tb
from epispark.spec import AreaDim


def values(spark, data, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_strip_removes_all_white_space(spark):
    assert values(spark, [" a\t", " b　", "\n", None, "a b"], strip_ws) == ["a", "b", "", None, "a b"]


@pytest.mark.parametrize("text", [" São Paulo ", "ÓBITO", "Œuvre", "ß", "Ångström Å", "ﬁ", "Ệ\n", "日本", "í", "≠=", "\x1cx"])
def test_fold_key_matches_canonical_decomposition(spark, text):
    import unicodedata
    expected = unicodedata.normalize("NFD", text).encode("ascii", "ignore").decode().lower().strip()
    assert values(spark, [text], fold_key) == [expected]


def test_accent_table_is_one_to_one():
    source, target = accent_table()
    assert len(source) == len(target) > 400


def test_clean_label(spark):
    data = [None, "nan", " NONE ", "undefined", "", "Nao informado", " não INFORMADO", " Parda ", "Ignorado"]
    n = "Não informado"
    assert values(spark, data, clean_label) == [n, n, n, n, n, n, n, "Parda", "Ignorado"]


def test_is_yes(spark):
    data = ["Sim", "SIM", " sim ", "Não", None]
    assert values(spark, data, is_yes) == [True, True, False, False, False]
    assert values(spark, data, lambda c: is_yes(c, trim=True)) == [True, True, True, False, False]


def test_parse_age(spark):
    data = ["34 anos", "1 ano", "5 meses", "26 meses", "1 mês", "20 dias", "5 horas", "sem informação", None, "12"]
    assert values(spark, data, clean.parse_age) == [34, 1, 0, 2, 0, 0, 0, None, None, None]
    zero = values(spark, data, lambda c: clean.parse_age(c, unmatched_as_zero=True))
    assert zero[-3:] == [0, 0, 0]


def test_coercions(spark):
    assert values(spark, ["2024-02-30", "2024-02-29", "x", None], clean.to_date) == [None, date(2024, 2, 29), None, None]
    assert values(spark, ["12", "12.5", "abc", "40000", "-3", None], clean.to_small_int) == [12, None, None, None, -3, None]


def test_bands_at_their_edges(spark):
    df = spark.createDataFrame([(a,) for a in (-1, 0, 4, 5, 19, 20, 29, 79, 80, 199, 200, None)], "idade int")
    got = [tuple(r) for r in df.select(clean.band("idade", tb.AGE_BANDS_11), clean.band("idade", tb.AGE_BANDS_17)).collect()]
    assert got == [(None, None), ("0-4", "0-4"), ("0-4", "0-4"), ("5-9", "5-9"), ("15-19", "15-19"), ("20-29", "20-24"),
                   ("20-29", "25-29"), ("70-79", "75-79"), ("80+", "80+"), ("80+", "80+"), ("80+", None), (None, None)]


def test_outcomes(spark):
    data = [None, "Nao informado", "Não informado", "Obito por TB", "Óbito por TB", "Abandono Primario", "Transferencia", "Cura", "Outro"]
    canonical = ["Em acompanhamento"] * 3 + ["Óbito por TB"] * 2 + ["Abandono Primário", "Transferência", "Cura", "Outro"]
    assert values(spark, data, clean.canonical_outcome) == canonical
    groups = values(spark, canonical, clean.outcome_group)
    assert groups == ["Não avaliado"] * 3 + ["Óbito", "Óbito", "Interrupção", "Não avaliado", "Cura", "Não avaliado"]
    assert values(spark, canonical, lambda c: clean.outcome_group(c, unmapped_as_null=True))[-1] is None
    assert values(spark, data, clean.plain_outcome) == [None, "Em acompanhamento", "Em acompanhamento", "Obito por TB", "Obito por TB",
                                                        "Abandono Primario", "Transferencia", "Cura", "Outro"]


def test_stored_outcome_tests_agree_with_recoding(spark):
    raw = [None, "Em acompanhamento", "Cura", *tb.OUTCOME_SPELLINGS, *tb.OUTCOME_GROUPS, "Outro", ""]
    df = spark.createDataFrame([(v,) for v in raw], "situacao_encerramento string")
    rows = clean.with_outcome(df)
    checks = [(clean.is_closed(), F.col("desfecho") != TB.open_outcome)]
    checks += [(F.coalesce(clean.has_outcome(x), F.lit(False)), F.col("desfecho").isin(*([x] if isinstance(x, str) else x)))
               for x in (TB.cure, TB.death, TB.dropout, "Falência")]
    for direct, recoded in checks:
        assert rows.where(direct != recoded).count() == 0


def test_wait_days_counts_calendar_days(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 23:00:00' a, timestamp_ntz'2024-01-02 01:00:00' b")
    assert df.select(clean.wait_days(F.col("a"), F.col("b")), clean.wait_days(F.col("b"), F.col("a"))).first() == (1, -1)
    assert values(spark, [0, 30, 31, None], lambda c: clean.clip_upper(c, 30), "int") == [0, 30, 30, None]


def test_rates(spark):
    df = spark.sql("SELECT 1L n, 8L d, 0L z")
    n, d, z = F.col("n"), F.col("d"), F.col("z")
    row = df.select(measures.pct1(n, d), measures.pct1(n, z), measures.pct1_min1(n, z), measures.rate_per_100k(n, d, 2),
                    measures.rate_per_100k(n, z), measures.variation_pct(n, d), measures.variation_pct(n, z)).first()
    assert tuple(row) == (12.5, 0.0, 100.0, 6250.0, 0.0, -87.5, None)


def test_direction_and_delta(spark):
    assert values(spark, [5.0, 5.1, -5.0, -5.1, None], measures.direction, "double") == [
        "Estável", "Para mais", "Estável", "Para menos", "Sem histórico"]
    df = spark.sql("SELECT * FROM VALUES (110D, 100D), (90D, 100D), (100.05D, 100D), (1D, 0D) t(c, p)")
    for good_when_up, expected in ((False, ["bad", "good", "flat", None]), (True, ["good", "bad", "flat", None])):
        change, status = measures.delta_vs_previous(F.col("c"), F.col("p"), good_when_up)
        assert [r[0] for r in df.select(status).collect()] == expected


def test_registry_predicates(spark):
    assert values(spark, ["A150", "A1", "B200", None], predicates.cause_prefix) == [True, True, False, None]
    assert values(spark, ["35", "3", " ", None], predicates.has_residence) == [True, False, False, False]
    assert values(spark, ["01022019", "0102xxxx", "", None], clean.registry_year) == [2019, None, None, None]


def test_null_outcome_is_not_a_new_pulmonary_case(spark):
    df = spark.sql("SELECT '1' forma, '1' tratamento, CAST(NULL AS STRING) situa_ence")
    assert df.where(predicates.new_pulmonary()).count() == 0


def test_filters(spark):
    dim = brazil(spark)
    df = spark.createDataFrame(
        [("São Paulo", "Sim", "Feminino"), ("Sao Paulo", "sim", "Masculino"), ("Acre", "Não", None), ("Atlantida", None, "Feminino")],
        "estado_notificacao string, agravo_aids string, sexo string")
    def n(f):
        return df.where(f.where(TB, dim)).count()

    assert n(Filters()) == 4
    assert n(Filters(areas=("SP",))) == 2
    assert n(Filters(areas=("ZZ",))) == 4  # an unknown area does not restrict
    assert n(Filters(sexes=("Feminino",))) == 2
    assert n(Filters(comorbidities=("agravo_aids", "estado_notificacao"))) == 2
    assert hash(Filters(years=(1,))) == hash(Filters(years=(1,)))


def test_area_filter_needs_the_dimension(spark):
    df = spark.createDataFrame([("Acre", 1)], "estado_notificacao string, n int")
    with pytest.raises(ValueError):
        Filters(areas=("AC",)).apply(df, TB)


def test_request(spark):
    f = parse_request(brazil(spark), TB, years="2024, 2024,x,1990", areas="SP,QQ,AC", populations="profissional_saude,sexo")
    assert (f.years, f.areas, f.populations, f.reference_year, f.n_years) == ((1990, 2024), ("AC", "SP"), ("profissional_saude",), 2024, 2)
    df = spark.createDataFrame([(2023,), (2024,), (2024,)], "ano_notificacao int")
    catalog = df.select(F.col("ano_notificacao").alias("ano")).distinct()
    count = lambda text: apply_request(df, catalog, parse_request(brazil(spark), TB, years=text), TB).count()
    assert (count("2023"), count("2023,2024,1990"), count("1800"), count(None)) == (1, 3, 2, 2)
    assert apply_request(df.limit(0), catalog.limit(0), Filters(years=(2024,)), TB).count() == 0


def test_large_dimensions_are_joined(spark):
    """60,000 spellings: neither refused nor put into one condition."""
    spellings = tuple((f"place {k}", f"A{k % 100}") for k in range(60_000))
    areas = tuple((f"A{k}", f"Area {k}", "r", str(k)) for k in range(100))
    people = spark.createDataFrame([("A1", 10)], "sigla string, populacao long")
    df = spark.createDataFrame([("place 1",), ("place 101",), ("place 2",), ("elsewhere",)], "estado_notificacao string")
    as_table = spark.createDataFrame(spellings[:200], "spelling string, sigla string")
    for dim in (AreaDim(areas, spellings, people), AreaDim(areas, as_table, people)):
        assert not dim.is_small
        kept = Filters(areas=("A1",)).apply(df, TB, dim)
        assert kept.count() == 2 and " IN (" not in kept._jdf.queryExecution().optimizedPlan().toString()
        assert clean.attach_area(df, dim).count() == 3


def test_year_presets_and_regions(spark):
    def preset(years, name):
        return sorted(r[0] for r in year_preset(spark.createDataFrame([(y,) for y in years], "ano int"), name).collect())

    years = range(2001, 2027)
    assert preset(years, "last") == [2025]
    assert preset(years, "last3") == [2023, 2024, 2025]
    assert len(preset(years, "last10")) == 10 and len(preset(years, "all")) == 26
    assert preset([2020], "last") == [2020] and preset([], "last3") == []
    assert region_areas("Sul") == ("PR", "RS", "SC") and region_areas("Lua") == ()


def test_legacy_filters_keep_null_form_and_drop_unknown_sex(spark):
    df = spark.createDataFrame(
        [("Feminino", None, None, "Positivo"), ("Ignorado", "Pulmonar", "Parda", "Positivo"), ("Masculino", "Pulmonar", "Nao informado", "Outro"),
         ("Masculino", "Pulmonar", "Nao informado", "Negativo")], "sexo string, forma string, raca_cor string, status_hiv string")
    assert legacy_filters(df, TB).count() == 2
    assert legacy_filters(df, TB, races=["Não informado"]).count() == 2
    assert legacy_filters(df, TB, races=["Parda"]).count() == 0


def test_preset_areas(spark):
    dim = brazil(spark)
    assert dim.population.agg(F.sum("populacao")).first()[0] == 212760988
    assert dim.table.count() == 27 and len(dim.spellings) == 38
    assert set(dim.variants(["SP"])) == {"São Paulo", "Sao Paulo"}
    assert len(tb.EXPORT_COLUMNS) == 37 and tb.AGE_BANDS_17[-1] == ("80+", 80, 199)


def test_numbers_and_days_written_as_text(spark):
    assert values(spark, ["3.0", "12.5", "40000", " 7 ", "3d", "x", None, "-1"], clean.to_small_int) == [3, None, None, 7, None, None, None, -1]
    days = values(spark, ["20240305", "2024-03-05", "20241305", "2024", None], lambda c: clean.to_date(c).cast("string"))
    assert days[:3] == ["2024-03-05", "2024-03-05", None] and days[4] is None


def test_coded_series_have_no_last_year(spark):
    from epispark.operators.coded import lab_confirmation_series

    row = {"nu_ano": "2026", "forma": "1", "tratamento": "1", "situa_ence": "1", "bacilosc_e": "1", "bacilos_e2": "1", "bacilosc_o": "1", "cultura_es": "1", "test_molec": "1"}
    df = spark.createDataFrame([tuple(row.values())], list(row))
    assert lab_confirmation_series(df).first()["nu_ano"] == 2026
    assert lab_confirmation_series(df, ("2001", "2025")).count() == 0


def test_positions_within_large_ties(spark):
    """Most places of an area are equal: positions are still 1 to n, by label."""
    from epispark.operators.rankings import ranked_table

    rows = [("A", 1, f"p{k:04d}") for k in range(900)] + [("A", 5, "z"), ("B", 2, "y"), (None, 2, "n")]
    df = spark.createDataFrame(rows, "uf string, casos int, municipio string").repartition(8)
    got = {(r["uf"], r["municipio"]): r["posicao"] for r in ranked_table(df).collect()}
    assert got == {("A", "z"): 1, ("B", "y"): 1, (None, "n"): 1} | {("A", f"p{k:04d}"): k + 2 for k in range(900)}
