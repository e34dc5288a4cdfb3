"""Files written and read back: layouts, types, refresh rules, exports, features."""

import gzip
import json
from datetime import datetime
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark import TB, Filters, brazil
from epispark.operators.diagnostics import feature_bounds
from epispark.plans.batch import build_treated, history_tables, prepare
from epispark.session import scratch_dir
from epispark.sources import cases as store
from epispark.sources import geo, jdbc, tables

SCHEMA = T.StructType([T.StructField("ano_notificacao", T.IntegerType()), T.StructField("data_notificacao", T.DateType()),
                       T.StructField("sexo", T.StringType()), T.StructField("gestante", T.StringType())])


def write_years(folder):
    """Two loose year files as another tool writes them: nanosecond dates, a missing column, an all-null one."""
    a = pd.DataFrame({"ano_notificacao": pd.array([2001, 2001], "Int16"), "data_notificacao": pd.to_datetime(["2001-03-04", None]),
                      "sexo": ["Feminino", None]})
    b = pd.DataFrame({"ano_notificacao": pd.array([2002], "Int32"), "data_notificacao": pd.to_datetime(["2002-12-31"]),
                      "sexo": ["Masculino"], "gestante": [None], "extra": [1]})
    for year, frame in ((2001, a), (2002, b)):
        frame["data_notificacao"] = frame["data_notificacao"].astype("datetime64[ns]")
        pq.write_table(pa.Table.from_pandas(frame, preserve_index=False), f"{folder}/tuberculose_{year}_tratado.parquet", version="2.6")


def test_loose_year_files(spark, tmp_path):
    write_years(tmp_path)
    rows = store.load_year_files(spark, str(tmp_path), SCHEMA)
    got = sorted((r["ano_notificacao"], str(r["data_notificacao"]), r["sexo"], r["gestante"]) for r in rows.collect())
    assert got == [(2001, "2001-03-04", "Feminino", None), (2001, "None", None, None), (2002, "2002-12-31", "Masculino", None)]
    assert rows.schema == SCHEMA
    assert store.load_year_files(spark, str(tmp_path), SCHEMA, [2002, 2050]).count() == 1
    assert store.load_year_files(spark, str(tmp_path), SCHEMA, [2050]).count() == 0


def test_year_catalog(spark, tmp_path):
    write_years(tmp_path)
    catalog = store.year_files(spark, str(tmp_path)).select("ano").distinct()
    assert store.year_catalog_legacy(catalog) == [2002, 2001] and store.year_catalog_legacy(catalog.limit(0)) == []
    assert store.year_catalog_legacy(catalog, 2001) == [2001]
    assert store.year_catalog_legacy(catalog, 1990) == [1990]


def test_store_replaces_only_the_years_it_gets(spark, tmp_path):
    s = store.CaseStore(spark, f"{tmp_path}/cases", SCHEMA)
    s.write(spark.sql("SELECT 2001 ano_notificacao, date'2001-01-02' data_notificacao, 'a' sexo UNION ALL SELECT 2002, NULL, 'b'"))
    s.write(spark.sql("SELECT 2002 ano_notificacao, NULL data_notificacao, 'c' sexo"))
    assert sorted((r["ano_notificacao"], r["sexo"]) for r in s.all_years().collect()) == [(2001, "a"), (2002, "c")]
    assert s.years([2002, 2050]).count() == 1 and s.between(2000, 2001).count() == 1
    assert sorted(r[0] for r in s.catalog().collect()) == [2001, 2002]


def test_year_predicates_split_heavy_years():
    assert jdbc.year_predicates("ano", [2001, 2002]) == ["ano = '2001'", "ano = '2002'"]
    split = jdbc.year_predicates("ano", [2001], "id", 3)
    assert split == [f"ano = '2001' AND MOD(ABS(COALESCE(id, 0)), 3) = {i}" for i in range(3)]
    assert "group by 1, 2" in jdbc.deaths_query("t") and "like 'A1%'" in jdbc.deaths_query("t")


def test_prepare_acts_on_existing_columns_only(spark):
    raw = spark.sql("SELECT '2001' ano_notificacao, '3 anos' idade_notificada, 'x' sk_sinan_tube, 'ruim' data_digitacao, 's' outra")
    out = prepare(raw)
    assert out.columns == ["ano_notificacao", "data_digitacao", "outra", "idade_anos"]
    assert out.first() == (2001, None, "s", 3)


def test_build_treated_skips_absent_years(spark, tmp_path):
    raw = spark.sql("SELECT '2001' ano_notificacao, 1 x UNION ALL SELECT '2002', 2 UNION ALL SELECT '2003', 3")
    build_treated(raw, f"{tmp_path}/t", [2001, 2002, 2050])
    build_treated(raw.where("x = 2").withColumn("x", F.lit(9)), f"{tmp_path}/t", [2002])
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").select("ano_notificacao", "x").collect()) == [(2001, 1), (2002, 9)]


def test_emptied_years_lose_their_rows(spark, tmp_path):
    raw = spark.sql("SELECT '2001.0' ano_notificacao, 1 x UNION ALL SELECT '2002', 2 UNION ALL SELECT '2003', 3")
    years = lambda: sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/t").select("ano_notificacao").collect())
    build_treated(raw, f"{tmp_path}/t", [2001, 2002, 2003])
    assert years() == [2001, 2002, 2003]
    build_treated(raw.where("x = 1"), f"{tmp_path}/t", [2001, 2002, 2050])
    assert years() == [2001, 2003]


def test_days_do_not_depend_on_the_zone(spark):
    frame = spark.sql("SELECT bigint(unix_date(date'2024-03-05')) * 86400000000000L + 7 data_notificacao UNION ALL SELECT -1L UNION ALL SELECT NULL")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        got = [str(r[0]) for r in store.align(frame, T.StructType([SCHEMA["data_notificacao"]])).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == ["2024-03-05", "1969-12-31", "None"]


def test_split_conditions_cover_every_row():
    import duckdb

    rows = "(VALUES ('2001', 5), ('2001', -1), ('2001', NULL), ('2001', -7), ('2002', 1)) t(ano, id)"
    found = [duckdb.sql(f"SELECT count(*) FROM {rows} WHERE {p}").fetchall()[0][0] for p in jdbc.year_predicates("ano", [2001], "id", 3)]
    assert sum(found) == 4


def test_snapshot_refresh(spark, tmp_path):
    path = f"{tmp_path}/snapshot"
    deaths = spark.sql("SELECT 2001 ano, 'SP' uf, 5L obitos")
    more = spark.sql("SELECT 2001 ano, 'SP' uf, 6L obitos")
    def state(source, day):
        df = tables.snapshot_refresh(spark, path, source, datetime(2024, 1, day))
        return df and (df.first()["obitos"], df.first()["origem"])

    assert state(None, 1) is None
    assert state(deaths, 1) == (5, "atualizado")
    assert state(more, 5) == (5, "fresco")
    assert state(None, 9) == (5, "antigo")
    assert state(more.where("false"), 9) == (5, "antigo")
    assert state(more, 9) == (6, "atualizado")

    def fails():
        raise OSError("no connection")

    broken = deaths.withColumn("obitos", F.expr("bigint(raise_error('lost'))"))
    assert state(fails, 20) == (6, "antigo") and state(broken, 20) == (6, "antigo")
    assert state(deaths, 20) == (5, "atualizado") and state(more, 30) == (6, "atualizado")
    assert len(list((tmp_path / "snapshot").glob("snapshot_at=*"))) == 2


def test_export_keeps_blanks_quotes_and_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(2001, ' a "b", c ', None, "São Paulo"), (2002, "x", "Feminino", "Acre")],
                                 "ano_notificacao int, municipio_notificacao string, sexo string, estado_notificacao string")
    dim = brazil(spark)
    tables.export_microdata(rows, Filters(years=(2001, 2002), areas=("SP",)), dim, f"{tmp_path}/csv")
    back = spark.read.options(**tables.CSV).csv(f"{tmp_path}/csv")
    assert len(back.columns) == 37
    assert back.select("municipio_notificacao", "sexo").first() == (' a "b", c ', None)
    with pytest.raises(ValueError):
        tables.microdata(rows, Filters(years=tuple(range(6))), dim, max_years=5)
    with pytest.raises(ValueError):
        tables.microdata(rows, Filters(), dim, max_years=5)  # no choice of years means all of them
    assert tables.microdata(rows, Filters(years=tuple(range(2000, 2030))), dim).count() == 2


def test_friendly_names(spark):
    assert tables.friendly(spark.sql("SELECT 1 x, 'a' sexo, 2 idade_anos")).columns == ["Idade (anos)", "Sexo"]


def test_history_round_trip(spark, tmp_path):
    assert tables.read_history_csv(spark, str(tmp_path), "anual") is None
    rows = spark.createDataFrame(
        [(2001, "2001-02-03", "São Paulo", "Cura"), (2001, "2001-02-09", "Sao Paulo", "Obito por TB"), (2002, None, "Atlantida", None)],
        "ano_notificacao int, data_notificacao string, estado_notificacao string, situacao_encerramento string")
    for c in (TB.hiv, TB.entry, TB.form, "agravo_aids", "agravo_alcoolismo", "populacao_situacao_rua", "populacao_privada_liberdade"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    tables.write_history_csv(history_tables(rows, brazil(spark), 2001, 2002), str(tmp_path))
    h = tables.load_history(spark, str(tmp_path))
    assert [tuple(r) for r in h["mensal"].collect()] == [(2001, 2, 2)]
    assert [tuple(r) for r in h["estadual"].collect()] == [(2001, "SP", 2)]  # both spellings, one row
    assert sorted(tuple(r) for r in h["anual"].collect()) == [(2001, 2), (2002, 1)]
    ind = {r["nu_ano"]: r for r in tables.read_history_csv(spark, str(tmp_path), "indicadores").collect()}
    assert (ind[2001]["pct_cura"], ind[2001]["pct_obito"], ind[2002]["encerrados"], ind[2002]["pct_cura"]) == (50.0, 50.0, 0, 0.0)


def collection(*features):
    return {"type": "FeatureCollection", "features": list(features)}


def feature(name, kind, coordinates):
    return {"type": "Feature", "properties": {"CD_MUN": "1", "NM_MUN": name, "SIGLA_UF": "AC", "X": "y"},
            "geometry": {"type": kind, "coordinates": coordinates}}


def test_features(spark, tmp_path):
    document = collection(feature(" Acrelândia", "Polygon", [[[-67.5, -9.5], [-66, -9.0], [-67.5, -9.5]]]),
                          feature("B", "MultiPolygon", [[[[-70, -11], [-69, -10.5]]], [[[1, 2]]]]), feature("C", "Point", [0, 3]),
                          feature("D", "LineString", [[5, 0], [6, 0]]))
    (tmp_path / "plain.json").write_text(json.dumps(document, indent=1))
    with gzip.open(tmp_path / "zipped.json.gz", "wt") as f:
        json.dump(document, f)
    for name in ("plain.json", "zipped.json.gz"):
        features = geo.read_features(spark, str(tmp_path / name))
        assert features.count() == 4
        assert tuple(feature_bounds(geo.feature_points(features)).first()) == (-11.0, -70.0, 3.0, 6.0)
    trimmed = geo.trim_features(features)
    geo.write_features(trimmed, f"{tmp_path}/out")
    back = geo.read_trimmed_features(spark, f"{tmp_path}/out")
    first = back.where("properties['NM_MUN'] = ' Acrelândia'").first()
    assert first["properties"] == {"CD_MUN": "1", "NM_MUN": " Acrelândia", "SIGLA_UF": "AC", "NM_MUN_NORM": "acrelandia"}
    assert back.count() == 4 and first["uf"] == "AC"


def test_empty_features_have_the_default_box(spark):
    none = spark.sql("SELECT 0D lon, 0D lat WHERE false")
    assert tuple(feature_bounds(none).first()) == (-34.0, -74.0, 6.0, -28.0)


def test_code_names_and_coordinates(spark, tmp_path):
    (tmp_path / "names.json").write_text(json.dumps({"1200013": "Acrelândia", "9900000": "Fora"}, indent=2, ensure_ascii=False))
    got = {tuple(r) for r in geo.read_code_names(spark, str(tmp_path / "names.json"), brazil(spark)).collect()}
    assert got == {("1200013", "Acrelândia", "AC"), ("9900000", "Fora", None)}
    (tmp_path / "c.csv").write_text("codigo_ibge,nome,latitude,longitude,x\n1200013,Acrelândia,-9.8,-66.9,z\n")
    assert geo.read_coordinates(spark, str(tmp_path / "c.csv")).first() == ("120001", "Acrelândia", -9.8, -66.9)
    assert geo.read_coordinates(spark, str(tmp_path / "none.csv")).count() == 0


def test_scratch_is_below_the_configured_folder():
    def session(**conf):
        settings = {k.replace("_", "."): v for k, v in conf.items()}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)))

    assert scratch_dir(session(spark_checkpoint_dir="hdfs://shared/"), "x").startswith("hdfs://shared/x-")
    with pytest.raises(RuntimeError):
        scratch_dir(session(spark_master="spark://host:7077"), "x")
    for master in ("local-cluster[3,2,1024]", ""):
        with pytest.raises(RuntimeError):
            scratch_dir(session(spark_master=master), "x")
