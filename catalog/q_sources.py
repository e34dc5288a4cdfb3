"""Sources and sinks: written to the shared scratch folder and read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.register import fold, query
from catalog.views import append, area_dim, cases, raw, registry, table, yearly_parts, years
from epispark.functions.filters import Filters
from epispark.operators.diagnostics import column_profile, feature_bounds
from epispark.operators.history import history_monthly
from epispark.operators.registry import map_deaths, registry_deaths_year_area
from epispark.literals import literal_rows
from epispark.plans.batch import build_treated, read_history, write_history
from epispark.plans.composites import export as composite
from epispark.plans.treat import rejects, treat
from epispark.presets import tuberculosis as tb
from epispark.session import scratch_dir
from epispark.sources import cases as store
from epispark.sources import geo, jdbc, layout, tables

SCAN = ("case_id", "ano_notificacao", "sexo", "forma")
SCAN_SCHEMA = T.StructType([T.StructField("case_id", T.LongType()), T.StructField("ano_notificacao", T.IntegerType()),
                            T.StructField("sexo", T.StringType()), T.StructField("forma", T.StringType()),
                            T.StructField("raio_x_torax", T.StringType())])


_stored: dict[tuple[str, str], str] = {}


def stored(spark, sf):
    """The case table in year folders, written once per application and input."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stored:
        path = scratch_dir(spark, "cases")
        store.CaseStore(spark, path, SCAN_SCHEMA).write(cases(spark, sf, *SCAN))
        _stored[key] = path
    return store.CaseStore(spark, _stored[key], SCAN_SCHEMA)


@query("scan_years", """SELECT case_id, ano_notificacao, sexo, forma, CAST(NULL AS VARCHAR) AS raio_x_torax
FROM cases WHERE ano_notificacao IN (1999, 2000)""")
def scan_years(spark, sf):
    return stored(spark, sf).years((1999, 2000, 2050))


@query("scan_all_years", """SELECT case_id, ano_notificacao, sexo, forma, CAST(NULL AS VARCHAR) AS raio_x_torax
FROM cases""")
def scan_all_years(spark, sf):
    return stored(spark, sf).all_years()


@query("scan_projected", """SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(NULL AS VARCHAR) AS ausente FROM orders""")
def scan_projected(spark, sf):
    return store.scan_projected(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice", "ausente"])


@query("scan_all_columns", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders""")
def scan_all_columns(spark, sf):
    rows = table(spark, sf, "orders")
    return rows.withColumn("o_orderdate", F.to_date("o_orderdate").cast("string"))


@query("year_catalog", "SELECT DISTINCT ano_notificacao AS ano FROM cases")
def year_catalog(spark, sf):
    return stored(spark, sf).catalog()


@query("clustered_cases", """SELECT case_id, ano_notificacao, estado_notificacao, municipio_notificacao, CAST(data_notificacao AS VARCHAR) AS data_notificacao
FROM cases WHERE estado_notificacao = 'NATION_3' AND mes = 5 AND municipio_notificacao = (SELECT min(municipio_notificacao) FROM cases WHERE estado_notificacao = 'NATION_3')""")
def clustered_cases(spark, sf):
    """One place, one area and one month through the copy that is ordered along the curve."""
    path = scratch_dir(spark, "clustered")
    rows = cases(spark, sf, "case_id", "ano_notificacao", "estado_notificacao", "municipio_notificacao", "data_notificacao")
    layout.write_clustered(rows, path, years(spark, sf))
    copy = spark.read.parquet(path)
    place = copy.where("estado_notificacao = 'NATION_3'").agg(F.min("municipio_notificacao")).scalar()
    found = copy.where((F.col("estado_notificacao") == "NATION_3") & (F.month("data_notificacao") == 5) & (F.col("municipio_notificacao") == place))
    return found.withColumn("data_notificacao", F.col("data_notificacao").cast("string"))


@query("extract_by_year", """SELECT ano_notificacao, count(*) AS n FROM raw
WHERE ano_notificacao IN ('1998', '1999', '2000') GROUP BY 1""")
def extract_by_year(spark, sf):
    path = scratch_dir(spark, "extract")
    source = raw(spark, sf)
    jdbc.extract_by_year(source, path, (1998, 1999))
    jdbc.extract_by_year(source, path, (1999, 2000))  # a repeated year is replaced, not doubled
    back = spark.read.parquet(path)
    return back.groupBy(F.col("ano_notificacao").cast("string").alias("ano_notificacao")).agg(F.count(F.lit(1)).alias("n"))


@query("extract_emptied_year", """SELECT ano_notificacao, count(*) AS n FROM raw
WHERE ano_notificacao IN ('1998', '2000') GROUP BY 1""")
def extract_emptied_year(spark, sf):
    """A year whose rows have gone from the source is gone from the extract after the next run."""
    path, source = scratch_dir(spark, "extract"), raw(spark, sf)
    jdbc.extract_by_year(source, path, (1998, 1999, 2000))
    jdbc.extract_by_year(source.where("ano_notificacao <> '1999'"), path, (1999, 2000))
    back = spark.read.parquet(path)
    return back.groupBy(F.col("ano_notificacao").cast("string").alias("ano_notificacao")).agg(F.count(F.lit(1)).alias("n"))


TREATED = """SELECT case_id, ano_notificacao, CAST(data_notificacao AS VARCHAR) AS data_notificacao, idade_anos,
numero_contatos FROM treated"""


@query("prepare_by_year", TREATED + " WHERE ano_notificacao BETWEEN 1996 AND 1999")
def prepare_by_year(spark, sf):
    path = scratch_dir(spark, "treated")
    build_treated(raw(spark, sf), path, (1996, 1997, 1998, 1999, 2050))
    return spark.read.parquet(path).withColumn("data_notificacao", F.col("data_notificacao").cast("string"))


@query("build_treated", TREATED)
def treated(spark, sf):
    path = scratch_dir(spark, "treated")
    build_treated(raw(spark, sf), path, years(spark, sf))
    return spark.read.parquet(path).withColumn("data_notificacao", F.col("data_notificacao").cast("string"))


def unclean(spark, sf):
    """Raw rows, some without a year or with one that is no number or was not asked for."""
    return raw(spark, sf).withColumn("ano_notificacao", F.expr(
        "CASE WHEN case_id % 53 = 0 THEN 'ano ?' WHEN case_id % 59 = 0 THEN NULL WHEN case_id % 61 = 0 THEN concat(ano_notificacao, '.5') "
        "WHEN case_id % 67 = 0 THEN '1890' WHEN case_id % 71 = 0 THEN ' ' ELSE ano_notificacao END"))


MOTIVE = """CASE WHEN case_id % 53 = 0 THEN 'ano ilegível' WHEN case_id % 59 = 0 THEN 'sem ano' WHEN case_id % 61 = 0 THEN 'ano ilegível'
WHEN case_id % 67 = 0 THEN 'ano não pedido' WHEN case_id % 71 = 0 THEN 'sem ano' END"""


@query("treated_with_rejects", f"""SELECT 'linhas' AS origem, coalesce({MOTIVE}, 'aceitas') AS motivo, count(*) AS n FROM raw GROUP BY 2
UNION ALL SELECT 'contadas', coalesce({MOTIVE}, 'aceitas'), count(*) FROM raw GROUP BY 2 UNION ALL SELECT 'contadas', 'lidas', count(*) FROM raw""")
def treated_with_rejects(spark, sf):
    """Rows found in the two tables, and what the job counted while it wrote them."""
    path = scratch_dir(spark, "treated")
    account = treat(unclean(spark, sf), path, years(spark, sf))
    counts = [("contadas", "lidas", account.read), ("contadas", "aceitas", account.accepted), *[("contadas", r, n) for r, n in account.rejected.items()]]
    cases_found = spark.read.schema("case_id long").parquet(f"{path}/destino=casos").agg(F.count(F.lit(1)).alias("n"))
    return (literal_rows(spark, counts, "origem string, motivo string, n long")
            .unionByName(rejects(spark, path).groupBy(F.lit("linhas").alias("origem"), "motivo").agg(F.count(F.lit(1)).alias("n")))
            .unionByName(cases_found.select(F.lit("linhas").alias("origem"), F.lit("aceitas").alias("motivo"), "n")))


@query("treated_losses", f"""SELECT 'data_notificacao' AS coluna, count(*) FILTER (try_cast(data_notificacao AS DATE) IS NULL) AS n FROM raw WHERE {MOTIVE} IS NULL
UNION ALL SELECT 'numero_contatos', count(*) FILTER (try_cast(numero_contatos AS SMALLINT) IS NULL) FROM raw WHERE {MOTIVE} IS NULL
UNION ALL SELECT 'idade_notificada', count(*) FILTER (idade_notificada = 'sem informação') FROM raw WHERE {MOTIVE} IS NULL""")
def treated_losses(spark, sf):
    """Values of accepted rows that the treatment could not read, by column."""
    account = treat(unclean(spark, sf), scratch_dir(spark, "treated"), years(spark, sf))
    return literal_rows(spark, list(account.lost.items()), "coluna string, n long")


@query("rejected_rows", f"SELECT case_id, {MOTIVE} AS motivo FROM raw WHERE {MOTIVE} IS NOT NULL")
def rejected_rows(spark, sf):
    """The raw rows can be read back from the rejected ones."""
    path = scratch_dir(spark, "treated")
    treat(unclean(spark, sf), path, years(spark, sf))
    return rejects(spark, path).select(F.from_json("linha", "case_id long")["case_id"].alias("case_id"), "motivo")


def deaths(spark, sf):
    return registry_deaths_year_area(registry(spark, sf), area_dim(spark, sf))


@query("read_registry_deaths", "SELECT ano, uf, obitos FROM deaths")
def read_registry_deaths(spark, sf):
    """The database aggregates by raw code; what it would send is mapped here."""
    raw_counts = registry(spark, sf).where("causabas LIKE 'A1%' AND length(trim(codmunres)) >= 2").groupBy(
        F.substring("dtobito", 5, 4).alias("ano_txt"), F.substring("codmunres", 1, 2).alias("codigo")).agg(F.count(F.lit(1)).alias("obitos"))
    return map_deaths(raw_counts, area_dim(spark, sf))


@query("read_snapshot_csv", "SELECT ano, uf, obitos FROM deaths")
def read_snapshot_csv(spark, sf):
    path = scratch_dir(spark, "snapshot")
    tables.write_snapshot_csv(deaths(spark, sf), path)
    return tables.read_snapshot_csv(spark, path)


@query("snapshot_refresh", "SELECT ano, uf, obitos, '20010901T000000' AS snapshot_at, 'atualizado' AS origem FROM deaths")
def snapshot_refresh(spark, sf):
    return tables.snapshot_refresh(spark, scratch_dir(spark, "snapshot"), deaths(spark, sf), datetime(2001, 9, 1))


def written_history(spark, sf):
    folder = scratch_dir(spark, "history")
    rows, dim = cases(spark, sf), area_dim(spark, sf)
    # Two passes over the cases write the history; the CSV files are copies of it.
    known = years(spark, sf)
    write_history(rows, dim, f"{folder}/gold", known[0], known[-1])
    tables.write_history_csv(read_history(spark, f"{folder}/gold"), folder)
    return folder


@query("write_history_csv", """SELECT 'anual' AS tabela, ano_notificacao AS nu_ano, '-' AS chave, count(*) AS casos FROM cases GROUP BY 2
UNION ALL SELECT 'estadual', ano_notificacao, uf, count(*) FROM cases WHERE uf IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'mensal', ano_notificacao, CAST(mes AS VARCHAR), count(*) FROM cases GROUP BY 2, 3""")
def write_history_csv(spark, sf):
    t = tables.load_history(spark, written_history(spark, sf))
    return append([
        t["anual"].select(F.lit("anual").alias("tabela"), "nu_ano", F.lit("-").alias("chave"), "casos"),
        t["estadual"].select(F.lit("estadual").alias("tabela"), "nu_ano", F.col("uf_sigla").alias("chave"), "casos"),
        t["mensal"].select(F.lit("mensal").alias("tabela"), "nu_ano", F.col("mes_num").cast("string").alias("chave"), "casos")])


@query("read_history_csv", """SELECT ano_notificacao AS nu_ano, mes AS mes_num, count(*) AS casos FROM cases GROUP BY 1, 2""")
def read_history_csv(spark, sf):
    folder = scratch_dir(spark, "history")
    rows = cases(spark, sf, "ano_notificacao", "data_notificacao")
    tables.write_history_csv({"mensal": history_monthly(rows)}, folder)
    if tables.read_history_csv(spark, folder, "anual") is not None or tables.load_history(spark, folder) is not None:
        raise AssertionError("a table that was never written must be none")
    return tables.read_history_csv(spark, folder, "mensal")


EXPORT_SQL = "SELECT " + ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" if c not in ("uf_residencia", "uso_antirretroviral", "raio_x_torax", "cultura_escarro",
                                                "histopatologia", "teste_sensibilidade", "tratamento_supervisionado")
    else f"CAST(NULL AS VARCHAR) AS {c}" for c in tb.EXPORT_COLUMNS
) + " FROM cases WHERE ano_notificacao BETWEEN 1997 AND 2001 AND sexo = 'Feminino'"
EXPORT_FILTER = Filters(years=(1997, 1998, 1999, 2000, 2001), sexes=("Feminino",))


def read_back(spark, path):
    return spark.read.options(**tables.CSV).csv(path)


@query("export_microdata", EXPORT_SQL)
def export_microdata(spark, sf):
    path = scratch_dir(spark, "export")
    tables.export_microdata(cases(spark, sf), EXPORT_FILTER, area_dim(spark, sf), path)
    return read_back(spark, path)


@query("export_one_csv", EXPORT_SQL)
def export_one_csv(spark, sf):
    """Parts that follow each other as one file, read back."""
    path, rows, dim = scratch_dir(spark, "export"), cases(spark, sf), area_dim(spark, sf)
    tables.export_one_csv(rows, EXPORT_FILTER, dim, path)
    return tables.read_one_csv(spark, path, tables.microdata(rows, EXPORT_FILTER, dim).columns)


@query("export", EXPORT_SQL)
def export(spark, sf):
    rows = composite(cases(spark, sf), area_dim(spark, sf), EXPORT_FILTER)
    return rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])


@query("export_friendly_csv", """SELECT estado_notificacao AS "Estado", CAST(ano_notificacao AS VARCHAR) AS "Ano",
sexo AS "Sexo", raca_cor AS "Raca/Cor", situacao_encerramento AS "Situacao Encerramento", agravo_aids AS "Agravo AIDS" FROM cases""")
def export_friendly_csv(spark, sf):
    path = scratch_dir(spark, "friendly")
    rows = cases(spark, sf, "case_id", "estado_notificacao", "ano_notificacao", "sexo", "raca_cor",
                 "situacao_encerramento", "agravo_aids")
    tables.export_friendly_csv(rows, path)
    return read_back(spark, path)


@query("read_code_names", """SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS codigo,
c_name AS nome, sigla AS uf FROM customer LEFT JOIN area_dim ON codigo = lpad(CAST(c_nationkey AS VARCHAR), 2, '0')""")
def read_code_names(spark, sf):
    path = scratch_dir(spark, "names")
    code = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    rows = table(spark, sf, "customer").select(F.to_json(F.create_map(code, F.col("c_name"))).alias("value"))
    rows.write.text(path)
    return geo.read_code_names(spark, path, area_dim(spark, sf), one_per_line=True)


@query("json_code_names", "SELECT event_id, 'k' AS codigo, props ->> 'k' AS nome FROM events")
def json_code_names(spark, sf):
    rows = table(spark, sf, "events")
    return geo.code_names(rows, "props", keep=["event_id"])


def write_collections(spark, sf):
    """A FeatureCollection per supplier: a unit square, as Polygon or MultiPolygon."""
    path = scratch_dir(spark, "features")
    rows = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("cd"), F.concat(F.lit(" Município "), "s_name").alias("nm"),
        F.concat(F.lit("N"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("uf"),
        (F.col("s_suppkey") % 60 - 70).alias("x"), (F.col("s_nationkey") - 25).alias("y"))
    ring = ("[[%1$d.5, %2$d.25], [%3$d.5, %2$d.25], [%3$d.5, %4$d.25], [%1$d.5, %4$d.25], [%1$d.5, %2$d.25]]")
    square = F.format_string("[" + ring + "]", F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1)
    several = F.concat(F.lit("["), square, F.lit("]"))
    multi = F.col("cd").try_cast("long") % 3 == 0
    feature = F.concat(
        F.lit('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": '),
        F.to_json(F.create_map(F.lit("CD_MUN"), "cd", F.lit("NM_MUN"), "nm", F.lit("SIGLA_UF"), "uf", F.lit("AREA"), F.lit("1"))),
        F.lit(', "geometry": {"type": '), F.when(multi, '"MultiPolygon"').otherwise('"Polygon"'),
        F.lit(', "coordinates": '), F.when(multi, several).otherwise(square), F.lit("}}]}"))
    rows.select(feature.alias("value")).write.option("compression", "gzip").text(path)
    return path


KIND = "CASE WHEN s_suppkey % 3 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END"


@query("read_features", f"""SELECT CAST(s_suppkey AS VARCHAR) AS cd_mun, ' Município ' || s_name AS nm_mun, {KIND} AS tipo FROM supplier""")
def read_features(spark, sf):
    f = geo.read_features(spark, write_collections(spark, sf), one_per_line=True)
    p = F.col("properties")
    return f.select(p["CD_MUN"].alias("cd_mun"), p["NM_MUN"].alias("nm_mun"), "tipo")


@query("trim_features", f"""SELECT CAST(s_suppkey AS VARCHAR) AS cd_mun, {fold("'Município ' || s_name")} AS nm_mun_norm,
CAST(4 AS INTEGER) AS propriedades, 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS uf, {KIND} AS tipo FROM supplier""")
def trim_features(spark, sf):
    path = scratch_dir(spark, "trimmed")
    geo.write_features(geo.trim_features(geo.read_features(spark, write_collections(spark, sf), one_per_line=True)), path)
    p = F.col("properties")
    return geo.read_trimmed_features(spark, path).select(
        p["CD_MUN"].alias("cd_mun"), p["NM_MUN_NORM"].alias("nm_mun_norm"), F.size(p).alias("propriedades"), "uf", "tipo")


@query("feature_bounds", """SELECT min(s_nationkey) - 25.25::DOUBLE AS sul, min(s_suppkey % 60) - 70.5::DOUBLE AS oeste,
CASE WHEN max(s_nationkey) = 24 THEN 0.25::DOUBLE ELSE max(s_nationkey) - 24.25::DOUBLE END AS norte,
max(s_suppkey % 60) - 69.5::DOUBLE AS leste FROM supplier""")
def bounds(spark, sf):
    return feature_bounds(geo.feature_points(geo.read_features(spark, write_collections(spark, sf), one_per_line=True)))


def write_one_collection(spark, sf):
    """All suppliers as one FeatureCollection on one line of one file: what a map server hands out, and the reader has to cut."""
    path = scratch_dir(spark, "collection")
    each = spark.read.text(write_collections(spark, sf)).select(F.regexp_extract("value", r"^.*?\[(\{.*\})\]\}$", 1).alias("value"))
    rows = each.select(F.lit(1).alias("k"), F.concat(F.lit(", "), "value").alias("value"))
    head = spark.range(1).select(F.lit(0).alias("k"), F.lit('{"type": "FeatureCollection", "name": "m", "features": [{"type": "Feature", "properties": {"CD_MUN": "x"}, "geometry": null}').alias("value"))
    tail = spark.range(1).select(F.lit(2).alias("k"), F.lit('], "crs": {"type": "name", "properties": {"name": "EPSG:4326"}}}').alias("value"))
    rows.unionByName(head).unionByName(tail).repartition(1).sortWithinPartitions("k").select("value").write.option("lineSep", " ").text(path)
    return path


@query("read_split_features", f"""SELECT CAST(s_suppkey AS VARCHAR) AS cd_mun, ' Município ' || s_name AS nm_mun, {KIND} AS tipo FROM supplier
UNION ALL SELECT 'x', NULL, NULL""")
def read_split_features(spark, sf):
    f = geo.variant_columns(geo.read_feature_variants(spark, write_one_collection(spark, sf)))
    p = F.col("properties")
    return f.select(p["CD_MUN"].alias("cd_mun"), p["NM_MUN"].alias("nm_mun"), "tipo")


@query("feature_bounds_variant", """SELECT min(s_nationkey) - 25.25::DOUBLE AS sul, min(s_suppkey % 60) - 70.5::DOUBLE AS oeste,
CASE WHEN max(s_nationkey) = 24 THEN 0.25::DOUBLE ELSE max(s_nationkey) - 24.25::DOUBLE END AS norte,
max(s_suppkey % 60) - 69.5::DOUBLE AS leste FROM supplier""")
def bounds_variant(spark, sf):
    return feature_bounds(geo.variant_points(geo.variant_columns(geo.read_feature_variants(spark, write_one_collection(spark, sf)))))


@query("read_coordinates", """SELECT substr(lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey AS VARCHAR), 5, '0'), 1, 6) AS codigo_6,
s_name AS nome, s_acctbal AS latitude, -s_acctbal AS longitude FROM supplier""")
def read_coordinates(spark, sf):
    path = scratch_dir(spark, "coordinates")
    s = table(spark, sf, "supplier")
    code = F.concat(F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"))
    s.select(code.alias("codigo_ibge"), F.col("s_name").alias("nome"), F.col("s_acctbal").alias("latitude"),
             (-F.col("s_acctbal")).alias("longitude")).write.option("header", True).csv(path)
    return geo.read_coordinates(spark, path)


@query("column_profile", """SELECT CAST(row_number() OVER () AS INTEGER) AS posicao, coluna, tipo, preenchidos FROM (
SELECT 'o_orderkey' AS coluna, 'bigint' AS tipo, count(o_orderkey) AS preenchidos FROM orders
UNION ALL SELECT 'o_custkey', 'bigint', count(o_custkey) FROM orders
UNION ALL SELECT 'o_orderstatus', 'string', count(o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', 'double', count(o_totalprice) FROM orders
UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', count(o_orderdate) FROM orders
UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority) FROM orders)""")
def profile(spark, sf):
    return column_profile(table(spark, sf, "orders")).drop("distintos_aprox")


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("column_profile_distincts", " UNION ALL ".join(
    f"SELECT '{c}' AS coluna, count(DISTINCT {c}) AS distintos, true AS perto FROM orders" for c in ORDER_COLUMNS))
def profile_distincts(spark, sf):
    """The sketched number of distinct values is within a sixth of the exact one (three standard errors)."""
    rows = table(spark, sf, "orders")
    exact = rows.agg(*[F.countDistinct(c).alias(c) for c in ORDER_COLUMNS]).unpivot([], list(ORDER_COLUMNS), "coluna", "distintos")
    found = column_profile(rows).join(exact, "coluna")
    near = F.abs(F.col("distintos_aprox") - F.col("distintos")) <= F.col("distintos") / 6
    return found.select("coluna", "distintos", near.alias("perto"))


@query("union_by_name", """SELECT case_id, ano_notificacao, CASE WHEN ano_notificacao >= 1998 THEN sexo END AS sexo,
CASE WHEN ano_notificacao < 2000 THEN forma END AS forma FROM cases""")
def union_by_name(spark, sf):
    """Year files with differing columns and types, read back as one table."""
    folder = scratch_dir(spark, "files")
    rows = cases(spark, sf, "case_id", "ano_notificacao", "sexo", "forma")
    every = years(spark, sf)
    for year, part in zip(every, yearly_parts(rows, "ano_notificacao", every)):
        part = part.drop("sexo") if year < 1998 else part
        part = part.drop("forma") if year >= 2000 else part
        kind = "smallint" if year % 2 else "string"
        part = part.withColumn("ano_notificacao", F.col("ano_notificacao").cast(kind))
        part.write.parquet(f"{folder}/tuberculose_{year}_tratado.parquet")
    schema = T.StructType([f for f in SCAN_SCHEMA if f.name != "raio_x_torax"])
    return store.load_year_files(spark, folder, schema)

