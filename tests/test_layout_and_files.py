"""Row groups that the curve lets a filter skip, one CSV from many parts, and collections cut between features."""

import csv
import glob
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from epispark import TB, Filters
from epispark.sources import geo, layout, tables
from epispark.sources.cases import CaseStore
from pyspark.sql import types as T

SCHEMA = "case_id long, ano_notificacao int, estado_notificacao string, municipio_notificacao string, data_notificacao date"


def rows_read(df):
    """Rows that the scan hands on after it skipped row groups."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        while leaf.nodeName().startswith("AdaptiveSparkPlan"):
            leaf = leaf.executedPlan()
        metric = leaf.metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(200_000).selectExpr("id AS case_id", "2000 AS ano_notificacao", "concat('A', id % 20) AS estado_notificacao",
                                           "concat('P', (id * 7919) % 400) AS municipio_notificacao", "date_add(DATE '2000-01-01', int((id * 104729) % 366)) AS data_notificacao")


def test_a_place_and_a_month_skip_row_groups(spark, many, tmp_path):
    plain, curved = f"{tmp_path}/plain", f"{tmp_path}/curved"
    small = {"parquet.block.size": str(1 << 16)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many.sortWithinPartitions("estado_notificacao").write.options(**small).partitionBy("ano_notificacao").parquet(plain)
        layout.write_clustered(many, curved, (2000,), group_bytes=1 << 16, places=500)
        wanted = (F.col("municipio_notificacao") == "P7") & F.col("data_notificacao").between("2000-05-01", "2000-05-31")
        found = {name: spark.read.parquet(path).where(wanted) for name, path in (("plain", plain), ("curved", curved))}
        assert found["plain"].count() == found["curved"].count() == many.where(wanted).count() > 0
        reads = {name: rows_read(df.select("case_id", "municipio_notificacao", "data_notificacao")) for name, df in found.items()}
        assert reads["curved"] < 0.2 * reads["plain"]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_bloom_filter_is_written(spark, many, tmp_path):
    # so many places that no dictionary holds them; where one does, it serves in place of the filter
    crowded = many.withColumn("municipio_notificacao", F.concat(F.lit("a rather long name of a place "), "case_id"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        layout.write_clustered(crowded, str(tmp_path), (2000,), places=200_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    store = CaseStore(spark, str(tmp_path), many.schema)
    assert store.all_years().count() == 200_000
    jvm, file = spark._jvm, glob.glob(f"{tmp_path}/ano_notificacao=2000/*.parquet")[0]
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    columns = reader.getFooter().getBlocks().get(0).getColumns()
    filters = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in columns}
    reader.close()
    assert filters["municipio_notificacao"] > 0 and filters["case_id"] <= 0


def test_interleaving():
    with pytest.raises(ValueError):
        layout.interleaved([F.lit(1)] * 8, 8)


def test_curve_positions(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randrange(64) for _ in range(3)) for _ in range(50)]
    got = spark.createDataFrame(rows, "a long, b long, c long").select("a", "b", "c", layout.interleaved([F.col(c) for c in "abc"]).alias("z")).collect()
    for a, b, c, z in got:
        assert z == sum(((x >> i) & 1) << (3 * i + j) for i in range(6) for j, x in enumerate((a, b, c)))


def test_parts_follow_each_other_as_one_csv(spark, tmp_path):
    rng, path = random.Random(2), f"{tmp_path}/one"
    odd = [None, "", 'a "b"', "c,d", "line\nbreak", " e ", "k", "é;", "n"]
    rows = [(k, rng.choice(odd), rng.choice(odd)) for k in range(3000)] + [(9999, "hot", "x")] * 2000
    df = spark.createDataFrame(rows, "k long, `a b` string, n string")
    tables.write_one_csv(df, path, ["a b"], parts=7)
    parts = sorted(glob.glob(f"{path}/part-*"))
    assert len(parts) == 7
    text = "".join(open(p, newline="", encoding="utf-8").read() for p in parts)
    read = list(csv.reader(io.StringIO(text, newline="")))
    assert read[0] == ["k", "a b", "n"] and read.count(read[0]) == 1
    assert sorted(map(tuple, read[1:])) == sorted((str(k), a or "", b or "") for k, a, b in rows)
    assert max(len(open(p, encoding="utf-8").read()) for p in parts) < 0.4 * len(text)
    assert sorted(tables.read_one_csv(spark, path, df.columns).collect(), key=repr) == sorted((T.Row(k=str(k), **{"a b": a or None, "n": b or None}) for k, a, b in rows), key=repr)
    tables.write_one_csv(df.limit(0), f"{tmp_path}/none")
    assert "".join(open(p).read() for p in glob.glob(f"{tmp_path}/none/part-*")) == "k,a b,n\n"


def feature(k):
    kind, shape = [("Point", [k, 1.5]), ("Polygon", [[[k, 0], [k, 1], [k + 1, 1], [k, 0]]]), ("MultiPolygon", [[[[k, 0], [k, 1], [k + 1, 1]]]]),
                   ("LineString", [[k, 0], [k, 2]]), ("MultiLineString", [[[k, 0], [k, 2]]]), ("MultiPoint", [[k, 0], [k, 2]])][k % 6]
    return {"type": "Feature", "properties": {"NM_MUN": f"m {k} \"x\" ]}}, ", "n": k, "list": [{"a": 1}, {"b": [2]}]}, "geometry": {"type": kind, "coordinates": shape}, "id": k}


def flat(shape):
    return [tuple(map(float, shape))] if not isinstance(shape[0], list) else [p for s in shape for p in flat(s)]


@pytest.mark.parametrize("indent", [None, 1])
def test_collections_are_cut_between_features(spark, tmp_path, indent):
    features = [feature(k) for k in range(600)]
    with open(f"{tmp_path}/a.json", "w", encoding="utf-8") as f:
        json.dump({"type": "FeatureCollection", "features": features, "crs": {"type": "name"}}, f, indent=indent)
    with open(f"{tmp_path}/empty.json", "w") as f:
        f.write('{"type": "FeatureCollection", "features": []}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = geo.variant_columns(geo.read_feature_variants(spark, str(tmp_path)))
        assert found.rdd.getNumPartitions() > 4
        got = {r["n"]: (r["name"], r["tipo"]) for r in found.select(F.col("properties")["n"].alias("n"), F.col("properties")["NM_MUN"].alias("name"), "tipo").collect()}
        points = sorted(tuple(r) for r in geo.variant_points(found).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {str(f["id"]): (f["properties"]["NM_MUN"], f["geometry"]["type"]) for f in features}
    assert points == sorted(p for f in features for p in flat(f["geometry"]["coordinates"]))


def test_a_large_collection_on_one_line_is_many_tasks(spark, tmp_path):
    line = '{"type":"Feature","properties":{"SIGLA_UF":"SP"},"geometry":{"type":"Polygon","coordinates":[[' + ",".join(["[-46.123456,-23.654321]"] * 400) + "]]}}"
    with open(f"{tmp_path}/large.json", "w") as f:
        f.write('{"type":"FeatureCollection","features":[' + ",".join([line] * 10_000) + "]}")  # 100 MB
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        pieces = geo.variant_columns(geo.read_feature_variants(spark, f"{tmp_path}/large.json"))
        sizes = [r["n"] for r in pieces.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == 10_000 and len(sizes) >= 4 and max(sizes) < 5_000


def test_a_piece_that_is_no_feature_fails(spark, tmp_path):
    with open(f"{tmp_path}/bad.json", "w") as f:
        f.write('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"kind": "Feature", "x": 1}, "geometry": null}]}')
    with pytest.raises(Exception):
        geo.read_feature_variants(spark, str(tmp_path)).collect()


def test_export_one_csv_is_the_microdata(spark, tmp_path):
    from catalog import views
    from conftest import SF_DIR

    rows, dim, f = views.cases(spark, SF_DIR), views.area_dim(spark, SF_DIR), Filters(years=(1999,))
    tables.export_one_csv(rows, f, dim, str(tmp_path / "x"))
    columns = tables.microdata(rows, f, dim).columns
    assert tables.read_one_csv(spark, str(tmp_path / "x"), columns).count() == rows.where("ano_notificacao = 1999").count()
    assert TB.year in columns and isinstance(rows.schema, T.StructType)
