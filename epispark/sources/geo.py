"""Place names, map features and coordinates as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.functions.text import fold_key
from epispark.spec import AreaDim

FEATURE = "struct<type: string, properties: map<string,string>, geometry: struct<type: string, coordinates: string>>"
KEPT_PROPERTIES = ("CD_MUN", "NM_MUN", "SIGLA_UF")


def code_names(texts: DataFrame, column: str, dim: AreaDim | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(kept columns, codigo, nome[, uf]) from JSON objects ``{code: name}``; the first two digits of
    a code are the area."""
    rows = texts.select(*keep, F.explode(F.from_json(column, "map<string,string>")).alias("codigo", "nome"))
    if dim is None:
        return rows
    codes = dim.hinted(dim.table.select(F.col("codigo").alias("_area"), F.col("sigla").alias("uf")))
    return rows.join(codes, F.expr("left(codigo, 2) = _area"), "left").drop("_area")


def read_code_names(spark: SparkSession, path: str, dim: AreaDim | None = None, one_per_line: bool = False) -> DataFrame:
    """One JSON object per file, or per line."""
    return code_names(spark.read.text(path, wholetext=not one_per_line), "value", dim)


def read_features(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """(properties, tipo, coordenadas), one row per feature, from FeatureCollections, plain or gzip.
    Coordinates stay JSON text because their nesting depends on the geometry type."""
    schema = f"type string, features array<{FEATURE}>"
    collections = spark.read.schema(schema).json(path, multiLine=not one_per_line)
    each = collections.select(F.explode("features").alias("f"))
    if not one_per_line:
        each = each.hint("rebalance")  # a file is read by one task; what follows is not bound to it
    return (each
            .select(F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("tipo"),
                    F.col("f.geometry.coordinates").alias("coordenadas")))


def trim_features(features: DataFrame, keep: Sequence[str] = KEPT_PROPERTIES, name: str = "NM_MUN",
                  area: str = "SIGLA_UF") -> DataFrame:
    """Keeps the listed properties, adds the folded name used for joining, and the area."""
    p = F.col("properties")
    kept = F.map_filter(p, lambda k, _: k.isin(*keep))
    folded = F.create_map(F.lit(f"{name}_NORM"), fold_key(F.coalesce(p[name], F.lit(""))))
    return features.select(F.map_concat(kept, folded).alias("properties"), "tipo", "coordenadas",
                           F.coalesce(p[area], F.lit("?")).alias("uf"))


def write_features(features: DataFrame, path: str) -> None:
    """Gzip JSON, one feature per line, one folder per area."""
    (features.hint("rebalance", F.col("uf")).write.mode("overwrite").partitionBy("uf")
     .option("compression", "gzip").json(path))


def read_trimmed_features(spark: SparkSession, path: str) -> DataFrame:
    schema = "properties map<string,string>, tipo string, coordenadas string, uf string"
    return spark.read.schema(schema).json(path)


def positions(kind: Column, coordinates: Column) -> Column:
    """array<array<double>> of all positions of a geometry."""
    def parsed(depth: int) -> Column:
        return F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)

    lines = F.flatten(parsed(3))
    return (F.when(kind == "Point", F.array(parsed(1)))
            .when(kind.isin("MultiPoint", "LineString"), parsed(2))
            .when(kind == "MultiPolygon", F.flatten(F.flatten(parsed(4))))
            .otherwise(lines))


#: What stands between two features of a collection: the value of the key that each begins with.
BOUNDARY = '"Feature"'
#: Kind of geometry -> nesting of its positions.
NESTING = {"Point": 0, "MultiPoint": 1, "LineString": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}


def read_feature_variants(spark: SparkSession, path: str) -> DataFrame:
    """(feicao): each feature of FeatureCollections as a VARIANT, parsed once.

    A collection of any size, on one line or many, is cut between its features by the splittable text reader, so
    an uncompressed file of many GB is read by as many tasks as it has splits. Every feature must begin with its
    type, as map tools write it, and ``"Feature"`` must not be another value; a piece that is no feature then
    fails the read rather than being passed over. A gzip file is one task whatever the reader."""
    pieces = spark.read.option("lineSep", BOUNDARY).text(path)
    # what stands before the first feature begins a collection, not a feature
    opened = F.concat(F.lit('{"type": ' + BOUNDARY), F.col("value"))
    # the parser ends with the feature; the beginning of the next one, or the end of the collection, is not read
    return pieces.where(~F.ltrim(F.col("value")).startswith("{")).select(F.parse_json(opened).alias("feicao"))


def variant_columns(variants: DataFrame) -> DataFrame:
    """(properties, tipo, geometria) of features: properties as text by name, the geometry's kind and its coordinates as a VARIANT."""
    f = F.col("feicao")
    return variants.select(F.try_variant_get(f, "$.properties", "map<string,string>").alias("properties"),
                           F.try_variant_get(f, "$.geometry.type", "string").alias("tipo"),
                           F.try_variant_get(f, "$.geometry.coordinates", "variant").alias("geometria"))


def variant_points(features: DataFrame) -> DataFrame:
    """(lon, lat) of every position, from coordinates that are not parsed again: only the kind at hand is cast."""
    def at(depth: int) -> Column:
        c = F.try_variant_get("geometria", "$", "array<" * (depth + 1) + "double" + ">" * (depth + 1))
        for _ in range(depth - 1):
            c = F.flatten(c)
        return F.array(c) if depth == 0 else c

    kinds = F.lit(None).cast("array<array<double>>")
    for kind, depth in NESTING.items():
        kinds = F.when(F.col("tipo") == kind, at(depth)).otherwise(kinds)
    points = features.select(F.explode(kinds).alias("p"))
    return points.select(F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def feature_points(features: DataFrame) -> DataFrame:
    """(lon, lat) of every position of every feature."""
    points = features.select(F.explode(positions(F.col("tipo"), F.col("coordenadas"))).alias("p"))
    return points.select(F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def join_features(features: DataFrame, indicators: DataFrame, keys: Sequence[str],
                  measures: Sequence[str]) -> DataFrame:
    """Every feature with its indicators; features without any get 0."""
    out = features.join(indicators.select(*keys, *measures), list(keys), "left")
    return out.fillna(0, subset=list(measures))


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(codigo_6, nome, latitude, longitude): six-digit code from the seven-digit one. Without the
    file the table is empty."""
    try:
        rows = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], "codigo_ibge string, nome string, latitude string, longitude string")
    return rows.select(F.substring("codigo_ibge", 1, 6).alias("codigo_6"), "nome",
                       F.col("latitude").try_cast("double").alias("latitude"),
                       F.col("longitude").try_cast("double").alias("longitude"))
