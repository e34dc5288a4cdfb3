"""Small published tables: history, death snapshot; and the microdata exports."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.functions.filters import Filters, resolve
from epispark.presets import tuberculosis as tb
from epispark.sources.cases import align, case_schema, drop_folders
from epispark.spec import TB, AreaDim, CaseSpec

log = logging.getLogger(__name__)
SNAPSHOT_TTL = timedelta(days=7)
SNAPSHOT_SCHEMA = "ano int, uf string, obitos long"

_COUNTS = ("hiv_pos", "hiv_testado", "cura", "abandono", "obito_tb", "encerrados", "caso_novo",
           "pulmonar", "aids", "alcool", "pop_rua", "pop_liber")
_RATIOS = ("pct_hiv", "pct_test_hiv", "pct_cura", "pct_abandon", "pct_obito", "pct_novo", "pct_pulm",
           "pct_aids", "pct_alcool")
HISTORY_SCHEMAS = {
    "mensal": "nu_ano int, mes_num int, casos long",
    "estadual": "nu_ano int, uf_sigla string, casos long",
    "anual": "nu_ano int, casos long",
    "indicadores": ", ".join(["nu_ano int", "total long", *[f"{c} long" for c in _COUNTS],
                              *[f"{c} double" for c in _RATIOS]]),
}


# Blanks inside values are data, and quotes are doubled as other tools expect.
CSV = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "escape": '"'}


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV).csv(path)


def _read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).options(**CSV).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def write_history_csv(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One CSV folder per table, columns in the declared order, header included."""
    for name, table in tables.items():
        columns = [part.split()[0] for part in HISTORY_SCHEMAS[name].split(", ")]
        _write_csv(table.select(*columns), f"{folder}/historico_{name}")


def read_history_csv(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A history table by name; none when it was never written."""
    return _read_csv(spark, f"{folder}/historico_{name}", HISTORY_SCHEMAS[name])


def load_history(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """Older rule: the three count tables, or none of them."""
    tables = {name: read_history_csv(spark, folder, name) for name in ("mensal", "estadual", "anual")}
    return None if any(t is None for t in tables.values()) else tables


def write_snapshot_csv(deaths: DataFrame, path: str) -> None:
    _write_csv(deaths.select("ano", "uf", "obitos"), path)


def read_snapshot_csv(spark: SparkSession, path: str) -> DataFrame | None:
    return _read_csv(spark, path, SNAPSHOT_SCHEMA)


def snapshot_refresh(spark: SparkSession, path: str, source: DataFrame | Callable[[], DataFrame] | None, now: datetime,
                     ttl: timedelta = SNAPSHOT_TTL) -> DataFrame | None:
    """Death snapshot with its ``snapshot_at`` and ``origem`` ('fresco', 'atualizado', 'antigo').

    A snapshot younger than ``ttl`` is used as is; otherwise the source is queried and a new
    snapshot is added next to the old one, which stays valid until the new one is complete;
    without a source, or when it fails or gives no rows, the old one is returned; without any, none.
    ``source`` may be a function, so that a failure to connect counts as well. Snapshots before the
    last two are removed."""
    stored = f"{SNAPSHOT_SCHEMA}, snapshot_at string"
    try:
        table = spark.read.schema(stored).parquet(path)
        latest = table.agg(F.max("snapshot_at")).first()[0]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        latest = None

    def at(moment: str, origin: str) -> DataFrame:
        rows = spark.read.schema(stored).parquet(path).where(F.col("snapshot_at") == moment)
        return rows.withColumn("origem", F.lit(origin))

    layout = "%Y%m%dT%H%M%S"
    if latest and now - datetime.strptime(latest, layout) < ttl:
        return at(latest, "fresco")
    if source is not None:
        moment = now.strftime(layout)
        try:
            rows = source() if callable(source) else source
            (rows.select("ano", "uf", "obitos").withColumn("snapshot_at", F.lit(moment))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_at").parquet(path))
        except Exception:  # whatever the source raises: an old snapshot is better than none
            log.exception("the death registry could not be read")
        else:
            # Without rows no partition folder appears, and the older snapshot goes on being used.
            fresh = at(moment, "atualizado")
            if not fresh.isEmpty():
                drop_folders(spark, path, "snapshot_at", keep=lambda stamp: stamp >= (latest or moment))
                return fresh
    return at(latest, "antigo") if latest else None


def microdata(df: DataFrame, filters: Filters, dim: AreaDim, spec: CaseSpec = TB,
              max_years: int | None = None) -> DataFrame:
    """Filtered rows with the fixed export columns. A request layer may pass ``max_years``, and then
    a request for more years, or for all, is refused."""
    if max_years is not None and not 0 < len(filters.years) <= max_years:
        raise ValueError(f"export is limited to {max_years} years at a time")
    filters = resolve(df, filters, spec, dim)
    return align(filters.apply(df, spec, dim), case_schema(tb.EXPORT_COLUMNS))


def export_microdata(df: DataFrame, filters: Filters, dim: AreaDim, path: str, spec: CaseSpec = TB) -> None:
    """CSV parts written in parallel; every part carries the same header."""
    _write_csv(microdata(df, filters, dim, spec), path)


def write_one_csv(df: DataFrame, path: str, order: Sequence[str] = (), parts: int | None = None) -> None:
    """One CSV written in parallel: its parts, in the order of their names, follow each other as one valid file.

    Rows are ranged by ``order``, those of one key by a hash of the whole row, so that a hot key is many tasks' (only
    rows equal in every column stay together); values are rendered as the CSV writer would. The header is a row before all others, so it is in the
    first part and nowhere else. Nothing is merged."""
    spark = df.sparkSession
    columns = [F.col(f"`{c}`") for c in df.columns]
    options = {k: v for k, v in CSV.items() if k != "header"}
    texts = F.struct(*[c.cast("string").alias(f"c{k}") for k, c in enumerate(columns)])
    head = F.to_csv(F.struct(*[F.lit(c).alias(f"c{k}") for k, c in enumerate(df.columns)]), options)
    keys = [F.col(f"`{c}`") for c in order]
    rows = df.select(F.to_csv(texts, options).alias("value"), F.lit(1).alias("_row"), F.struct(*keys, F.xxhash64(*columns)).alias("_key"))
    first = spark.range(1).select(head.alias("value"), F.lit(0).alias("_row"), F.lit(None).cast(rows.schema["_key"].dataType).alias("_key"))
    both = rows.unionByName(first)
    ranged = both.repartitionByRange("_row", "_key") if parts is None else both.repartitionByRange(parts, "_row", "_key")
    ranged.sortWithinPartitions("_row", "_key").select("value").write.mode("overwrite").text(path)


def read_one_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The rows of ``write_one_csv`` as text, all parts in parallel; as with Spark's CSV reader, empty text reads as null. The one line that is the header is left out; a row of
    data that reads just like it would be, too."""
    schema = ", ".join(f"c{k} string" for k in range(len(columns)))
    rows = spark.read.schema(schema).options(**CSV | {"header": "false"}).option("multiLine", True).csv(path)
    header = reduce(and_, [F.col(f"c{k}").eqNullSafe(F.lit(c)) for k, c in enumerate(columns)])
    return rows.where(~header).toDF(*columns)


def export_one_csv(df: DataFrame, filters: Filters, dim: AreaDim, path: str, spec: CaseSpec = TB) -> None:
    """The microdata of a request as one CSV in parallel parts."""
    write_one_csv(microdata(df, filters, dim, spec), path, (spec.year, spec.area))


def friendly(df: DataFrame, names: Mapping[str, str] = tb.FRIENDLY_NAMES) -> DataFrame:
    """Analysis columns the table has, under their friendly names."""
    return df.select(*[F.col(c).alias(label) for c, label in names.items() if c in df.columns])


def export_friendly_csv(df: DataFrame, path: str, names: Mapping[str, str] = tb.FRIENDLY_NAMES) -> None:
    _write_csv(friendly(df, names), path)
