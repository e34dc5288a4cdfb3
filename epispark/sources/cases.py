"""The case table: one schema over years whose files differ."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.presets import tuberculosis as tb
from epispark.spec import TB, CaseSpec

# Name of a loose year file as pattern and as glob, last year of the older catalog, which a caller passes.
YEAR_FILE = r"tuberculose_(\d{4})_tratado"
YEAR_GLOB = "*tuberculose_{year}_tratado*"
LATEST_LEGACY_YEAR = 2025
NANOS_A_DAY = 86_400_000_000_000


def case_schema(columns: Iterable[str] = tb.FRIENDLY_NAMES) -> T.StructType:
    """Canonical types of the preset: dates, integers, everything else text."""
    integers = {*tb.INT_COLUMNS, "idade_anos"}
    fields = []
    for c in columns:
        kind = T.DateType() if c in tb.DATE_COLUMNS else T.IntegerType() if c in integers else T.StringType()
        fields.append(T.StructField(c, kind))
    return T.StructType(fields)


def _aligned(source: Column, found: T.DataType, wanted: T.DataType) -> Column:
    if isinstance(found, T.LongType) and isinstance(wanted, T.DateType):
        # Nanoseconds since 1970, see session.DEFAULTS: whole days, whatever the zone of the session.
        days = (source - F.pmod(source, F.lit(NANOS_A_DAY))) / NANOS_A_DAY
        return F.date_from_unix_date(days.cast("int"))
    if isinstance(found, T.LongType) and isinstance(wanted, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(F.floor(source / 1000).cast("long")).cast(wanted)
    return source.try_cast(wanted)


def align(df: DataFrame, schema: T.StructType, extra: Sequence[str] = ()) -> DataFrame:
    """Selects exactly the columns of ``schema`` (and ``extra``): a missing one becomes a typed
    null, a value that does not fit becomes null."""
    found = {f.name: f.dataType for f in df.schema}
    out = []
    for f in schema:
        c = _aligned(F.col(f.name), found[f.name], f.dataType) if f.name in found else F.lit(None).cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out, *[c for c in extra if c in found])


def union_by_name(parts: Sequence[DataFrame], schema: T.StructType) -> DataFrame:
    """Aligned parts appended by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [align(p, schema) for p in parts])


@dataclass(frozen=True)
class CaseStore:
    """Case table in folders ``<year column>=<year>`` (the layout this package writes)."""

    spark: SparkSession
    path: str
    schema: T.StructType
    spec: CaseSpec = TB

    def all_years(self) -> DataFrame:
        """The whole series. One schema is imposed, so no file has to be inspected first."""
        fields = [f for f in self.schema if f.name != self.spec.year]
        fields.append(T.StructField(self.spec.year, T.IntegerType()))
        return self.spark.read.schema(T.StructType(fields)).parquet(self.path)

    def years(self, years: Sequence[int]) -> DataFrame:
        """Only the folders of ``years``; years without a folder are skipped."""
        return self.all_years().where(F.col(self.spec.year).isin(list(years)))

    def between(self, first: int, last: int) -> DataFrame:
        return self.all_years().where(F.col(self.spec.year).between(first, last))

    def catalog(self) -> DataFrame:
        """(ano), one row per year: only the folder value is read."""
        return self.all_years().select(F.col(self.spec.year).alias("ano")).distinct()

    def years_known(self) -> tuple[int, ...]:
        """The calendar years, ascending, on the driver."""
        return tuple(sorted(r["ano"] for r in self.catalog().where("ano IS NOT NULL").collect()))

    def write(self, df: DataFrame, clustered: bool = False) -> None:
        write_by_year(align(df, self.schema), self.path, self.spec, clustered)


def write_by_year(df: DataFrame, path: str, spec: CaseSpec = TB, clustered: bool = False) -> None:
    """Replaces the years present in ``df`` and leaves the others alone.

    Rows are rebalanced by year: adaptive execution cuts a year with very many rows into several
    files and merges small ones. ``clustered`` says that every input task already holds one year
    (year folders, one query per year), and then nothing is shuffled. Inside a file rows are
    ordered by area, so a filter on the area skips row groups."""
    rows = df if clustered else df.hint("rebalance", F.col(spec.year))
    order = [c for c in (spec.year, spec.area) if c in df.columns]
    (rows.sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(spec.year).parquet(path))


def folder_files(spark: SparkSession, path: str, column: str) -> dict[str, frozenset[str]]:
    """Value -> names of files, for the folders ``<column>=<value>`` below a path."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    found = {}
    for folder in files.listStatus(root):
        name, mark, value = folder.getPath().getName().partition("=")
        if mark and name == column:
            found[value] = frozenset(f.getPath().getName() for f in files.listStatus(folder.getPath()))
    return found


def drop_folders(spark: SparkSession, path: str, column: str, keep: Callable[[str], bool]) -> None:
    """Removes the folders ``<column>=<value>`` whose value is not to be kept."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for value in folder_files(spark, path, column):
        if not keep(value):
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"{column}={value}"), True)


def replace_years(df: DataFrame, path: str, years: Sequence[int], spec: CaseSpec = TB, clustered: bool = False,
                  column: str | None = None, order: Sequence[str] = (), options: Mapping[str, str] | None = None) -> None:
    """Replaces the folders of ``years``. A year that no longer has any row loses its folder: after
    the write its folder still holds the files it held before. A table other than the cases names its
    year ``column`` and the ``order`` of rows in a file, unless they are in order already, and comes with its own distribution."""
    spark, asked, year = df.sparkSession, {str(int(y)) for y in years}, column or spec.year
    before = folder_files(spark, path, year)
    if column is None:
        write_by_year(df, path, spec, clustered)
    else:
        rows = df.sortWithinPartitions(*order) if order else df
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options or {})
         .partitionBy(year).parquet(path))
    after = folder_files(spark, path, year)
    emptied = {y for y in asked if y in before and before[y] == after.get(y)}
    if emptied:
        drop_folders(spark, path, year, keep=lambda y: y not in emptied)


def scan_projected(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Declared columns only; those the table lacks come as null text."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def year_files(spark: SparkSession, folder: str, pattern: str = YEAR_FILE) -> DataFrame:
    """(ano, path) of loose per-year files or folders of files. Lists the folder; no file is opened."""
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
              .option("recursiveFileLookup", "true").load(folder).select("path"))
    year = F.regexp_extract("path", pattern, 1)
    return listed.where(year != "").select(year.cast("int").alias("ano"), "path")


def year_catalog_legacy(catalog: DataFrame, latest: int | None = None) -> list[int]:
    """Older catalog order: descending, not after ``latest`` if given (LATEST_LEGACY_YEAR in the older
    product), then ``[latest]`` when empty. A catalog has one row per calendar year, so listing it on
    the driver is bounded."""
    rows = (catalog.where(F.col("ano") <= latest) if latest else catalog).orderBy(F.desc("ano")).collect()
    return [r["ano"] for r in rows] or ([latest] if latest else [])


def load_year_files(spark: SparkSession, folder: str, schema: T.StructType, years: Sequence[int] | None = None,
                    pattern: str = YEAR_FILE, glob: str = YEAR_GLOB) -> DataFrame:
    """Loose per-year files with differing columns, aligned and appended. Only files of the chosen
    years are opened; missing years are skipped; without any file the result is empty. What reaches
    the driver is the calendar years; the files of a year are read by a glob."""
    listed = year_files(spark, folder, pattern)
    chosen = listed if years is None else listed.where(F.col("ano").isin(list(years)))
    found = [r["ano"] for r in chosen.select("ano").distinct().orderBy("ano").collect()]
    if not found:
        return spark.createDataFrame([], schema)
    return union_by_name([spark.read.parquet(f"{folder}/{glob.format(year=year)}") for year in found], schema)
