"""Stored partial results that merge for any choice of years and areas: exact distinct places, and quantiles.

Counts add up, distinct counts and medians do not. So each (year, area) keeps a bitmap over the numbers of
its places, and a quantile sketch of its values. A request merges a few of these and never returns to the cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epispark.functions.clean import attach_area
from epispark.functions.filters import DIMENSIONS, Filters
from epispark.spec import TB, AreaDim, CaseSpec

#: Size parameter of a quantile sketch: more is larger and closer.
SKETCH_K = 800
PLACES = "ano int, sigla string, balde long, mapa binary"
SKETCHES = "ano int, sigla string, esboco binary"


def place_numbers(df: DataFrame, spec: CaseSpec = TB, known: DataFrame | None = None) -> DataFrame:
    """(lugar, numero): each place and its number, from 1 without gaps; places that ``known`` has keep theirs.

    New places are ranged by name; a range numbers its own, and the sizes of the ranges before are added. Write the
    result before it is used, since bitmaps are only as stable as the numbers."""
    places = df.select(F.col(spec.place).alias("lugar")).where("lugar IS NOT NULL").distinct()
    if known is not None:
        places = places.join(known, "lugar", "left_anti")
    ranged = places.repartitionByRange("lugar").withColumn("_range", F.spark_partition_id())
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = (ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
               .select(F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above")))
    nth = F.row_number().over(W.partitionBy("_range").orderBy("lugar"))
    last = F.lit(0) if known is None else known.agg(F.coalesce(F.max("numero"), F.lit(0))).scalar()
    new = (ranged.withColumn("_nth", nth).join(offsets, F.col("_range") == F.col("_at"))
           .select("lugar", (last + F.col("_above") + F.col("_nth")).cast("long").alias("numero")))
    return new if known is None else known.select("lugar", "numero").unionByName(new)


def place_bitmaps(df: DataFrame, dim: AreaDim, numbers: DataFrame, spec: CaseSpec = TB) -> DataFrame:
    """(ano, sigla, balde, mapa): the places of each year and area as bits, 32,768 to a bucket.

    A place is one row per year and area before its number is looked up, whatever number of cases it has."""
    found = (attach_area(df, dim, spec, "left").where(F.col(spec.place).isNotNull())
             .select(F.col(spec.year).cast("int").alias("ano"), "sigla", F.col(spec.place).alias("lugar")).distinct())
    numbered = found.join(numbers, "lugar")
    return numbered.groupBy("ano", "sigla", F.bitmap_bucket_number("numero").alias("balde")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("numero")).alias("mapa"))


def chosen(stored: DataFrame, f: Filters, dim: AreaDim) -> DataFrame:
    """The stored rows of a choice of years and areas; other restrictions are not held and are refused."""
    if any(getattr(f, name) for name in DIMENSIONS if name not in ("years", "areas")):
        raise ValueError("stored by year and area; a request that restricts more has to ask the cases")
    out = stored.where(F.col("ano").isin(list(f.years))) if f.years else stored
    areas = f.known_areas(dim)
    return out.where(F.col("sigla").isin(list(areas))) if areas else out


def distinct_places_of(bitmaps: DataFrame) -> DataFrame:
    """(municipios): exact number of places in any of the given bitmaps."""
    merged = bitmaps.groupBy("balde").agg(F.bitmap_or_agg("mapa").alias("mapa"))
    return merged.agg(F.coalesce(F.sum(F.bitmap_count("mapa")), F.lit(0)).alias("municipios"))


def places_in_every_year(bitmaps: DataFrame) -> DataFrame:
    """(municipios): number of places that occur in each of the years that the given bitmaps have."""
    years = bitmaps.agg(F.countDistinct("ano")).scalar()
    yearly = bitmaps.groupBy("ano", "balde").agg(F.bitmap_or_agg("mapa").alias("mapa"))
    merged = yearly.groupBy("balde").agg(F.bitmap_and_agg("mapa").alias("mapa"), F.count(F.lit(1)).alias("n"))
    # a bucket that a year does not have has no place in every year
    return merged.where(F.col("n") == years).agg(F.coalesce(F.sum(F.bitmap_count("mapa")), F.lit(0)).alias("municipios"))


def rank_error(k: int = SKETCH_K) -> float:
    """Largest distance, as a share of all values, between the rank asked for and that of the answer, with 99 % certainty."""
    return 2.296 / k ** 0.9021


def value_sketches(df: DataFrame, dim: AreaDim, value: Column, spec: CaseSpec = TB, k: int = SKETCH_K) -> DataFrame:
    """(ano, sigla, esboco): a KLL sketch of a whole-number column for each year and area. A task sketches its own rows,
    so what is shuffled is one sketch per task, year and area."""
    rows = attach_area(df, dim, spec, "left").select(F.col(spec.year).cast("int").alias("ano"), "sigla", value.cast("long").alias("v"))
    return rows.where("v IS NOT NULL").groupBy("ano", "sigla").agg(F.kll_sketch_agg_bigint("v", k).alias("esboco"))


def quantiles(sketches: DataFrame, parts: Sequence[float] = (0.5,), k: int = SKETCH_K) -> DataFrame:
    """(parte, valor, n) of the merged sketches; no row when there are none."""
    merged = sketches.agg(F.kll_merge_agg_bigint("esboco", k).alias("e"), F.count(F.lit(1)).alias("_n")).where("_n > 0")
    rows = F.array(*[F.struct(F.lit(p).alias("parte"), F.kll_sketch_get_quantile_bigint("e", F.lit(p)).alias("valor"),
                              F.kll_sketch_get_n_bigint("e").alias("n")) for p in parts])
    return merged.select(F.inline(rows))
