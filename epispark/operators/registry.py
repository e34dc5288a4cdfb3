"""Death registry: official deaths by year and area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.functions.clean import registry_area_code, registry_year
from epispark.functions.predicates import cause_prefix, has_residence
from epispark.operators.counts import after_count, count_by
from epispark.spec import AreaDim


def deaths_raw(registry: DataFrame, prefix: str = "A1") -> DataFrame:
    """(ano_txt, codigo, obitos): the aggregate that can run at the source."""
    rows = registry.where(cause_prefix(F.col("causabas"), prefix) & has_residence(F.col("codmunres")))
    return count_by(rows, F.substring("dtobito", 5, 4).alias("ano_txt"),
                    registry_area_code(F.col("codmunres")).alias("codigo"), name="obitos")


def map_deaths(raw: DataFrame, dim: AreaDim) -> DataFrame:
    """(ano, uf, obitos): non-numeric years and unknown areas are left out."""
    codes = dim.hinted(dim.table.select("codigo", F.col("sigla").alias("uf")))
    rows = (raw.withColumn("ano", F.col("ano_txt").try_cast("int"))
            .where(after_count(F.col("ano").isNotNull(), "obitos"))
            .join(codes, "codigo"))
    return rows.groupBy("ano", "uf").agg(F.sum("obitos").alias("obitos"))


def registry_deaths_year_area(registry: DataFrame, dim: AreaDim) -> DataFrame:
    """Deaths by (year, area): counted by raw code first, codes mapped afterwards."""
    return map_deaths(deaths_raw(registry), dim)


def in_year(*years: int) -> Column:
    return F.substring("dtobito", 5, 4).isin(*[str(y) for y in years])


def registry_deaths_area(registry: DataFrame, dim: AreaDim, *years: int) -> DataFrame:
    """(uf_sigla, obitos_sim) of one year, or of several together."""
    by = registry_deaths_year_area(registry.where(in_year(*years)), dim)
    return by.groupBy(F.col("uf").alias("uf_sigla")).agg(F.sum("obitos").alias("obitos_sim"))


def registry_deaths_national(registry: DataFrame, year: int) -> DataFrame:
    """Deaths of one year, unknown residence included."""
    return registry.where(cause_prefix(F.col("causabas")) & in_year(year)).agg(F.count(F.lit(1)).alias("obitos"))


def registry_deaths_series(deaths: DataFrame) -> DataFrame:
    """(ano, obitos) over the mapped areas."""
    return deaths.groupBy("ano").agg(F.sum("obitos").alias("obitos"))


def registry_deaths_series_legacy(registry: DataFrame, first: int, last: int) -> DataFrame:
    """Older rule: any residence, a fixed range of years."""
    year = registry_year(F.col("dtobito"))
    rows = registry.where(cause_prefix(F.col("causabas")) & year.between(first, last))
    return count_by(rows, year.alias("nu_ano"), name="obitos_sim")


def sum_years(parts: list[DataFrame]) -> DataFrame:
    """(uf_sigla, obitos_sim) tables of different periods or sources appended, then summed by area.
    Years of one source need no union: ``registry_deaths_area`` takes them all in one scan."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("uf_sigla").agg(F.sum("obitos_sim").alias("obitos_sim"))


def deaths_of_present_areas(deaths: DataFrame, areas_present: DataFrame) -> DataFrame:
    """Deaths only of areas that occur in the selection. ``areas_present`` has a ``uf`` column."""
    return deaths.join(areas_present.select("uf").distinct(), "uf", "left_semi")
