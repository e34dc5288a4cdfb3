"""Database extraction. URL and credentials come from the caller only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.functions.clean import whole_number
from epispark.operators.registry import map_deaths
from epispark.sources.cases import replace_years
from epispark.spec import TB, AreaDim, CaseSpec


def year_predicates(year_column: str, years: Sequence[int], split_column: str | None = None,
                    splits: int = 1) -> list[str]:
    """One query condition per year, each read by its own task. A numeric ``split_column`` cuts
    every year into ``splits`` more, so a heavy year is not a single task; rows whose number is
    null or negative belong to one of them as well."""
    out = []
    for year in years:
        condition = f"{year_column} = '{int(year)}'"
        if split_column and splits > 1:
            out += [f"{condition} AND MOD(ABS(COALESCE({split_column}, 0)), {splits}) = {i}" for i in range(splits)]
        else:
            out.append(condition)
    return out


def read_years(spark: SparkSession, url: str, table: str, years: Sequence[int], properties: Mapping[str, str],
               spec: CaseSpec = TB, split_column: str | None = None, splits: int = 1) -> DataFrame:
    predicates = year_predicates(spec.year, years, split_column, splits)
    return spark.read.jdbc(url, table, predicates=predicates, properties=dict(properties))


def extract_by_year(source: DataFrame, path: str, years: Sequence[int], spec: CaseSpec = TB,
                    clustered: bool = False) -> None:
    """Writes the chosen years as year folders; running it again replaces just those years,
    also by nothing.
    The result of ``read_years`` is ``clustered``: each of its tasks reads one year."""
    replace_years(source.where(whole_number(F.col(spec.year)).isin(list(years))), path, years, spec, clustered)


def deaths_query(table: str, prefix: str = "A1") -> str:
    """Aggregate that the database runs itself, so only (year, area) counts travel."""
    return (f"select substring(dtobito, 5, 4) as ano_txt, substring(codmunres, 1, 2) as codigo, "
            f"count(*) as obitos from {table} where causabas like '{prefix}%' "
            f"and length(trim(codmunres)) >= 2 group by 1, 2")


def read_registry_deaths(spark: SparkSession, url: str, table: str, properties: Mapping[str, str],
                         dim: AreaDim) -> DataFrame:
    """(ano, uf, obitos) from a database."""
    raw = (spark.read.format("jdbc").option("url", url).option("query", deaths_query(table))
           .options(**dict(properties)).load())
    return map_deaths(raw, dim)
