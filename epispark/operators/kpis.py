"""Single-row summaries and rates for the whole selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.functions.clean import attach_area, has_outcome, registry_year
from epispark.functions.filters import Filters, resolve
from epispark.functions.measures import pct1, rate_per_100k
from epispark.functions.predicates import cause_prefix, incident
from epispark.operators.areas import n_all, n_if
from epispark.operators.registry import registry_deaths_year_area
from epispark.spec import TB, AreaDim, CaseSpec


def base_total_share(df: DataFrame, filters: Filters, dim: AreaDim | None = None,
                     spec: CaseSpec = TB) -> DataFrame:
    """Unfiltered total of the chosen years, of all years without a choice, and the filtered share. The filters are taken as
    they are; a request is resolved before."""
    out = filters.apply(df, spec, dim).agg(F.count(F.lit(1)).alias("total"), base_total(df, filters, spec).alias("total_base"))
    return out.withColumn("pct_filtrado", pct1(F.col("total"), F.col("total_base")))


def base_total(df: DataFrame, filters: Filters, spec: CaseSpec = TB, annual: DataFrame | None = None) -> Column:
    """Scalar number of cases of the chosen years. On stored files this reads row counts from the
    footers and no column, so the filtered pass keeps its own pushed-down filters. A published
    ``annual`` history (nu_ano, casos) saves even that."""
    if annual is not None:
        years = annual.where(F.col("nu_ano").isin(list(filters.years))) if filters.years else annual
        return years.agg(F.coalesce(F.sum("casos"), F.lit(0))).scalar()
    return df.where(filters.year_predicate(spec)).agg(F.count(F.lit(1))).scalar()


def conditional_counts(df: DataFrame, spec: CaseSpec = TB) -> DataFrame:
    """Total, cured, dropped out, died, HIV positive and incident cases in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        n_if(has_outcome(spec.cure, spec), "cura"),
        n_if(has_outcome(spec.dropout, spec), "abandono"),
        n_if(has_outcome(spec.death, spec), "obito_tb"),
        n_if(F.col(spec.hiv) == spec.positive, "hiv_pos"),
        n_if(incident(spec), "casos_novos"))


def incidence_rate(df: DataFrame, dim: AreaDim, filters: Filters, spec: CaseSpec = TB,
                   mapped_only: bool = False) -> DataFrame:
    """New cases over (population x years) per 100,000. ``mapped_only`` is the older rule that
    leaves out cases of unmapped areas."""
    filters = resolve(df, filters, spec, dim)
    rows = filters.apply(df, spec, dim)
    if mapped_only:
        rows = attach_area(rows, dim, spec)
    counted = rows.agg(n_if(incident(spec), "casos_novos"),
                       dim.population_at_risk(filters.areas).alias("populacao"))
    rate = rate_per_100k(F.col("casos_novos"), F.col("populacao"), filters.n_years)
    return counted.withColumn("incidencia", rate)


def registry_total(deaths: DataFrame | None, filters: Filters) -> Column:
    """Scalar registry deaths of the chosen years and areas; null when there are none or no registry."""
    if deaths is None:
        return F.lit(None).cast("long")
    rows = deaths.where(F.col("ano").isin(list(filters.years))) if filters.years else deaths
    if filters.areas:
        rows = rows.where(F.col("uf").isin(list(filters.areas)))
    return rows.agg(F.sum("obitos")).scalar()


def mortality_rate(df: DataFrame, dim: AreaDim, deaths: DataFrame, filters: Filters,
                   spec: CaseSpec = TB) -> DataFrame:
    """Registry deaths (year and area filters only) per 100,000; case deaths when the
    registry has none."""
    return (summary_kpis(df, dim, deaths, filters, spec)
            .select("obitos", "fonte_obitos", "mortalidade"))


def population_present(df: DataFrame, dim: AreaDim, spec: CaseSpec = TB) -> DataFrame:
    """Older rule: population of the areas that occur in the data, everybody when none is mapped."""
    present = attach_area(df, dim, spec).select("sigla").distinct()
    some = dim.population.join(present, "sigla", "left_semi").agg(F.sum("populacao").alias("populacao"))
    return some.select(F.coalesce("populacao", dim.population_at_risk()).alias("populacao"))


def mortality_rate_legacy(df: DataFrame, dim: AreaDim, registry: DataFrame, years, spec: CaseSpec = TB,
                          n_years: int | None = None) -> DataFrame:
    """Older rule: when every mapped area occurs in the data (or none does), all registry deaths
    count, unknown residence included; otherwise those of the areas present. Case deaths when
    the registry has none."""
    n_years = n_years or max(len(years), 1)
    present = attach_area(df, dim, spec).select(F.col("sigla").alias("uf")).distinct()
    n_present = present.agg(F.count(F.lit(1))).scalar()
    by_area = registry_deaths_year_area(registry, dim).where(F.col("ano").isin(list(years)))
    some = by_area.join(present, "uf", "left_semi").agg(F.sum("obitos")).scalar()
    year = registry_year(F.col("dtobito"))
    every = registry.where(cause_prefix(F.col("causabas")) & year.isin(list(years))).agg(F.count(F.lit(1))).scalar()
    part = (n_present > 0) & (n_present < len(dim.areas))
    counted = df.agg(n_if(has_outcome(spec.death, spec), "_mortes")).withColumns({
        "_sim": F.coalesce(F.when(part, some).otherwise(every), F.lit(0)),
        "_pop": population_present(df, dim, spec).select("populacao").scalar()})
    deaths = F.when(F.col("_sim") > 0, F.col("_sim")).otherwise(F.col("_mortes")).cast("long")
    return counted.select(deaths.alias("obitos"), F.col("_pop").alias("populacao"),
                          rate_per_100k(deaths, F.col("_pop"), n_years).alias("mortalidade"))


def summary_kpis(df: DataFrame, dim: AreaDim, deaths: DataFrame | None, filters: Filters,
                 spec: CaseSpec = TB, annual: DataFrame | None = None) -> DataFrame:
    """The headline record: one pass over the filtered cases, everything else is a scalar."""
    filters = resolve(df, filters, spec, dim)
    return headline(filters.apply(df, spec, dim), base_total(df, filters, spec, annual), dim, deaths, filters, spec)


def headline(rows: DataFrame, base: Column, dim: AreaDim, deaths: DataFrame | None, filters: Filters,
             spec: CaseSpec = TB, weight: str | None = None, places: Column | None = None) -> DataFrame:
    """The headline record of filtered rows, or of cells with a ``weight``; ``base`` is the unfiltered total.
    ``places``, a scalar, spares the distinct count, for which each row is counted twice."""
    c = rows.agg(
        n_all("total", weight), n_if(has_outcome(spec.cure, spec), "cura", weight),
        n_if(has_outcome(spec.dropout, spec), "abandono", weight), n_if(has_outcome(spec.death, spec), "_mortes", weight),
        n_if(F.col(spec.hiv) == spec.positive, "hiv_pos", weight), n_if(incident(spec), "_novos", weight),
        *([F.countDistinct(spec.place).alias("municipios")] if places is None else []),
    ).select("*", *([places.alias("municipios")] if places is not None else []), base.alias("total_base"), registry_total(deaths, filters).alias("_sim"),
             dim.population_at_risk(filters.areas).alias("_pop"))
    official = F.coalesce(F.col("_sim"), F.lit(0)) > 0
    c = c.withColumns({
        "obitos": F.when(official, F.col("_sim")).otherwise(F.col("_mortes")).cast("long"),
        "fonte_obitos": F.when(official, F.lit("SIM")).otherwise(F.lit("SINAN"))})
    n = filters.n_years
    return c.select(
        "total", "total_base", pct1(F.col("total"), F.col("total_base")).alias("pct_filtrado"),
        "cura", "abandono", "obitos", "fonte_obitos", "hiv_pos", "municipios",
        rate_per_100k(F.col("_novos"), F.col("_pop"), n).alias("incidencia"),
        rate_per_100k(F.col("obitos"), F.col("_pop"), n).alias("mortalidade"))
