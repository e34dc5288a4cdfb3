"""Indicators by area and by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.functions.clean import attach_area, has_outcome, is_closed
from epispark.functions.measures import pct1, pct1_min1, rate_per_100k
from epispark.functions.predicates import incident, known_status
from epispark.functions.text import fold_key
from epispark.spec import TB, AreaDim, CaseSpec


def n_if(condition: Column, name: str, weight: str | None = None) -> Column:
    """How many rows the condition holds for; with a weight column, how many cases they stand for."""
    if weight is None:
        return F.count_if(condition).alias(name)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0).cast("long")).alias(name)


def n_all(name: str, weight: str | None = None) -> Column:
    return F.count(F.lit(1)).alias(name) if weight is None else n_if(F.lit(True), name, weight)


def name_areas(df: DataFrame, dim: AreaDim, code: str = "uf") -> DataFrame:
    """Adds the display name of an area code."""
    titles = dim.hinted(dim.table.select(F.col("sigla").alias("_code"), "nome"))
    return df.join(titles, F.expr(f"`{code}` = _code"), "left").drop("_code")


def join_population(df: DataFrame, dim: AreaDim, code: str = "uf") -> DataFrame:
    """Adds ``populacao``; an area without one gets 0. ``df`` is already aggregated by area."""
    people = dim.population.withColumnRenamed("sigla", "_code")
    out = df.join(people, F.expr(f"`{code}` = _code"), "left").drop("_code")
    return out.withColumn("populacao", F.coalesce("populacao", F.lit(0).cast("long")))


def deaths_in_years(deaths: DataFrame | None, dim: AreaDim, years=()) -> DataFrame:
    """(uf, obitos) from a (ano, uf, obitos) table; without a registry, no rows."""
    if deaths is None:
        return dim.table.where("false").select(F.col("sigla").alias("uf"), F.lit(0).cast("long").alias("obitos"))
    chosen = deaths.where(F.col("ano").isin(list(years))) if years else deaths
    return chosen.groupBy("uf").agg(F.sum("obitos").alias("obitos"))


def area_indicators(df: DataFrame, dim: AreaDim, deaths: DataFrame | None, years=(), n_years: int | None = None,
                    spec: CaseSpec = TB, weight: str | None = None) -> DataFrame:
    """Cases, new cases, deaths, incidence, mortality, cure % and dropout % per area.

    Percentages are over all cases. Registry deaths are used when the registry covers the
    chosen years at all, case deaths otherwise; ``fonte_obitos`` says which. Rows may be cells with a ``weight``."""
    n_years = n_years or max(len(years), 1)
    cases = (attach_area(df, dim, spec).groupBy(F.col("sigla").alias("uf"))
             .agg(n_all("casos", weight),
                  n_if(incident(spec), "casos_novos", weight),
                  n_if(has_outcome(spec.death, spec), "_mortes", weight),
                  n_if(has_outcome(spec.cure, spec), "_cura", weight),
                  n_if(has_outcome(spec.dropout, spec), "_abandono", weight)))
    by_area = deaths_in_years(deaths, dim, years)
    covered = by_area.agg(F.sum("obitos")).scalar().isNotNull()
    joined = join_population(cases.join(by_area, "uf", "left"), dim)
    joined = joined.withColumn("obitos", F.when(covered, F.coalesce("obitos", F.lit(0).cast("long")))
                               .otherwise(F.col("_mortes")))
    out = joined.select(
        "uf", "casos", "casos_novos", "obitos",
        rate_per_100k(F.col("casos_novos"), F.col("populacao"), n_years).alias("incidencia"),
        rate_per_100k(F.col("obitos"), F.col("populacao"), n_years).alias("mortalidade"),
        pct1(F.col("_cura"), F.col("casos")).alias("cura_pct"),
        pct1(F.col("_abandono"), F.col("casos")).alias("abandono_pct"),
        F.when(covered, F.lit("SIM")).otherwise(F.lit("SINAN")).alias("fonte_obitos"))
    return name_areas(out, dim)


def area_indicators_legacy(df: DataFrame, dim: AreaDim, deaths: DataFrame, years, spec: CaseSpec = TB,
                           incidence_entries=None, n_years: int | None = None) -> DataFrame:
    """Older rules: unmapped areas stay as '?', deaths always come from the registry, a
    rate without population is null."""
    from epispark.presets.tuberculosis import INCIDENCE_ENTRIES_LEGACY

    entries = incidence_entries or INCIDENCE_ENTRIES_LEGACY
    n_years = n_years or max(len(years), 1)
    cases = (attach_area(df, dim, spec, "left", "?").groupBy(F.col("sigla").alias("uf"))
             .agg(F.count(F.lit(1)).alias("casos"),
                  n_if(F.col(spec.entry).isin(*entries), "casos_novos")))
    people = dim.population.withColumnRenamed("sigla", "uf")
    joined = cases.join(deaths_in_years(deaths, dim, years), "uf", "left").join(people, "uf", "left")
    joined = joined.withColumn("obitos", F.coalesce("obitos", F.lit(0).cast("long")))

    def rate(events: str) -> Column:
        value = F.try_divide(F.col(events).cast("double"), F.col("populacao").cast("double") * float(n_years))
        return F.round(value * 100000.0, 1)

    return joined.select("uf", "casos", "casos_novos", "obitos", "populacao",
                         rate("casos_novos").alias("incidencia"), rate("obitos").alias("mortalidade"))


def municipality_indicators(df: DataFrame, dim: AreaDim, spec: CaseSpec = TB) -> DataFrame:
    """Per trimmed place: outcome % over all its cases, HIV % over known status."""
    by = (attach_area(df, dim, spec).where(F.col(spec.place).isNotNull())
          .groupBy(F.col("sigla").alias("uf"), F.trim(spec.place).alias("municipio"))
          .agg(F.count(F.lit(1)).alias("casos"),
               n_if(has_outcome(spec.cure, spec), "_cura"),
               n_if(has_outcome(spec.dropout, spec), "_abandono"),
               n_if(has_outcome(spec.death, spec), "_obito"),
               n_if(F.col(spec.hiv) == spec.positive, "_pos"),
               n_if(known_status(spec), "_conhecido")))
    return by.select("uf", "municipio", fold_key(F.col("municipio")).alias("nm_norm"), "casos",
                     pct1(F.col("_cura"), F.col("casos")).alias("cura_pct"),
                     pct1(F.col("_abandono"), F.col("casos")).alias("abandono_pct"),
                     pct1(F.col("_obito"), F.col("casos")).alias("obito_pct"),
                     pct1(F.col("_pos"), F.col("_conhecido")).alias("hiv_pct"))


def municipality_pct_legacy(df: DataFrame, dim: AreaDim, spec: CaseSpec = TB) -> DataFrame:
    """Older rules: untrimmed names, dropout is the plain label only, HIV % over all cases."""
    by = (attach_area(df, dim, spec).where(F.col(spec.place).isNotNull())
          .groupBy(F.col("sigla").alias("uf"), F.col(spec.place).alias("municipio"))
          .agg(F.count(F.lit(1)).alias("casos"),
               n_if(has_outcome(spec.cure, spec), "_cura"),
               n_if(has_outcome(spec.dropout[0], spec), "_abandono"),
               n_if(has_outcome(spec.death, spec), "_obito"),
               n_if(F.col(spec.hiv) == spec.positive, "_pos")))
    return by.select("uf", fold_key(F.col("municipio")).alias("municipio_norm"), "casos",
                     *[pct1(F.col(c), F.col("casos")).alias(n) for c, n in
                       (("_cura", "cura"), ("_abandono", "abandono"), ("_obito", "obitos"), ("_pos", "hiv_pos"))])


def cohort_kpis(df: DataFrame, dim: AreaDim, spec: CaseSpec = TB) -> DataFrame:
    """Cohort indicators per area: the denominator is the closed cases."""
    closed = is_closed(spec)
    cured = has_outcome(spec.cure, spec)
    new = F.col(spec.entry) == spec.new_case
    again = F.col(spec.entry).isin(*spec.retreatment_entries)
    k = (attach_area(df, dim, spec).groupBy(F.col("sigla").alias("uf"))
         .agg(F.count(F.lit(1)).alias("total"),
              F.countDistinct(F.trim(spec.place)).alias("total_municipios"),
              n_if(closed, "encerrados"), n_if(cured, "_cura"),
              n_if(has_outcome(spec.dropout, spec), "_abandono"),
              n_if(has_outcome(spec.death, spec), "_obito"),
              n_if(new & closed, "n_enc_novo"), n_if(new & cured, "_cura_novo"),
              n_if(again & closed, "n_enc_retrat"), n_if(again & cured, "_cura_retrat"),
              n_if(F.col(spec.hiv) == spec.positive, "_pos"), n_if(known_status(spec), "n_hiv_conhecido")))
    return k.select("uf", "total", "total_municipios", "encerrados",
                    pct1_min1(F.col("_cura"), F.col("encerrados")).alias("cura_pct"),
                    pct1_min1(F.col("_abandono"), F.col("encerrados")).alias("abandono_pct"),
                    pct1_min1(F.col("_obito"), F.col("encerrados")).alias("obito_pct"),
                    pct1_min1(F.col("_cura_novo"), F.col("n_enc_novo")).alias("cura_novo_pct"), "n_enc_novo",
                    pct1_min1(F.col("_cura_retrat"), F.col("n_enc_retrat")).alias("cura_retrat_pct"), "n_enc_retrat",
                    pct1_min1(F.col("_pos"), F.col("n_hiv_conhecido")).alias("hiv_pct"), "n_hiv_conhecido")


def positivity_by_area(df: DataFrame, dim: AreaDim, spec: CaseSpec = TB) -> DataFrame:
    """Positive share of the known status per area; an area without known status gets 0.0."""
    by = (attach_area(df, dim, spec).groupBy(F.col("sigla").alias("uf"))
          .agg(n_if(F.col(spec.hiv) == spec.positive, "_pos"), n_if(known_status(spec), "n_testado")))
    return by.select("uf", pct1(F.col("_pos"), F.col("n_testado")).alias("pct"), "n_testado")


def positivity_both_counted(df: DataFrame, dim: AreaDim, spec: CaseSpec = TB) -> DataFrame:
    """Older rule, an inner join of numerator and denominator: areas without a positive vanish.
    One pass gives the same rows as the join would."""
    by = (attach_area(df, dim, spec, "left", "?").groupBy(F.col("sigla").alias("uf"))
          .agg(n_if(F.col(spec.hiv) == spec.positive, "hiv_pos"), n_if(known_status(spec), "testados")))
    return by.where(F.col("hiv_pos") > 0).withColumn("pct", pct1(F.col("hiv_pos"), F.col("testados")))
