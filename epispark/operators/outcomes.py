"""Outcome groups inside categories, flag prevalence, pyramids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.functions.clean import (
    attach_area, band, band_grid, canonical_outcome, has_outcome, outcome_group, with_outcome)
from epispark.functions.measures import pct1, pct1_min1
from epispark.functions.text import is_valid_label, is_yes, strip_ws
from epispark.operators.areas import n_if
from epispark.operators.counts import after_count, count_by, zero_fill
from epispark.literals import sql_map
from epispark.spec import TB, AreaDim, CaseSpec


def group_shares(counts: DataFrame, keys: Sequence[str], spec: CaseSpec = TB) -> DataFrame:
    """(keys, grupo, n, total, pct) with every group present, from (keys, grupo, n).

    One conditional sum per group, then unpivot: neither a grid join nor a window."""
    names = [f"_g{i}" for i in range(len(spec.group_order))]
    sums = [F.sum(F.when(F.col("grupo") == g, F.col("n")).otherwise(0)).alias(c)
            for c, g in zip(names, spec.group_order)]
    wide = counts.groupBy(*keys).agg(F.sum("n").alias("total"), *sums)
    rows = F.array(*[F.struct(F.lit(g).alias("grupo"), F.col(c).alias("n"))
                     for c, g in zip(names, spec.group_order)])
    return (wide.select(*keys, "total", F.explode(rows).alias("r"))
            .select(*keys, F.col("r.grupo").alias("grupo"), F.col("r.n").alias("n"), "total",
                    pct1_min1(F.col("r.n"), F.col("total")).alias("pct")))


def outcome_group_by(df: DataFrame, column: str, spec: CaseSpec = TB,
                     only: Sequence[str] = (), unmapped: str = "ungrouped") -> DataFrame:
    """Share of each outcome group inside each category. Rows are counted by raw category
    and raw outcome first; recoding touches only the distinct pairs.

    ``unmapped='drop'`` leaves out outcomes that belong to no group (older rule)."""
    rows = df.where(F.col(column).isin(*only)) if only else df.where(F.col(column).isNotNull())
    raw = count_by(rows, F.col(column).cast("string").alias("_cat"), F.col(spec.outcome).alias("_out"), name="n")
    group = outcome_group(canonical_outcome(F.col("_out"), spec), spec, unmapped == "drop")
    counts = (raw.where(after_count(is_valid_label(F.col("_cat"), ("nao informado",))))
              .select(strip_ws(F.col("_cat")).alias("categoria"), group.alias("grupo"), "n")
              .where(after_count(F.col("grupo").isNotNull())))
    return group_shares(counts, ["categoria"], spec)


def largest_first(shares: DataFrame) -> DataFrame:
    """Categories ordered by their total, ties by label."""
    return shares.select("categoria", "total").distinct().orderBy(F.desc("total"), "categoria")


def flag_counts(df: DataFrame, keys: Sequence, flags: Sequence[str], trim: bool = False) -> DataFrame:
    """(keys, total, one count per flag) in one pass."""
    answer = "lower(trim(`{0}`))" if trim else "lower(`{0}`)"
    yes = [F.expr(f"count_if({answer.format(c)} = 'sim') AS `{c}`") for c in flags]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *yes)


def flag_prevalence(df: DataFrame, flags: Mapping[str, str], trim: bool = False) -> DataFrame:
    """(coluna, label, valor, total, pct): how many cases answer yes to each flag."""
    wide = flag_counts(df, [], list(flags), trim)
    long = wide.unpivot(["total"], list(flags), "coluna", "valor")
    return long.select("coluna", label_of(flags).alias("label"), "valor", "total",
                       pct1_min1(F.col("valor"), F.col("total")).alias("pct"))


def label_of(labels: Mapping[str, str], column: str = "coluna"):
    return sql_map(labels)[F.col(column)]


def outcome_by_membership(df: DataFrame, flags: Mapping[str, str], spec: CaseSpec = TB) -> DataFrame:
    """Outcome group shares per vulnerable group; a case counts in every group it belongs to.

    One scan counts each flag per raw outcome; the few result rows are unpivoted."""
    cells = flag_counts(df, [F.col(spec.outcome).alias("_out")], list(flags))
    long = cells.unpivot(["_out"], list(flags), "coluna", "n").where(F.col("n") > 0)
    group = outcome_group(canonical_outcome(F.col("_out"), spec), spec)
    return group_shares(long.select(label_of(flags).alias("categoria"), group.alias("grupo"), "n"),
                        ["categoria"], spec)


def union_all_groups(df: DataFrame, flags: Mapping[str, str], spec: CaseSpec = TB) -> DataFrame:
    """The groups one below the other: (categoria, grupo, n), only outcomes that occur. From the
    single scan of ``outcome_by_membership``."""
    return outcome_by_membership(df, flags, spec).where(F.col("n") > 0).select("categoria", "grupo", "n")


def flag_area_heatmap(df: DataFrame, dim: AreaDim, flags: Mapping[str, str], spec: CaseSpec = TB) -> DataFrame:
    """(uf, casos, one percentage per flag), over all cases of the area."""
    wide = flag_counts(attach_area(df, dim, spec), [F.col("sigla").alias("uf")], list(flags))
    return wide.select("uf", F.col("total").alias("casos"),
                       *[pct1(F.col(c), F.col("total")).alias(c) for c in flags])


def flag_area_legacy(df: DataFrame, dim: AreaDim, flags: Sequence[str], spec: CaseSpec = TB) -> DataFrame:
    """Older rule: the denominator is the cases whose form is filled in; unmapped areas stay as '?'."""
    rows = attach_area(df, dim, spec, "left", "?")
    by = rows.groupBy(F.col("sigla").alias("uf")).agg(
        F.count(spec.form).alias("total"), *[n_if(is_yes(F.col(c)), c) for c in flags])
    return by.select("uf", "total", *[pct1_min1(F.col(c), F.col("total")).alias(c) for c in flags])


def wide_to_triples(wide: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(indice_area, indice_indicador, valor) with 0-based positions; areas in code order.
    ``wide`` holds one row per area."""
    from pyspark.sql import Window as W

    order = W.partitionBy(F.lit(0)).orderBy(key)
    position = sql_map({c: i for i, c in enumerate(columns)})
    indexed = wide.select((F.row_number().over(order) - 1).alias("indice_area"), *columns)
    long = indexed.unpivot(["indice_area"], list(columns), "_c", "valor")
    return long.select("indice_area", position[F.col("_c")].alias("indice_indicador"), "valor")


def age_sex_pyramid(df: DataFrame, spec: CaseSpec = TB, deaths_only: bool = False, bands=None) -> DataFrame:
    """(ordem, faixa, masculino, feminino) with every band present."""
    bands = bands or spec.age_bands
    rows = df.where(F.col(spec.age).isNotNull() & F.col(spec.sex).isin(*spec.sexes))
    if deaths_only:
        rows = rows.where(has_outcome(spec.death, spec))
    male, female = spec.sexes
    counts = (rows.groupBy(band(spec.age, bands).alias("faixa"))
              .agg(n_if(F.col(spec.sex) == male, "masculino"), n_if(F.col(spec.sex) == female, "feminino"),
                   F.count(F.lit(1)).alias("_n"))
              .where(after_count(F.col("faixa").isNotNull(), "_n")).drop("_n"))
    position = sql_map({b[0]: i for i, b in enumerate(bands)})
    counts = counts.withColumn("ordem", position[F.col("faixa")])
    return zero_fill(counts, band_grid(df.sparkSession, bands), ["masculino", "feminino"])
