"""Counts by category, shares and dense grids."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epispark.functions.clean import attach_area, is_closed
from epispark.functions.measures import pct1
from epispark.functions.text import INVALID_LABELS, clean_label, fold_key, is_valid_label, strip_ws
from epispark.literals import sql_text
from epispark.spec import TB, AreaDim, CaseSpec


def count_by(df: DataFrame, *keys, name: str = "casos") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, column: str, spec: CaseSpec = TB) -> DataFrame:
    """(label, valor). Raw values are counted first, so the label clean-up runs once per
    distinct value and not once per row."""
    raw = count_by(df, F.col(column).cast("string").alias("label"), name="valor")
    return merge_labels(raw, spec)


def merge_labels(raw: DataFrame, spec: CaseSpec = TB) -> DataFrame:
    """Cleans the labels of a small (label, valor) table and sums those that coincide."""
    label = clean_label(F.col("label"), spec.unknown).alias("label")
    return raw.groupBy(label).agg(F.sum("valor").alias("valor"))


def multi_counts(df: DataFrame, blocks: Mapping[str, Sequence[str]]) -> DataFrame:
    """(bloco, k1 … kn, n): counts for several key lists in one scan.

    Each row is stacked once per block inside the map task and counted there; what is shuffled is
    one row per distinct key combination and task."""
    depth = max(len(keys) for keys in blocks.values())
    rows = []
    for name, keys in blocks.items():
        texts = [f"string(`{k}`)" for k in keys] + ["string(NULL)"] * (depth - len(keys))
        rows.append(", ".join([sql_text(name), *texts]))
    names = ["bloco", *[f"k{i + 1}" for i in range(depth)]]
    stacked = df.selectExpr(f"stack({len(blocks)}, {', '.join(rows)}) AS ({', '.join(names)})")
    return count_by(stacked, *names, name="n")


def after_count(condition: Column, n: str = "n") -> Column:
    """A condition for counted rows. It refers to the count, so the optimizer cannot push it
    below the aggregate, where text functions would run once per input row."""
    return F.when(F.col(n) > 0, condition)


def multi_value_counts(df: DataFrame, columns: Sequence[str], spec: CaseSpec = TB) -> DataFrame:
    """(dimensao, label, valor) for several columns at once, from one scan."""
    raw = multi_counts(df, {c: [c] for c in columns})
    return (raw.groupBy(F.col("bloco").alias("dimensao"), clean_label(F.col("k1"), spec.unknown).alias("label"))
            .agg(F.sum("n").alias("valor")))


def zero_fill(counts: DataFrame, grid: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Adds the missing rows of a literal grid with zeros. Union and re-sum: no join."""
    keys = [c for c in counts.columns if c not in measures]
    zeros = grid.select(*keys, *[F.lit(0).cast("long").alias(m) for m in measures])
    return (counts.unionByName(zeros).groupBy(*keys)
            .agg(*[F.sum(m).cast("long").alias(m) for m in measures]))


def share_of_total(counts: DataFrame, label: str = "label", value: str = "valor",
                   within: Sequence[str] = ()) -> DataFrame:
    """Adds ``pct`` of the total (within ``within``), from an aggregated table. The total of all
    labels is a scalar, so they do not meet in one task."""
    total = F.sum(value).over(W.partitionBy(*within)) if within else counts.agg(F.sum(value)).scalar()
    return counts.withColumn("pct", pct1(F.col(value), total))


def drop_invalid_labels(df: DataFrame, column: str,
                        also: Iterable[str] = ("nao informado", "ignorado")) -> DataFrame:
    return df.where(is_valid_label(F.col(column), tuple(also)))


def category_shares(df: DataFrame, column: str,
                    drop: Iterable[str] = ("nao informado", "ignorado")) -> DataFrame:
    """(label, valor, pct) after dropping technical and unknown labels."""
    raw = count_by(df, F.col(column).alias("label"), name="valor")
    kept = raw.where(after_count(is_valid_label(F.col("label"), tuple(drop)), "valor"))
    counts = kept.groupBy(strip_ws(F.col("label")).alias("label")).agg(F.sum("valor").alias("valor"))
    return share_of_total(counts)


def top_categories(counts: DataFrame, k: int) -> DataFrame:
    """First ``k`` labels with their share of all labels and of the shown ones."""
    whole = counts.withColumn("total", counts.agg(F.sum("valor")).scalar())
    top = whole.orderBy(F.desc("valor"), "label").limit(k)
    shown = F.sum("valor").over(W.partitionBy(F.lit(0)))
    return top.select("label", "valor", "total", pct1(F.col("valor"), F.col("total")).alias("pct_total"),
                      pct1(F.col("valor"), shown).alias("pct_mostrado"))


def distinct_places(df: DataFrame, spec: CaseSpec = TB, dim: AreaDim | None = None) -> DataFrame:
    """Distinct place names; with the area dimension, equal names of different areas are kept apart
    and those of unmapped areas left out."""
    if dim is None:
        return df.agg(F.countDistinct(spec.place).alias("municipios"))
    return attach_area(df, dim, spec).agg(F.countDistinct("sigla", spec.place).alias("municipios"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("valor")).where(F.col("valor").isNotNull()).distinct()


def dedupe_spellings(values: DataFrame, column: str = "valor", keys: Sequence[str] = ()) -> DataFrame:
    """One spelling per folded value, an accented one when there is any."""
    v = count_by(values, *keys, strip_ws(F.col(column)).alias("valor"), name="n")
    v = v.where(after_count(F.col("valor").isNotNull() & ~F.lower("valor").isin(*INVALID_LABELS)))
    accented = F.col("valor").rlike(r"[^\x00-\x7F]")
    best = F.max_by("valor", F.struct(accented, F.col("valor")))
    return (v.groupBy(*keys, fold_key(F.col("valor")).alias("_key")).agg(best.alias("valor"))
            .drop("_key"))


def filter_options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dimensao, valor): the choices of each filter, over the whole series, in one scan."""
    raw = multi_counts(df, {c: [c] for c in columns})
    return dedupe_spellings(raw.select(F.col("bloco").alias("dimensao"), F.col("k1").alias("valor")),
                            keys=["dimensao"])


def selection_choices(df: DataFrame, spec: CaseSpec = TB) -> DataFrame:
    """(bloco, valor): calendar years and the choices of every filter, one spelling each, in one scan."""
    columns = {"anos": spec.year, "sexo": spec.sex, "formas": spec.form, "racas": spec.race, "entradas": spec.entry, "hiv": spec.hiv}
    cells = multi_counts(df, {k: [c] for k, c in columns.items()})
    return dedupe_spellings(cells.where(F.col("k1").isNotNull()).select("bloco", F.col("k1").alias("valor")), keys=["bloco"])


def unknown_share(df: DataFrame, spec: CaseSpec = TB) -> DataFrame:
    """(dimensao, n, total, pct) of unknown or still open values, in one pass."""
    def unknown(column: str) -> Column:
        return F.coalesce(fold_key(F.col(column)).isin("nao informado", "ignorado"), F.lit(True))

    known_hiv = F.coalesce(F.col(spec.hiv).isin(spec.positive, spec.negative), F.lit(False))
    conditions = {
        "sexo": unknown("sexo"), "forma": unknown("forma"), "status_hiv": ~known_hiv,
        "desfecho": ~is_closed(spec),
    }
    # Distinct combinations are few; the text clean-up runs on them, not on every row.
    cells = count_by(df, F.col(spec.sex).alias("sexo"), F.col(spec.form).alias("forma"),
                     spec.hiv, spec.outcome, name="n")
    sums = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in conditions.items()]
    wide = cells.agg(F.sum("n").alias("total"), *sums)
    return (wide.unpivot(["total"], list(conditions), "dimensao", "n")
            .select("dimensao", "n", "total", pct1(F.col("n"), F.col("total")).alias("pct")))
