"""Orderings and top lists. Ties are always broken by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_by_metric(df: DataFrame, metric: str, label: str) -> DataFrame:
    """Sorted for delivery, largest first."""
    return df.orderBy(F.desc(metric), label)


def top_n(df: DataFrame, n: int, metric: str = "casos", label: str = "municipio") -> DataFrame:
    """Largest ``n`` rows: each task keeps ``n``, no full sort."""
    return df.orderBy(F.desc(metric), label).limit(n)


def top_n_per_area(df: DataFrame, n: int, area: str = "uf", metric: str = "casos",
                   label: str = "municipio") -> DataFrame:
    """Largest ``n`` rows of every area. Spark keeps only ``n`` per area and task before the
    shuffle, so an area with very many places does not arrive whole."""
    order = W.partitionBy(area).orderBy(F.desc(metric), F.asc(label))
    return df.withColumn("posicao", F.row_number().over(order)).where(F.col("posicao") <= n)


def ranked_table(df: DataFrame, area: str = "uf", metric: str = "casos", label: str = "municipio") -> DataFrame:
    """1-based position of each place in its area.

    Places are ranged by (area, metric, label), so a large area, and also a large group of equal
    places, is cut into several ranges. A place is numbered within its range and area, and the
    sizes of the ranges before are added: those are one row per range and area."""
    order = [F.asc(area), F.desc(metric), F.asc(label)]
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    inside = W.partitionBy(area, "_range").orderBy(F.desc(metric), F.asc(label))
    before = W.partitionBy(area).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (ranged.groupBy(area, "_range").agg(F.count(F.lit(1)).alias("_n"))
               .select(F.col(area).alias("_area"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above")))
    numbered = ranged.withColumn("_nth", F.row_number().over(inside))
    same = F.col(area).eqNullSafe(F.col("_area")) & (F.col("_range") == F.col("_at"))
    return numbered.join(offsets, same).withColumn("posicao", F.col("_above") + F.col("_nth")).drop("_above", "_nth", "_range", "_area", "_at")


def ordered_series(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def share_within_group(counts: DataFrame, category: str, value: str = "n") -> DataFrame:
    """Adds the group total and the share inside it; ``counts`` is aggregated."""
    total = F.sum(value).over(W.partitionBy(category))
    return (counts.withColumn("total", total)
            .withColumn("pct", F.round(F.col(value) / F.greatest(F.col("total"), F.lit(1)) * 100.0, 1)))
