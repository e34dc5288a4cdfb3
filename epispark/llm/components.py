"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge that is not the smallest of its component.

    Every round links each neighbourhood to its smallest node, and ends when nothing changes. The
    smallest neighbour is found by a combined aggregate; the join on it is one that Spark splits
    where one node has very many edges. Only counts reach the driver."""
    star = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = _state(star)
    while before[0]:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = cut(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        after = _state(star)
        if after == before:
            break
        before = after
    return star.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(star: DataFrame) -> tuple:
    return tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
