"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Words per source give targets: the sources share a multiple of all words by weight, none above a
   multiple of its own words; what a capped source leaves is shared again by weight.
2. All words are cut into equal blocks, and the blocks of the mix are allocated to sources by highest
   quotients target / (2 k + 1).
3. A source is split into shards by a hash of the identifier, in proportion to its words. Its blocks
   go to its shards by highest quotients too, so every shard has an integer quota.
4. In a shard the documents lie end to end in seeded order. Whole passes are taken first, the rest is
   a seeded choice of blocks; a document counts the words of it that lie in chosen blocks.

Only sums per (source, hash bucket) are shuffled before the last step, which sorts identifiers and
sizes within a shard. There are at most SHARDS shards besides one per source, so a source with most
of the rows is spread over most shards. Block and shard sizes are fixed shares of all words, so the
same rules hold at every size.

Defined results: a null text has no words; a document without words is taken 0 times; null is a
source of its own, the last one; equal quotients go by the order of the sources; repeated rows count once each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.llm.common import cut, packed, whole_text

#: Blocks that all words are cut into, and shards that all words are dealt to.
BLOCKS, SHARDS = 2**20, 2**11
#: Prime stride of the seeded order of blocks.
STRIDE = 2147483647
#: Rows of the table of quotas that may be broadcast.
MOST_BROADCAST = 100_000
SPACES = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    inner = F.btrim(whole_text(text), F.lit(SPACES))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, f"[{SPACES}]+"))).cast("long")


def highest_quotients(parties: DataFrame, group: list[str], key: Column, votes: str, seats: str) -> DataFrame:
    """Sainte-Laguë seats of each party within its group, as column `won`.

    Rounding the exact shares hits the right divisor but for at most half a seat per party, so only
    the quotients near it are written out: at most 1.5 per party on average, and two more each."""
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    cols = parties.columns
    shares = (parties.withColumn("_part", F.when(F.sum(votes).over(whole) > 0, F.col(votes) / F.sum(votes).over(whole)).otherwise(F.lit(0.0)))
              .withColumn("_near", F.floor(F.col("_part") * F.col(seats) + 0.5))
              .withColumn("_open", F.when(F.sum(votes).over(whole) > 0, F.col(seats) - F.sum("_near").over(whole)).otherwise(F.lit(0)))
              .withColumn("_reach", F.ceil(F.col("_part") * F.count("*").over(whole) * 1.5).cast("int")))
    give = F.col("_open") > 0
    divisor = F.when(give, 2 * (F.col("_near") + F.col("_k")) + 1).otherwise(2 * (F.col("_near") - F.col("_k")) - 1)
    tried = (shares.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_reach"))))
             .withColumn("_quotient", F.when(divisor > 0, F.col(votes) / divisor)))
    better = Window.partitionBy(*group, give) if group else Window.partitionBy(give)
    place = F.row_number().over(better.orderBy(
        F.when(give, -F.col("_quotient")).otherwise(F.col("_quotient")).asc_nulls_last(), key.asc_nulls_last(), "_k"))
    change = F.when((F.col("_place") <= F.abs("_open")) & F.col("_quotient").isNotNull(), F.signum("_open")).otherwise(F.lit(0))
    return (tried.withColumn("_place", place).withColumn("_change", change)
            .groupBy(*cols, "_near").agg(F.sum("_change").alias("_change"))
            .select(*cols, (F.col("_near") + F.col("_change")).cast("long").alias("won")))


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Target words per source: columns of `sources` (key, source, words) and `target`."""
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = (sources.withColumn("weight", weight).withColumn("most", F.col("words") * float(cap))
            .withColumn("wanted", F.sum("words").over(everything) * float(share)))
    # Sources reach their cap in the order of cap / weight as the common level rises.
    rising = everything.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("wanted") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = (rows.withColumn("level", level).withColumn("order", F.row_number().over(rising))
            .withColumn("capped", F.col("most") / F.col("weight") <= F.col("level")))
    common = F.min_by(F.col("level"), F.when(~F.col("capped"), F.col("order"))).over(everything)
    return rows.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(common * F.col("weight"))).select(
        "key", "source", "words", "target")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
        weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """Each row with the words that the mix takes of it.

    Columns: row, id, size, source_size, target (of the source), taken (repeats counted, at most
    cap times the size)."""
    placed = _placed(df, id_col, text_col, source_col, weights, share, cap, seed)
    return placed.select("row", "id", "size", "source_size", "target", _taken(seed).alias("taken"))


def _placed(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, cap: float, seed: int) -> DataFrame:
    """Each row with its place (`end`) in the seeded order of its shard, beside the shard's words and quota."""
    source = df[source_col].cast("string")
    rows = packed(df, id=df[id_col], source=source, size=word_count(df[text_col]),
                  key=F.coalesce(F.concat(F.lit("="), source), F.lit("-")),
                  draw=F.xxhash64(df[id_col], F.lit(seed)))
    rows = rows.withColumn("bucket", F.pmod("draw", F.lit(SHARDS)).cast("int"))
    fine = cut(rows.groupBy("key", "source", "bucket").agg(F.sum("size").alias("words")))
    aims = targets(fine.groupBy("key", "source").agg(F.sum("words").alias("words")), weights, share, cap)
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("words").over(everything)
    aims = (aims.withColumn("block", F.greatest(F.lit(1), F.ceil(total / BLOCKS)).cast("long"))
            .withColumn("shards", F.when(total > 0, F.greatest(F.lit(1), F.least(F.lit(SHARDS), F.ceil(F.col("words") / total * SHARDS)))).otherwise(F.lit(1)))
            .withColumn("seats", F.round(F.sum("target").over(everything) / F.col("block")).cast("long")))
    aims = highest_quotients(aims, [], F.col("source"), "target", "seats").drop("seats").withColumnRenamed("words", "source_size")
    shard = F.floor(F.col("bucket") * F.col("shards") / SHARDS)
    dealt = (fine.select("key", "bucket", "words").join(aims, "key").withColumn("shard", shard)
             .groupBy("key", "source_size", "target", "block", "shards", "shard", F.col("won").alias("seats"))
             .agg(F.sum("words").alias("words")))
    quotas = highest_quotients(dealt, ["key"], F.col("shard"), "words", "seats")
    quotas = cut(quotas.withColumn("quota", F.least(F.col("won") * F.col("block"), F.floor(F.col("words") * float(cap)))).drop("seats", "won"))
    # One row per shard: with few sources a table of known size, else an ordinary join.
    small = F.broadcast if quotas.count() <= MOST_BROADCAST else (lambda table: table)
    placed = (rows.join(small(quotas.select("key", "shards").distinct()), "key").withColumn("shard", shard)
              .join(small(quotas.drop("shards")), ["key", "shard"]))
    ends = Window.partitionBy("key", "shard").orderBy("draw", "id", "size")
    return placed.withColumn("end", F.sum("size").over(ends.rowsBetween(Window.unboundedPreceding, 0)))


def _taken(seed: int) -> Column:
    size, block, end = F.col("size"), F.col("block"), F.col("end")
    words = F.greatest(F.col("words"), F.lit(1))
    start = end - size
    full = F.floor(words / block)  # blocks of the shard; what is left over is a short last one
    rest = F.col("quota") - F.floor(F.col("quota") / words) * words
    turn = F.pmod(F.xxhash64("key", "shard", F.lit(seed)), F.greatest(full, F.lit(1)))

    def in_block(total: Column, b: Column) -> Column:
        rank = F.when(b >= full, full).otherwise(F.pmod(b * STRIDE + turn, F.greatest(full, F.lit(1))))
        length = F.when(b >= full, words - full * block).otherwise(block)
        chosen = F.least(length, F.greatest(F.lit(0), rest - rank * block))
        return total + F.greatest(F.lit(0), F.least(end, b * block + chosen) - F.greatest(start, b * block))

    partly = F.aggregate(F.sequence(F.floor(start / block), F.floor((end - 1) / block)), F.lit(0).cast("long"), in_block)
    return F.when(size > 0, F.floor(F.col("quota") / words) * size + partly).otherwise(F.lit(0)).cast("long")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
          weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """The mix as documents: whole rows, repeated so that every shard keeps its quota of words.

    Whole passes repeat every row of the shard. Of the rest, rows are taken once more in the seeded
    order while they fit; the row across the end of the rest is taken where the running sum of what
    the source still lacks calls for it. A shard is thus off by less than one row, a source by about
    half of one."""
    placed = _placed(df, id_col, text_col, source_col, weights, share, cap, seed).where("size > 0")
    passes = F.floor(F.col("quota") / F.col("words"))
    line = placed.select("row", "key", "shard", "size", "end", (F.col("end") - F.col("size")).alias("start"),
                         passes.cast("int").alias("passes"), (F.col("quota") - passes * F.col("words")).alias("rest"))
    across = (F.col("start") < F.col("rest")) & (F.col("end") > F.col("rest"))
    chosen = cut(_called_for(line.where(across).select("key", "shard", "size", (F.col("rest") - F.col("start")).alias("part"))))
    # At most one row per shard.
    small = F.broadcast if chosen.count() <= MOST_BROADCAST else (lambda table: table)
    once_more = (F.col("end") <= F.col("rest")) | (across & F.col("_called").isNotNull())
    return (line.join(small(chosen.withColumn("_called", F.lit(True))), ["key", "shard"], "left")
            .withColumn("times", F.col("passes") + once_more.cast("int")).where("times > 0")
            .select(F.explode(F.array_repeat("row", F.col("times"))).alias("row")).select("row.*"))


def _called_for(crossing: DataFrame) -> DataFrame:
    """key, shard of the rows to take, of one row per shard with its size and the part of it that is wanted.

    Per source the parts are summed from the largest row to the smallest, less what was taken; a row
    is taken where the sum makes up half of it. A source has at most SHARDS such rows."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "shard", "part")))
    start = F.struct(F.lit(0).cast("long").alias("open"), F.array().cast("array<long>").alias("shards"))

    def step(state: Column, row: Column) -> Column:
        wanted = (state["open"] + row["part"]).cast("long")
        take = 2 * wanted >= -row["less"]
        return F.struct(F.when(take, wanted + row["less"]).otherwise(wanted).cast("long").alias("open"),
                        F.when(take, F.concat(state["shards"], F.array(row["shard"].cast("long")))).otherwise(state["shards"]).alias("shards"))

    return crossing.groupBy("key").agg(F.aggregate(rows, start, step)["shards"].alias("shards")).select("key", F.explode("shards").alias("shard"))
