"""Best-fit packing of documents into sequences of fixed size, with conflicts.

A document longer than the capacity is cut: its full pieces fill sequences of their own, and the rest
is packed like a short document. Documents are dealt to shards by a hash of the identifier; a shard
holds about SHARD_ROWS of them whatever the size of the table, and is packed in one task, in the
order of falling sizes. Its bins lie ordered by what is left in them. A bin carries a bitmap of its
sources, as many bits each as the source may have documents in it, and one of its duplicate clusters; from the first bin that is large
enough the search goes on through its successors until one has no conflict, which is then the
tightest compatible one. Without one, a new bin is opened.

Two documents of a duplicate cluster never share a sequence. Of one source there are at most PER_SOURCE documents in a
sequence, or SPREAD times as many as there would be if the source were spread evenly over all sequences of the shard,
whichever is more: so no source crowds together, and one that has most of the documents still fills its sequences.
Only identifiers, sizes, sources and clusters are shuffled.

Defined results: null texts have size 0; documents of size 0 get a row with length 0 and no bin; null
source and null cluster conflict with nothing; repeated rows are packed once each; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import cut

CAPACITY, PER_SOURCE, SPREAD, SHARD_ROWS = 2048, 4, 3.0, 2048
PLACED = "id string, size long, piece long, start long, length long, bin string, at long"


def source_limits(sizes, sources, capacity: int, per_source: int, spread: float = SPREAD) -> dict:
    """How many documents of each source a sequence of the shard may have."""
    bins = sum(sizes) / capacity
    return {s: max(per_source, math.ceil(spread * n / bins) if bins else 0) for s, n in Counter(sources).items() if s is not None}


def pack_shard(sizes, sources, clusters, capacity: int, limits: dict) -> list[tuple[int, int]]:
    """(bin, offset) of each document of one shard, best fit by falling size."""
    place, width = {}, 0  # source -> the first of its bits, and all of them
    for s in dict.fromkeys(s for s in sources if s is not None):
        place[s] = width, (1 << limits[s]) - 1
        width += limits[s]
    mark = {v: k for k, v in enumerate(dict.fromkeys(c for c in clusters if c is not None))}
    left: list[tuple[int, int]] = []  # (what is left, bin), ascending
    taken: list[int] = []  # bitmap of sources by bin
    within: list[int] = []  # bitmap of clusters by bin
    out: list[tuple[int, int]] = [(-1, 0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[k]
        shift, one = place[sources[k]] if sources[k] is not None else (None, 0)
        bit = 1 << mark[clusters[k]] if clusters[k] is not None else 0
        at = bisect_left(left, (size, -1))
        while at < len(left):
            bin_ = left[at][1]
            full = shift is not None and (taken[bin_] >> shift) & one == one
            if not full and not within[bin_] & bit:
                break
            at += 1
        if at < len(left):
            room, bin_ = left.pop(at)
        else:
            room, bin_ = capacity, len(taken)
            taken.append(0)
            within.append(0)
        out[k] = (bin_, capacity - room)
        if shift is not None:
            held = (taken[bin_] >> shift) & one
            taken[bin_] |= (held + 1 | held) << shift  # one more bit of the source
        within[bin_] |= bit
        if room > size:
            insort(left, (room - size, bin_))
    return out


def pack(rows: DataFrame, *, capacity: int = CAPACITY, per_source: int = PER_SOURCE, spread: float = SPREAD,
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Where each piece of each row goes: id, size, piece, start, length, bin, at.

    `rows` has id, size, source, cluster. `bin` names a sequence of at most `capacity`; a row has one
    piece for each full capacity in it, and one for the rest."""
    # sizes may come from whole texts: they are counted once, and only they are kept
    named = cut(rows.select("id", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), F.col("source").cast("string").alias("source"),
                        F.col("cluster").cast("string").alias("cluster"), F.monotonically_increasing_id().alias("nr")))
    shards = max(1, -(-named.count() // shard_rows))
    full = F.floor(F.col("size") / capacity)
    rest = named.withColumn("start", full * capacity).withColumn("length", F.col("size") - F.col("start")).withColumn("piece", full)
    shard = F.pmod(F.xxhash64("id", "cluster", "size"), F.lit(shards))
    kind = dict(named.dtypes)["id"]

    def pack_one(part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("id", "ascending"), ("cluster", "ascending")])
        sizes, sources, clusters = (part[c].to_pylist() for c in ("length", "source", "cluster"))
        places = pack_shard(sizes, sources, clusters, capacity, source_limits(sizes, sources, capacity, per_source, spread))
        name = part["shard"][0].as_py()
        return part.select(["id", "size", "piece", "start", "length"]).append_column(
            "bin", pa.array([f"{name}-{b}" for b, _ in places], pa.string())).append_column("at", pa.array([a for _, a in places], pa.int64()))

    schema = PLACED.replace("id string", f"id {kind}", 1)
    packed_rest = rest.where("length > 0").withColumn("shard", shard).groupBy("shard").applyInArrow(pack_one, schema)
    whole = (named.where(F.col("size") >= capacity)
             .select("id", "size", F.posexplode(F.sequence(F.lit(1).cast("long"), full)).alias("piece", "nth"), "nr")
             .select("id", "size", F.col("piece").cast("long").alias("piece"), (F.col("piece").cast("long") * capacity).alias("start"),
                     F.lit(capacity).cast("long").alias("length"), F.concat_ws("-", F.lit("full"), "nr", "piece").alias("bin"),
                     F.lit(0).cast("long").alias("at")))
    empty = named.where("size = 0").select("id", "size", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"),
                                           F.lit(0).cast("long").alias("length"), F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("at"))
    return packed_rest.unionByName(whole).unionByName(empty)
