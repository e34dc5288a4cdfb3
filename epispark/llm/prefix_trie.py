"""The trie of conversation prefixes, with count-min screening of prefix digests.

Rows are conv_id, turn, role, text. A conversation is taken by turn, nulls first; equal turns by the
digest of role and text. Each distinct sequence of the first d turns is a node of depth d, from the
root without turns; the conversations that begin so are its members.

A prefix is known by a 127-bit digest that grows by one turn at a time, `d * BASE + turn (mod PRIME)`.
Such steps compose, so a conversation may spread over many tasks: rows without text are ranged by
conversation and place, each task sums up its own rows, and what goes on from the task before is
known from two sums a task (the only rows the driver sees). Texts are read once and never shuffled.

Most prefixes occur once. A count-min sketch of all prefix digests (`DEPTH` rows of counters that stop at
two) is filled task by task and merged slice by slice. An estimate is never too low, so an estimate of one proves that
the prefix has one member: its node is written where it stands. Only prefixes that may be shared are
shuffled and grouped exactly by digest. The sketch has four counters a row for each prefix, up to `WIDEST`
(`DEPTH * WIDEST / 8` bytes reach each task); beyond that more prefixes are grouped exactly, with the same result.

Sums over subtrees need no walk from level to level. The smallest member of a node is also the smallest of
the node's children on its way, so each conversation owns one run of nodes at the end of its path. A run sums
up its own nodes; the nodes above it get one number from each conversation that passes.

Defined results: a null role or text is empty; a null conv_id is a conversation of its own, smaller than all others;
repeated rows are turns of their own; an empty table has no nodes; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.common import kept, shuffle_partitions

PRIME = (1 << 127) - 1
#: Any fixed number of about 127 bits.
BASE = 0x5DEECE66D_0B9C1F37_4A7C15F3_9E3779B9 % PRIME
ROOT = b"\0" * 16
DEPTH, WIDEST = 3, 1 << 24
#: Counters that are merged together.
SLICE = 1 << 16
#: Bytes of member numbers that are hashed as one row.
CHUNK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def turns(rows: DataFrame, words: Column | None = None) -> DataFrame:
    """conv_id, turn, said, words: the digest of role and text, and the words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 15)
    count = F.regexp_count(text, F.lit(WORD)).cast("long") if words is None else words
    return rows.select("conv_id", "turn", said.alias("said"), count.alias("words"))


def _number(value: bytes) -> int:
    return int.from_bytes(value, "big")


def _bytes(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _record(key: T.StructField, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(key.name, key.dataType), *[T.StructField(n, t) for n, t in fields]])


def _columns(batch) -> list[list]:
    return [column.to_pylist() for column in batch.columns]


def _batch(schema: T.StructType, values: list[list]):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(values, arrow)], schema=arrow)


def chained(said: DataFrame) -> DataFrame:
    """conv_id, place (from 1), chain (digest of the conversation's turns up to this one), before (of those before it), words."""
    spark, key = said.sparkSession, said.schema["conv_id"]
    ranged = (said.repartitionByRange(shuffle_partitions(spark), "conv_id", "turn", "said").sortWithinPartitions("conv_id", "turn", "said")
              .select("conv_id", "said", "words"))
    final = _record(key, ("place", T.LongType()), ("chain", T.BinaryType()), ("before", T.BinaryType()), ("words", T.LongType()))
    schema = T.StructType([*final.fields, T.StructField("part", T.IntegerType()), T.StructField("first", T.BooleanType()), T.StructField("last", T.BooleanType())])

    def sum_up(batches):
        """Chains within the task; `first`: rows of its first conversation; `last`: its last row."""
        from pyspark import TaskContext

        part, conv, place, chain, first, held = TaskContext.get().partitionId(), None, 0, 0, None, None
        for batch in batches:
            out = []
            for c, turn, words in zip(*_columns(batch)):
                if first is None or c != conv:
                    conv, place, chain, first = c, 0, 0, first is None
                before, place, chain = chain, place + 1, (chain * BASE + _number(turn)) % PRIME
                if held:
                    out.append(held)
                held = (c, place, _bytes(chain), _bytes(before), words, part, first, False)
            if out:
                yield _batch(schema, list(map(list, zip(*out))))
        if held:
            yield _batch(schema, [[x] for x in (*held[:-1], True)])

    local = kept(ranged.mapInArrow(sum_up, schema), "chains")
    carried = _carried(local)

    def go_on(batches):
        for batch in batches:
            convs, places, chains, befores, words, parts, firsts, _ = _columns(batch)
            for k, part in enumerate(parts):
                if firsts[k] and part in carried:
                    n, value = carried[part]
                    chains[k] = _bytes((value * pow(BASE, places[k], PRIME) + _number(chains[k])) % PRIME)
                    befores[k] = _bytes((value * pow(BASE, places[k] - 1, PRIME) + _number(befores[k])) % PRIME)
                    places[k] += n
            yield _batch(final, [convs, places, chains, befores, words])

    return local.mapInArrow(go_on, final) if carried else local.select(*final.names)


def _carried(local: DataFrame) -> dict[int, tuple[int, int]]:
    """For each task whose first conversation began in a task before: its rows there and their chain. Two rows a task are looked at."""
    own = F.struct("conv_id", "place", "chain")
    ends = (local.where("first or last").groupBy("part")
            .agg(F.max_by(own, F.when(F.col("first"), F.col("place"))).alias("head"), F.max_by(own, F.when(F.col("last"), F.col("place"))).alias("tail")).orderBy("part"))
    carried: dict[int, tuple[int, int]] = {}
    conv, place, chain, begun = None, 0, 0, False
    for row in ends.toLocalIterator():
        head, tail = row["head"], row["tail"]
        n, value = head["place"], _number(head["chain"])
        if begun and head["conv_id"] == conv:
            carried[row["part"]] = place, chain
            n, value = place + n, (chain * pow(BASE, head["place"], PRIME) + value) % PRIME
        if tail["conv_id"] != head["conv_id"]:
            n, value = tail["place"], _number(tail["chain"])
        conv, place, chain, begun = tail["conv_id"], n, value, True
    return carried


def prefixes(chains: DataFrame) -> DataFrame:
    """The prefixes of conversations as they are: conv_id, depth, node, above, words, ends. The root is the node of depth 0."""
    sizes = chains.groupBy(F.col("conv_id").alias("c")).agg(F.max("place").alias("n"))
    own = chains.join(sizes, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", F.col("place").alias("depth"), F.col("chain").alias("node"), F.col("before").alias("above"), "words", (F.col("place") == F.col("n")).alias("ends"))
    return own.unionByName(_roots(sizes.select(F.col("c").alias("conv_id"), F.lit(False).alias("ends"))))


def _roots(convs: DataFrame) -> DataFrame:
    """The root's row of each conversation (conv_id, ends)."""
    return convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("above"),
                        F.lit(0).cast("long").alias("words"), "ends")


def rebuilt(chains: DataFrame, leader: Column, first: Column, most: int) -> DataFrame:
    """The prefixes, as `prefixes` gives them, of rebuilt conversations: the first `first` turns of conversation `leader`, then the own turns after the first `first`.

    `leader` and `first` are columns over conv_id, `first` from 0 to `most`; nulls are no leader and 0. Digests move, texts do not."""
    heads = chains.groupBy("conv_id").agg(F.max("place").alias("n"), *[
        F.max(F.when(F.col("place") == k, F.struct("chain", "words"))).alias(f"t{k}") for k in range(1, most + 1)])
    convs = heads.select("conv_id", "n", F.array(*[F.col(f"t{k}") for k in range(1, most + 1)]).alias("own"),
                         F.coalesce(first, F.lit(0)).cast("int").alias("h"), leader.alias("leader"))
    leaders = convs.select(F.col("conv_id").alias("l"), F.col("own").alias("led"), F.least("n", F.lit(most)).cast("int").alias("l_n"))
    both = kept(convs.join(leaders, F.col("leader") == F.col("l"), "left").withColumn("m", F.least("h", F.coalesce("l_n", F.lit(0)))).select(
        "conv_id", "n", "own", "h", "led", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "leaders")

    def after(turns: str, k: Column) -> Column:
        return F.when(k > 0, F.get(F.col(turns), k - 1)["chain"]).otherwise(F.lit(ROOT))

    k = F.col("k") + 1
    opening = both.where("m > 0").select("conv_id", "led", "length", F.posexplode(F.slice("led", F.lit(1), F.col("m"))).alias("k", "t")).select(
        "conv_id", k.cast("long").alias("depth"), F.col("t.chain").alias("node"), after("led", k - 1).alias("above"), F.col("t.words").alias("words"), (k == F.col("length")).alias("ends"))
    # the own turns leave the chain of the own first turns and go on from the leader's
    jump = both.where("n > h").select(F.col("conv_id").alias("c"), "h", "m", "length", after("led", F.col("m")).alias("onto"), after("own", F.col("h")).alias("off"))
    rows = (chains.join(jump, F.col("conv_id").eqNullSafe(F.col("c"))).where("place > h")
            .select("conv_id", "place", "chain", "before", "words", "h", "m", "length", "onto", "off"))
    schema = _record(chains.schema["conv_id"], ("depth", T.LongType()), ("node", T.BinaryType()), ("above", T.BinaryType()), ("words", T.LongType()), ("ends", T.BooleanType()))

    def move(batches):
        for batch in batches:
            out = []
            for c, place, chain, before, words, h, m, length, onto, off in zip(*_columns(batch)):
                if onto != off:
                    shift, power = _number(onto) - _number(off), pow(BASE, place - h - 1, PRIME)
                    before = _bytes((_number(before) + shift * power) % PRIME)
                    chain = _bytes((_number(chain) + shift * power * BASE) % PRIME)
                depth = place - h + m
                out.append((c, depth, chain, before, words, depth == length))
            if out:
                yield _batch(schema, list(map(list, zip(*out))))

    return rows.mapInArrow(move, schema).unionByName(opening).unionByName(_roots(both.select("conv_id", (F.col("length") == 0).alias("ends"))))


def _cells(nodes: list[bytes], width: int):
    """The counter of each digest in each row of the sketch."""
    import numpy as np

    halves = np.frombuffer(b"".join(nodes), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return [(halves[:, 0] + np.uint64(k) * (halves[:, 1] | np.uint64(1))) % np.uint64(width) for k in range(1, DEPTH + 1)]


def sketch(paths: DataFrame, width: int) -> bytes:
    """The count-min sketch of all prefixes but the root: a bit for each counter, set where it is two or more."""
    counters = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("counters", T.BinaryType())])

    def fill(batches):
        import numpy as np

        own = np.zeros(DEPTH * width, dtype=np.uint8)
        for batch in batches:
            for k, cells in enumerate(_cells(batch.column(0).to_pylist(), width)):
                at, n = np.unique(cells, return_counts=True)
                at = at.astype(np.int64) + k * width
                own[at] = np.minimum(own[at] + np.minimum(n, 2), 2)
        for k, part in enumerate(own.reshape(-1, min(SLICE, width))):
            if part.any():
                yield _batch(counters, [[k], [zlib.compress(part.tobytes(), 1)]])

    def merge(batches):
        import numpy as np

        at, sum_ = None, None
        for batch in batches:
            for k, part in zip(*_columns(batch)):
                part = np.frombuffer(zlib.decompress(part), dtype=np.uint8)
                if k != at:
                    if at is not None:
                        yield _batch(counters, [[at], [np.packbits(sum_ > 1).tobytes()]])
                    at, sum_ = k, part.copy()
                else:
                    sum_ = np.minimum(sum_ + part, 2)
        if at is not None:
            yield _batch(counters, [[at], [np.packbits(sum_ > 1).tobytes()]])

    filled = paths.where("depth > 0").select("node").mapInArrow(fill, counters)
    slices = filled.repartition(shuffle_partitions(paths.sparkSession), "slice").sortWithinPartitions("slice").mapInArrow(merge, counters)
    size = min(SLICE, width) // 8
    bits = bytearray(DEPTH * width // 8)
    for row in slices.collect():  # the sketch itself: DEPTH * WIDEST / 8 bytes at most
        bits[row["slice"] * size:(row["slice"] + 1) * size] = row["counters"]
    return bytes(bits)


def screened(paths: DataFrame, widest: int = WIDEST) -> DataFrame:
    """The paths with `shared` and `above_shared`: false where the sketch proves that the prefix, or the one above, has one member."""
    width = 1 << 10
    rows = paths.count()
    while width < min(4 * rows, widest):
        width *= 2
    bits = paths.sparkSession.sparkContext.broadcast(sketch(paths, width))

    @F.pandas_udf("boolean")
    def shared(nodes):
        import numpy as np
        import pandas as pd

        table = np.frombuffer(bits.value, dtype=np.uint8)
        out = np.ones(len(nodes), dtype=bool)
        for k, cells in enumerate(_cells(list(nodes), width)):
            at = cells.astype(np.int64) + k * width
            out &= (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return pd.Series(out)

    known = F.coalesce("above", F.lit(ROOT))
    return paths.select("*", (shared("node") | (F.col("depth") == 0)).alias("shared"), (shared(known) | (F.col("depth") == 1)).alias("above_shared"))


def _member_hashes(ending: DataFrame) -> DataFrame:
    """depth, node, ends_sha256 of the conversations that end at a node, by their numbers in order.

    They are ranged over the tasks, which write runs of numbers as pieces of text; the pieces of a node, some thousand
    numbers each, then pass one hash as a stream, since SHA-256 goes from start to end."""
    pieces = T.StructType([T.StructField("depth", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("part", T.IntegerType()),
                           T.StructField("nth", T.LongType()), T.StructField("piece", T.StringType())])
    hashes = T.StructType([T.StructField("depth", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("ends_sha256", T.StringType())])

    def write(batches):
        from pyspark import TaskContext

        part, nth, at, own, size = TaskContext.get().partitionId(), 0, None, [], 0
        for batch in batches:
            out = []
            for depth, node, conv in zip(*_columns(batch)):
                if own and ((depth, node) != at or size >= CHUNK):
                    out.append((*at, part, nth, ",".join(own)))
                    nth, own, size = nth + 1, [], 0
                at = depth, node
                own.append("" if conv is None else str(conv))
                size += len(own[-1]) + 1
            if out:
                yield _batch(pieces, list(map(list, zip(*out))))
        if own:
            yield _batch(pieces, [[x] for x in (*at, part, nth, ",".join(own))])

    def hash_up(batches):
        import hashlib

        at, state, out = None, None, []
        for batch in batches:
            for depth, node, _, _, piece in zip(*_columns(batch)):
                if (depth, node) != at:
                    if state:
                        out.append((*at, state.hexdigest()))
                    at, state = (depth, node), hashlib.sha256(piece.encode())
                else:
                    state.update(("," + piece).encode())
            if out:
                yield _batch(hashes, list(map(list, zip(*out))))
                out = []
        if state:
            yield _batch(hashes, [[x] for x in (*at, state.hexdigest())])

    n = shuffle_partitions(ending.sparkSession)
    written = (ending.select("depth", "node", "conv_id").repartitionByRange(n, "depth", "node", "conv_id")
               .sortWithinPartitions("depth", "node", "conv_id").mapInArrow(write, pieces))
    return written.repartition(n, "depth", "node").sortWithinPartitions("depth", "node", "part", "nth").mapInArrow(hash_up, hashes)


def _below(groups: DataFrame) -> DataFrame:
    """conv_id, depth, own: what the conversation's own nodes from this depth on save. Long runs are summed in blocks."""
    rows = groups.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saves"), F.floor(F.col("depth") / 4096).alias("block"))
    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("saves").alias("saves")).select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("saves").over(later), F.lit(0)).alias("later"))
    return (rows.withColumn("own", F.sum("saves").over(within)).join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
            .select("conv_id", "depth", (F.col("own") + F.col("later")).alias("own")))


def trie(paths: DataFrame, widest: int = WIDEST) -> DataFrame:
    """One row for each node of the paths: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = kept(screened(kept(paths, "paths"), widest), "screened")
    maybe, alone = rows.where("shared"), rows.where("not shared")
    nothing = F.sha2(F.lit("").cast("binary"), 256)

    # exact groups of what may be shared
    least = F.min(F.struct("conv_id"))["conv_id"]
    groups = kept(maybe.groupBy("depth", "node").agg(least.alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
                                                     F.count_if("ends").alias("n_ends"), F.max("above").alias("above")), "groups")
    first_alone = alone.where("above_shared")
    children = (groups.select("depth", "above").unionByName(first_alone.select("depth", "above")).where("depth > 0")
                .groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("node")).agg(F.count("*").alias("n_children")))

    # each conversation's run of own nodes: where it begins, what it saves, whether it ends in a leaf
    runs = (groups.select("conv_id", F.col("depth").alias("since"), ((F.col("n_convs") - 1) * F.col("words")).alias("saves"), (F.col("n_ends") == F.col("n_convs")).alias("leaf"))
            .unionByName(alone.where("ends").select("conv_id", F.lit(None).cast("long").alias("since"), F.lit(0).cast("long").alias("saves"), F.lit(True).alias("leaf")))
            .groupBy(F.col("conv_id").alias("c")).agg(F.min("since").alias("since"), F.sum("saves").alias("saves"), F.max("leaf").alias("leaf")))
    passed = (maybe.join(runs, F.col("conv_id").eqNullSafe(F.col("c"))).groupBy("depth", "node")
              .agg(F.count_if("leaf").alias("n_leaves"), F.sum(F.when(F.col("depth") < F.col("since"), F.col("saves")).otherwise(0)).alias("passing")))

    top = groups.where("depth = 0").select("conv_id").first()  # the root
    top = F.lit(top[0] if top else None).cast(rows.schema["conv_id"].dataType)
    parents = groups.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("node").alias("above"), F.col("conv_id").alias("parent"))
    # the root's children, of which there may be any number, need no join
    upper, lower = groups.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, top)), groups.where("depth > 1")
    lower = lower.join(parents, ["depth", "above"], "left").withColumn("parent_conv_id", F.when(F.col("parent").isNull(), F.col("conv_id")).otherwise(F.col("parent"))).drop("parent")
    below = _below(groups).select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), "own")
    shared = (upper.unionByName(lower).join(children, ["depth", "node"], "left").join(passed, ["depth", "node"], "left")
              .join(_member_hashes(maybe.where("ends")), ["depth", "node"], "left")
              .join(below, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("depth") == F.col("d")))
              .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                      F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"), (F.col("own") + F.coalesce("passing", F.lit(0))).cast("long").alias("saved_tokens"),
                      F.coalesce("ends_sha256", nothing).alias("ends_sha256")))

    one = F.when(F.col("ends"), F.sha2(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary"), 256)).otherwise(nothing)
    single = lambda df, parent: df.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (~F.col("ends")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), one.alias("ends_sha256"))
    tails = single(alone.where("not above_shared"), F.col("conv_id"))
    tops = single(first_alone.where("depth = 1"), top)
    joints = single(first_alone.where("depth > 1").join(parents, ["depth", "above"]), F.col("parent"))
    return shared.unionByName(tails).unionByName(tops).unionByName(joints)
