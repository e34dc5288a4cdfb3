"""Structure repair of conversations: the cheapest edits that make the turns alternate, by branch and bound.

Rows are conv_id, turn, role, text. A conversation is taken by turn, nulls first; equal turns by role,
then by SHA-256 of the text. The first fault of a row counts: blank (nothing but white space),
duplicate (role and text seen earlier in the conversation), truncated (its last character other than
white space is none of `.!?`). Edits, with the letter and cost of each:

    D  delete the row                                     3; blank and duplicate rows must go
    I  insert an empty text of the user or assistant      2, anywhere
    K  keep the row                                       0, truncated 1
    R  give the row the role user or assistant            2, truncated 3

Roles that are left must read `(s?(ua)+)?` by their first letters. Of the cheapest edits those with the
least string of letters (the audit) are taken; letters fix the roles that are set and inserted.

`search` walks depth first with a stack of its own. A node is (rows done, last role). A bound on what
the rest must cost, from rows that cannot stay as they are and from disjoint pairs of neighbours that
cannot stand together, cuts nodes that cannot beat the best (cost, audit) so far; a table of the best
(cost, audit) of each node cuts worse ways to it. It ends when the stack is empty, which proves the optimum.

Nothing needs a whole conversation in one task but its text in order, for a digest. Rows without their text
are ranged over the tasks by conversation and place, so a conversation with a large share of all rows
spreads. Up to `SEGMENT` rows are searched at once; for a part of a longer conversation, or of one that goes on
in another task, `search` runs for each role before and after the part, and the parts are then put together by
their costs. Parts end with an edited row, so no audit of a part begins another, and the least audit of the
whole takes the least one part by part.

Defined results: a null role or text is one space, a null conv_id is a conversation of its own, equal rows are
duplicates, an empty table gives an empty result, other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.common import kept, shuffle_partitions

#: Rows of a conversation that one search holds at most.
SEGMENT = 96
SPACE = " \t\n\v\f\r"
#: Last role: none yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may be inserted or set after each.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that end a conversation after each last role.
CLOSING = (0, 2, 1, 0)
#: What a row is to the search: its first letter, plus CUT if truncated; or that it must go.
KINDS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
CUT, DOOMED = 4, 8
#: The goal of a search that ends the conversation.
ALL = None


def _bounds(codes: bytes, closed: bool) -> tuple[list[int], list[int], list[int], list[int]]:
    """Per place: cost of single rows; pairs beyond the first run; edges of the first run; the first live row's kind."""
    n = len(codes)
    alone, pairs, edges, first = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [START] * (n + 1)
    last = True  # no row after this one may stay
    for i in range(n - 1, -1, -1):
        code = codes[i]
        if code == DOOMED:
            alone[i], pairs[i], edges[i], first[i] = alone[i + 1] + 3, pairs[i + 1], edges[i + 1], first[i + 1]
            continue
        kind = code & 3
        alone[i] = alone[i + 1] + (code & CUT > 0) + 2 * (kind in (START, SYSTEM))
        first[i] = kind
        if kind in (USER, ASSISTANT) and kind == first[i + 1] or kind == USER and closed and last:
            pairs[i], edges[i] = pairs[i + 1], edges[i + 1] + 1
        else:
            pairs[i], edges[i] = pairs[i + 1] + (edges[i + 1] + 1) // 2, 0
        last = False
    return alone, pairs, edges, first


def search(codes: bytes, entry: int = START, goal=ALL) -> tuple[int, str] | None:
    """The least (cost, audit) from the last role `entry`; goal: the last role after the last row, or ALL: a proper end."""
    n, closed = len(codes), goal is ALL
    alone, pairs, edges, first = _bounds(codes, closed)

    def bound(i: int, state: int) -> int:
        kind = first[i]
        clash = (kind == USER and state == USER) or (kind == ASSISTANT and state != USER)
        spared = 2 if state == START else 0  # one system row may stay as the first
        return max(0, alone[i] - spared) + 2 * (pairs[i] + (edges[i] + clash + 1) // 2)

    best: tuple[int, str] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, "", 0, entry)]
    while stack:
        cost, audit, i, state = stack.pop()
        least = cost + bound(i, state)
        if best is not None and (least > best[0] or least == best[0] and audit > best[1][:len(audit)]):
            continue
        if (i, state) in seen and seen[i, state] <= (cost, audit):
            continue
        seen[i, state] = cost, audit
        if i == n:
            if closed:
                done = cost + 2 * CLOSING[state], audit + "I" * CLOSING[state]
                if best is None or done < best:
                    best = done
            elif state == goal and (best is None or (cost, audit) < best):
                best = cost, audit
            continue
        code = codes[i]
        ways = [(cost + 3, audit + "D", i + 1, state), (cost + 2, audit + "I", i, NEXT[state])]
        if code != DOOMED:
            kind, worn = code & 3, code >> 2 & 1
            if kind == NEXT[state] or kind == SYSTEM and state == START:
                ways.append((cost + worn, audit + "K", i + 1, kind))
            ways.append((cost + 2 + worn, audit + "R", i + 1, NEXT[state]))
        ways.sort(key=lambda w: (w[0] + bound(w[2], w[3]), w[1]), reverse=True)
        stack += ways
    return best


@lru_cache(maxsize=1 << 14)
def _known(codes: bytes, entry: int, goal) -> tuple[int, str] | None:
    return search(codes, entry, goal)


def _parts(codes: bytes) -> list[dict]:
    """All ways through a part: entry, leave, cost, the audit's place among those of the entry, audit."""
    out = []
    for entry in range(4):
        found = [(a, c, leave) for leave in range(4) for c, a in [_known(codes, entry, leave) or (0, None)] if a is not None]
        out += [{"entry": entry, "leave": leave, "cost": c, "place": k, "audit": a} for k, (a, c, leave) in enumerate(sorted(found))]
    return out


def labelled(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, blank, cut: what the search needs of each row."""
    said = F.rtrim(F.col("text"), F.lit(SPACE))
    return _plain(rows).select("conv_id", "turn", "role", _digest().alias("digest"), (said == "").alias("blank"),
                               (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("cut"))


def _plain(rows: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _with_late(labels: DataFrame) -> DataFrame:
    """late: the conversation has the row's role and text at an earlier turn."""
    first = (labels.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
             .agg(F.min(F.struct("turn")).alias("first")))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return labels.join(first, same).select(*labels.columns, (~F.struct("turn").eqNullSafe(F.col("first"))).alias("late"))


PART = T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("leave", T.IntegerType()), T.StructField("cost", T.LongType()),
                     T.StructField("place", T.IntegerType()), T.StructField("audit", T.StringType())])
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _segment_schema(key: T.DataType) -> T.StructType:
    long, text = T.LongType(), T.StringType()
    return T.StructType([T.StructField("conv_id", key), T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()),
                         T.StructField("whole", T.BooleanType()), *[T.StructField(c, long) for c in COUNTS],
                         T.StructField("low", long), T.StructField("high", long), T.StructField("head", text), T.StructField("tail", text),
                         T.StructField("ways", T.ArrayType(PART))])


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row for each part of a conversation: its counts and the ways through it."""
    labels = _with_late(labelled(rows))
    ranged = (labels.repartitionByRange(shuffle_partitions(rows.sparkSession), "conv_id", "turn", "role", "digest")
              .sortWithinPartitions("conv_id", "turn", "role", "digest"))
    schema = _segment_schema(rows.schema["conv_id"].dataType)

    def cut_up(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part, numbered = to_arrow_schema(schema), TaskContext.get().partitionId(), 0
        conv, own, last, open_before, at_edge = None, [], None, False, True
        out: list[dict] = []

        def flush(ends: bool, edge: bool) -> None:
            """Close the part; ends: of the conversation, as far as this task sees; edge: another task may go on."""
            nonlocal own, numbered, open_before
            if not own:
                return
            codes = bytes(x[0] for x in own)
            whole = ends and not edge and not open_before and not at_edge
            turns = [x[2] for x in own if x[2] is not None]
            if whole:
                cost, audit = _known(codes, START, ALL)
                ways = [{"entry": START, "leave": START, "cost": cost, "place": 0, "audit": audit}]
            else:
                ways = _parts(codes)
            out.append({"conv_id": conv, "part": part, "segment": numbered, "whole": whole,
                        "blank": sum(x[1] == "b" for x in own), "duplicate": sum(x[1] == "d" for x in own), "truncated": sum(x[1] == "t" for x in own),
                        "illegal": sum(a[3] + b[3] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
                        "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None),
                        "head": own[0][3], "tail": own[-1][3], "ways": ways})
            numbered, own, open_before = numbered + 1, [], not ends

        began = False
        for batch in batches:
            for c, turn, role, digest, blank, worn, late in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if began and c != conv:
                    flush(True, False)
                    at_edge, open_before, last = False, False, None
                conv, began = c, True
                if len(own) >= size:
                    flush(False, False)
                key = turn, role, digest
                fault = "b" if blank else "d" if late or key == last else "t" if worn else ""
                last = key
                code = DOOMED if fault in ("b", "d") else KINDS.get(role[:1], START) + (CUT if fault == "t" else 0)
                own.append((code, fault, turn, role[:1]))
            while len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out[:1024], schema=arrow)
                del out[:1024]
        flush(True, True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ranged.mapInArrow(cut_up, schema)


def put_together(parts: list[list[tuple[int, int, int, int]]]) -> list[tuple[int, int, int]]:
    """(entry, leave, inserts after it) of each part; parts: ways (entry, leave, cost, place) in order."""
    rest = [[2 * c for c in CLOSING]]
    for ways in reversed(parts):
        after = rest[-1]
        rest.append([min((c + after[x] for e, x, c, _ in ways if e == s), default=1 << 60) for s in range(4)])
    rest.reverse()
    out, state = [], START
    for k, ways in enumerate(parts):
        _, leave = min((place, x) for e, x, c, place in ways if e == state and c + rest[k + 1][x] == rest[k][state])
        out.append((state, leave, 0))
        state = leave
    if out:
        out[-1] = (*out[-1][:2], CLOSING[state])
    return out


def outcomes(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    found = kept(segments(rows, size), "segments")
    whole = found.where("whole").select("conv_id", *COUNTS, "low", "high", F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["audit"].alias("audit"))
    open_ = found.where(~F.col("whole"))
    costs = open_.select("conv_id", "part", "segment", F.transform("ways", lambda w: F.struct(w["entry"], w["leave"], w["cost"], w["place"])).alias("ways"))

    def choose(group):
        import pandas as pd

        group = group.sort_values(["part", "segment"])
        chosen = put_together([[tuple(map(int, w.values())) for w in ways] for ways in group["ways"]])
        return pd.DataFrame({"part": group["part"], "segment": group["segment"], "entry": [c[0] for c in chosen],
                             "leave": [c[1] for c in chosen], "closing": [c[2] for c in chosen]})

    chosen = costs.groupBy("conv_id").applyInPandas(choose, "part int, segment int, entry int, leave int, closing int")
    order = Window.partitionBy("conv_id").orderBy("part", "segment")
    joined = F.lag("tail").over(order)
    beside = open_.select("*", F.when(joined.isNotNull(), ~F.concat(joined, "head").isin("su", "ua", "au")).cast("long").alias("seam"),
                          F.lag("high").over(order).eqNullSafe(F.col("low")).alias("met"))
    way = F.filter("ways", lambda w: (w["entry"] == F.col("entry")) & (w["leave"] == F.col("leave")))[0]
    taken = beside.join(chosen, ["part", "segment"]).select(
        "conv_id", "part", "segment", "low", "high", "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("seam", F.lit(0))).alias("illegal"),
        (F.col("turns") - (F.col("met") & F.col("low").isNotNull()).cast("long")).alias("turns"),
        (way["cost"] + 2 * F.col("closing")).alias("cost"), F.concat(way["audit"], F.repeat(F.lit("I"), F.col("closing"))).alias("audit"))
    pieces = F.sort_array(F.collect_list(F.struct("part", "segment", "audit")))
    long = taken.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in (*COUNTS, "cost")], F.min("low").alias("low"), F.max("high").alias("high"),
                                        F.concat_ws("", F.transform(pieces, lambda p: p["audit"])).alias("audit"))
    return whole.unionByName(long).select(
        "conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
        *COUNTS[:-1], "cost", "audit")


def edits(rows):
    """Walk (conv_id, audit, role, text) in order, an audit (text None) before the rows of its conversation; yields (conv_id, letter, role, text).

    Letter "" stands for the start of a conversation; a deleted row has the letter D."""
    conv, audit, at, state = None, "", 0, START

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, NEXT[state]
            yield conv, "I", NAMES[state], ""

    for c, plan, role, text in rows:
        if plan is not None:
            yield from inserted()
            conv, audit, at, state = c, plan, 0, START
            yield conv, "", "", ""
            continue
        yield from inserted()
        letter = audit[at]
        at += 1
        if letter == "R":
            role = NAMES[NEXT[state]]
        if letter != "D":
            state = KINDS[role[:1]]
        yield conv, letter, role, text
    yield from inserted()


def _in_order(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows and audits, conversations together and each in order; the one shuffle of texts."""
    plain = _plain(rows).select("conv_id", F.lit(None).cast("string").alias("audit"), "role", "text", "turn", _digest().alias("digest"))
    heads = plans.select("conv_id", "audit", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"))
    both = plain.unionByName(heads).withColumn("row", F.col("audit").isNull())
    return (both.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "row", "turn", "role", "digest")
            .select("conv_id", "audit", "role", "text"))


def _walk(batches):
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(4)))


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, at (from 0), edit, role, text; `plans` has conv_id and audit, as `outcomes` gives them."""
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("at", T.LongType()), T.StructField("edit", T.StringType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def apply(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, out, size, at = to_arrow_schema(schema), [], 0, 0
        for conv, letter, role, text in edits(_walk(batches)):
            if letter in ("", "D"):
                at = at if letter else 0
                continue
            out.append({"conv_id": conv, "at": at, "edit": letter, "role": role, "text": text})
            at, size = at + 1, size + len(text)
            if len(out) >= 4096 or size >= 1 << 22:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _in_order(rows, plans).mapInArrow(apply, schema)


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of the repaired `role:text` lines of each conversation, hashed as they stream by."""
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("sha256", T.StringType())])

    def apply(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, out, state, begun = to_arrow_schema(schema), [], None, False
        conv = None
        for c, letter, role, text in edits(_walk(batches)):
            if letter == "":
                if state is not None:
                    out.append({"conv_id": conv, "sha256": state.hexdigest()})
                conv, state, begun = c, hashlib.sha256(), False
            elif letter != "D":
                state.update((("\n" if begun else "") + role + ":").encode())
                state.update(text.encode("utf-8"))
                begun = True
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if state is not None:
            out.append({"conv_id": conv, "sha256": state.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _in_order(rows, plans).mapInArrow(apply, schema)
