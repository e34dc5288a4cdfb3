r"""Chat formatting: conversations rebuilt from their event log, then rendered with a loss mask.

Events have conv_id, seq, message, op, role, text. `message` numbers the messages of a conversation;
ops are folded in the order of seq:

    start       begins the message, or begins it anew, with its text
    delta       appends its text to the message
    edit        replaces the whole text
    regenerate  empties the message and removes all later messages, which answered the old text

The log is partitioned by conversation once; folding and rendering follow in the same partitions,
since a rendered conversation is one row in any case.

Template, one line per message: `### Role: text</turn>`. In roles and texts a backslash is put before
`\`, `#`, a `/` after `<` and, in roles, `:`, so neither the marker nor the end mark can occur inside a
text, and taking each such backslash away again restores it. Spans of the loss mask are (start, length) in code
points of the formatted string, one for each assistant message.

Defined results: a null text is empty; a null role is no role and reads back as empty; a null
message number sorts first; events of equal seq are taken in the order of op and text; an empty log
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK, END = "### ", "</turn>\n"
#: Roles written as words; any other role is written after an equals sign.
KNOWN = ("system", "user", "assistant")
LEARNED = "assistant"


def escape(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\#{more}]|(?<=<)/)", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, role, text."""
    e = events.select("conv_id", "seq", "message", "op", "role", F.coalesce("text", F.lit("")).alias("text"))
    own = Window.partitionBy("conv_id", "message")
    # of all messages before this one; null numbers come first
    before = Window.partitionBy("conv_id").orderBy(F.col("message").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, -1)
    when = lambda *ops: F.when(F.col("op").isin(*ops), F.col("seq"))
    live = (e.withColumn("cut", F.max(when("regenerate")).over(before))
            .withColumn("begun", F.max(when("start", "edit", "regenerate")).over(own))
            .where((F.col("cut").isNull() | (F.col("seq") > F.col("cut"))))
            .withColumn("counts", F.col("begun").isNull() | (F.col("seq") >= F.col("begun"))))
    # roles may come from any event of the message, texts from those that count
    step = F.struct("seq", F.when(F.col("op") == "delta", 1).otherwise(0).alias("later"), "text")
    steps = F.sort_array(F.collect_list(F.when(F.col("counts") & (F.col("op") != "regenerate"), step)))
    return live.groupBy("conv_id", "message").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.concat_ws("", F.transform(steps, lambda s: s["text"])).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, length, in code points from 0)."""
    label = (F.when(F.col("role").isNull(), F.lit("-")).when(F.col("role").isin(*KNOWN), F.initcap("role"))
             .otherwise(F.concat(F.lit("="), escape(F.col("role"), ":"))))
    parts = messages.select(
        "conv_id", "message", F.concat(F.lit(MARK), label, F.lit(": ")).alias("lead"),
        escape(F.col("text")).alias("body"), (F.col("role") == LEARNED).alias("learned"))
    line = F.struct("message", "lead", "body", F.coalesce("learned", F.lit(False)).alias("learned"),
                    F.length("lead").alias("skip"), F.length("body").alias("span"))
    lines = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def place(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["skip"]
        span = F.struct(begin.alias("start"), x["span"].alias("length"))
        return F.struct((begin + x["span"] + len(END)).alias("at"),
                        F.when(x["learned"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return lines.select(
        "conv_id",
        F.concat_ws("", F.transform("lines", lambda x: F.concat(x["lead"], x["body"], F.lit(END)))).alias("formatted"),
        F.aggregate("lines", start, place, lambda acc: acc["spans"]).alias("loss_spans"))


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))


def parse(formatted: Column) -> Column:
    """Messages read back from a formatted conversation: array of struct(role, text)."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")

    def message(piece: Column) -> Column:
        label = F.regexp_extract(piece, r"^### ((?:[^:\\]|\\.)*): ", 1)
        role = (F.when(label == "-", F.lit("")).when(label.startswith("="), unescape(F.substring(label, 2, 1 << 30)))
                .otherwise(F.lower(label)))
        text = piece.substr(F.length(label) + len(MARK) + 3, F.length(piece))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, message)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, without anything between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["length"]))))


def events_of(rows: DataFrame, chunk: int = 256) -> DataFrame:
    """An event log of finished rows (conv_id, turn, role, text): assistant texts as streamed deltas.

    Rows of a conversation are numbered by turn, then role and text, so repeated turns stay apart."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    text = F.coalesce("text", F.lit(""))
    numbered = rows.select("conv_id", "role", text.alias("text"), F.row_number().over(order).alias("message"))
    streamed = F.coalesce(F.col("role") == LEARNED, F.lit(False))
    deltas = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / chunk).cast("int")),
                         lambda k: F.struct((k + 1).alias("step"), F.lit("delta").alias("op"), F.col("text").substr(k * chunk + 1, F.lit(chunk)).alias("text")))
    first = F.struct(F.lit(0).alias("step"), F.lit("start").alias("op"), F.when(streamed, F.lit("")).otherwise(F.col("text")).alias("text"))
    steps = numbered.select("conv_id", "message", "role", F.explode(
        F.concat(F.array(first), F.when(streamed, deltas).otherwise(F.array().cast("array<struct<step:int,op:string,text:string>>")))).alias("e"))
    return steps.select("conv_id", "message", "role", "e.op", "e.text",
                        (F.col("message").cast("long") * (1 << 32) + F.col("e.step")).alias("seq"))
