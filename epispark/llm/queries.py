"""The operators bound to the given tables. Each query derives its result from an operator of this folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epispark.llm import bpe, chat, exact_dedup, fingerprints, jaccard, langid, mixing, packing, pii, prefix_trie, repair, tokens, toxicity
from epispark.llm.common import cut, held_out, kept, shuffle_partitions, table, whole_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Hamming radius of near fingerprints.
RADIUS = 3
#: Key of the pseudonyms in the registered query; a user passes a secret one.
SAMPLE_KEY = b"registered query"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@register("op1_ngram_jaccard")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(table(spark, folder, "documents")).select(F.col("doc").alias("doc_id"), "class_id", "n_links")


@register("op2_mixing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@register("op3_chat_formatting")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("m"))
    rows = rows.unionByName(extra.select("conv_id", F.col("m.turn").cast(rows.schema["turn"].dataType).alias("turn"), "m.role", F.lit(said).alias("text")))
    done = chat.format_chats(chat.events_of(rows)).withColumn("back", chat.parse(F.col("formatted"))).withColumn(
        "learned", chat.learned_text(F.col("formatted"), F.col("loss_spans")))
    turns = F.concat_ws("", F.transform("back", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))))
    return done.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op3_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
lines AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') AS body FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + length(role) + 14) AS BIGINT) AS formatted_chars
FROM lines GROUP BY conv_id"""


def _bucket(key: Column, splitters: list[int]) -> Column:
    """Number of splitters up to the key, by binary search."""
    if not splitters:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(splitters).bit_length()))]
    known = F.array(*[F.lit(s).cast("long") for s in splitters], *[F.lit(None).cast("long")] * (2 * steps[0] - len(splitters)))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.element_at(known, at + step) <= key, at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, nth, look, doc_id, text, next: each text beside that of the next doc_id, after the last the first.

    Rows are dealt to ranges of doc_id. The first row of a range is also sent to the range before, as a
    row to look at only (look > 0), so every lead is found within one range and texts are shuffled once."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text"), key.alias("key"))
    n = 8 * shuffle_partitions(docs.sparkSession)
    found = rows.agg(F.min("key"), F.percentile_approx("key", [k / n for k in range(1, n)], 4 * n)).first()  # one row of 8 longs a partition
    splitters = sorted({s for s in found[1] or [] if s > found[0]})
    at, last = _bucket(F.col("key"), splitters), len(splitters)
    firsts = F.lit(False) if not splitters else F.col("key").isin(splitters)
    rows = rows.withColumn("bucket", at)
    copies = F.filter(F.array(
        F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("look")),
        F.when(firsts, F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("look"))),
        F.when(F.col("key") == F.lit(found[0]), F.struct(F.lit(last).alias("bucket"), F.lit(2).alias("look")))), lambda c: c.isNotNull())
    dealt = rows.select("doc_id", "text", "key", F.explode(copies).alias("copy")).select("doc_id", "text", "key", "copy.*")
    order = Window.partitionBy("bucket").orderBy("look", "key", F.xxhash64("text"))
    return dealt.select("bucket", F.row_number().over(order).alias("nth"), "look", "doc_id", "text", F.lead("text").over(order).alias("next"))


@register("op4_fingerprints")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    beside = with_next(table(spark, folder, "documents"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next", F.lit(1), quarter))
    rows = beside.select("bucket", "nth", "look", "doc_id", "text", F.when(F.col("look") == 0, edited).alias("edited"))
    both = rows.select("bucket", "nth", "look", "doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("t"))
    keys = ["bucket", "nth", "look", "doc_id"]
    prints = fingerprints.fingerprints(both.select(*keys, "t.*").where("text is not null"), [*keys, "which"], "text")
    halves = fingerprints.HALVES
    wide = prints.groupBy(*keys).agg(*[F.max(F.when(F.col("which") == w, F.col(h))).alias(f"{h}_{w}") for w in (0, 1) for h in halves])
    order = Window.partitionBy("bucket").orderBy("nth")
    own, changed = [F.col(f"{h}_0") for h in halves], [F.col(f"{h}_1") for h in halves]
    wide = wide.select(*keys, *[c.alias(h) for c, h in zip(own, halves)], fingerprints.as_text(own).alias("fingerprint"), fingerprints.as_text(changed).alias("edited_fingerprint"),
                       fingerprints.likeness(own, changed).alias("near_edited"),
                       fingerprints.likeness(own, [F.lead(c).over(order) for c in own]).alias("near_next")).where("look = 0")
    meta = rows.where("look = 0").select("bucket", "nth", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    done = cut(meta.join(wide.drop("doc_id", "look"), ["bucket", "nth"]).drop("bucket", "nth"))
    return (done.join(fingerprints.near_counts(done, RADIUS), halves)
            .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near"))


@register("op5_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), mixing.word_count(F.col("text")).alias("size"), "source", F.hex(F.xxhash64(whole_text(F.col("text")))).alias("cluster"))
    return packing.pack(rows).withColumnRenamed("id", "doc_id")


@register("op6_pii")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", pii.pseudonymise(SAMPLE_KEY)(F.col("text")).alias("p"))

    def found(kind: str) -> Column:
        return F.size(F.filter("p.spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return docs.select("doc_id", "p.text", F.size("p.spans").cast("long").alias("n_values"), *map(found, pii.KINDS))


@register("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs, out = table(spark, folder, "documents").select("doc_id", "text"), held_out(F.col("doc_id"), 3, 1)
    labels = table(spark, folder, "labels").where(~out).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    model = toxicity.fit(docs.select(F.col("doc_id").alias("id"), "text"), labels)
    return model.score(docs).select("row.doc_id", held_out(F.col("row.doc_id"), 3, 1).alias("held_out"), "score",
                                    (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@register("op8_exact_dedup", """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup.duplicates(docs, keep="max").select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@register("op9_token_counts")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    count = tokens.token_count(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, folder, "documents").select("doc_id", F.octet_length(whole_text(F.col("text"))).cast("long").alias("n_bytes"), count(F.col("text")).alias("n_tokens"))
    return docs.withColumn("over_limit", F.col("n_tokens") > 1024)


@register("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs, out = table(spark, folder, "documents").select("doc_id", "text", "lang"), held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.where(~out), "text", "lang", public_tokenizers.path("piece_bpe_32k.model"))
    return docs.select("doc_id", out.alias("held_out"), langid.predict(model)(F.col("text")).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def _spoken(column: Column) -> Column:
    """A value as text, null as one space."""
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations with about one row in twenty dropped, emptied, cut, repeated or given the role user, each by its number."""
    case = F.crc32(F.concat(_spoken(F.col("conv_id")), F.lit(":"), _spoken(F.col("turn"))).cast("binary")) % 20
    text = (F.when(F.col("case") == 1, F.lit("")).when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    return (rows.select("conv_id", "turn", _spoken(F.col("role")).alias("role"), _spoken(F.col("text")).alias("text"), case.alias("case"))
            .where("case <> 0")
            .select("conv_id", "turn", F.when(F.col("case") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(F.col("case") == 3, 2).otherwise(1))).alias("copy")).drop("copy"))


@register("op11_conversation_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    broken = damaged(rows)
    found = kept(repair.outcomes(broken), "outcomes")
    done = found.join(repair.digests(broken, found).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    every = rows.select(F.col("conv_id").alias("c")).distinct()
    zeros = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(done, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("c").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zeros], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    byte = "list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda crc, b: {byte}), 4294967295)"


def _repair_sql() -> str:
    """All ways row by row: f0 to f3 are the least cost and audit, as one text, by the last role."""
    def more(f: str, cost: str, letter: str) -> str:
        return f"lpad(CAST(CAST(left({f}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({f}, 10) || '{letter}'"

    unless = lambda when, what: f"CASE WHEN {when} THEN {what} END"
    free = "least(g0, g1, g3)"
    return rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS c FROM conversations),
broken AS (
  SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
         CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, (VALUES (0), (1)) AS copies(copy) WHERE c <> 0 AND (copy = 0 OR c = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM broken),
faults AS (
  SELECT *, CASE WHEN said = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS kind FROM placed),
marked AS (
  SELECT conv_id, i, turn, role, text, fault, kind, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS worn,
         lag(kind) OVER (PARTITION BY conv_id ORDER BY i) || kind AS pair FROM faults),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY conv_id),
walk(conv_id, i, f0, f1, f2, f3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM counted
  UNION ALL
  SELECT conv_id, i, {more('g0', '3', 'D')},
         least({more('g1', '3', 'D')}, {unless("NOT gone AND kind = 's'", more('g0', 'worn', 'K'))}),
         least({more('g2', '3', 'D')}, {unless("NOT gone AND kind = 'u'", more(free, 'worn', 'K'))}, {unless('NOT gone', more(free, '2 + worn', 'R'))}),
         least({more('g3', '3', 'D')}, {unless("NOT gone AND kind = 'a'", more('g2', 'worn', 'K'))}, {unless('NOT gone', more('g2', '2 + worn', 'R'))})
  FROM (SELECT *, least(f3, {more('g2', '2', 'I')}) AS g3 FROM (
          SELECT m.conv_id, m.i, gone, kind, worn, f3, f0 AS g0, f1 AS g1,
                 least(f2, {more('f0', '2', 'I')}, {more('f1', '2', 'I')}, {more('f3', '2', 'I')}) AS g2
          FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1) a) b),
done AS (
  SELECT c.*, least(f0, f3, {more('f2', '2', 'I')}, {more('(' + more('f1', '2', 'I') + ')', '2', 'I')}) AS best
  FROM counted c JOIN walk w ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i),
letters AS (
  SELECT conv_id, k, substr(best, 9 + k, 1) AS letter FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS k FROM done) x),
steps AS (
  SELECT *, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS i,
         sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS nth FROM letters),
turns AS (
  SELECT s.conv_id, k, nth, letter, CASE WHEN letter = 'I' THEN '' ELSE m.text END AS text, CASE WHEN letter = 'K' THEN m.role END AS own
  FROM steps s LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.i = s.i WHERE letter <> 'D'),
named AS (
  SELECT *, bool_or(nth = 1 AND left(own, 1) = 's') OVER (PARTITION BY conv_id) AS led FROM turns),
digests AS (
  SELECT conv_id, sha256(string_agg(coalesce(own, CASE WHEN (nth % 2 = 1) = coalesce(led, false) THEN 'assistant' ELSE 'user' END) || ':' || text, chr(10) ORDER BY k)) AS d
  FROM named GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(left(best, 9), '0') AS BIGINT) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(d, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN done ON e.conv_id IS NOT DISTINCT FROM done.conv_id
LEFT JOIN digests ON e.conv_id IS NOT DISTINCT FROM digests.conv_id"""


ORACLES["op11_conversation_repair"] = _repair_sql()


@register("op12_bpe")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = table(spark, folder, "documents").select("doc_id", bpe.encode(path)(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(bpe.decode(path)("ids"), 256).alias("decoded_sha256"))


@register("op13_prefix_trie", rf"""
WITH placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS leader, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM conversations) x),
turns AS (
  SELECT c.conv_id, 0 AS own, i, role, text FROM convs c JOIN placed p ON p.conv_id = c.leader AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, role, text FROM convs c JOIN placed p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND i > coalesce(h, 0)),
rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth, sha256(length(role) || ':' || role || text) AS said,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turns),
paths AS (
  SELECT conv_id, depth, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node, words,
         depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs),
nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ending FROM paths GROUP BY depth, node),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id, p.node AS above FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = left(n.node, length(n.node) - 64)),
children AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT p.depth, p.node, count(*) FILTER (c.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node GROUP BY p.depth, p.node)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ending) AS ends_sha256
FROM linked JOIN sums USING (depth, node) LEFT JOIN children USING (depth, node)""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    conv = F.col("conv_id")
    chains = prefix_trie.chained(prefix_trie.turns(rows))
    return prefix_trie.trie(prefix_trie.rebuilt(chains, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3))
