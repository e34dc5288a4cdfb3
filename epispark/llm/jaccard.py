"""N-gram Jaccard join by chosen paths.

Texts become sets of five-word shingles, words being runs of letters and digits in lower case. Texts
with the same words are one node. A node is embedded as a signature of COORDINATES minimum hashes.
In each of several runs, a path starts from the root; at every vertex each coordinate is sampled with
chance 1 / (threshold * COORDINATES) by a hash of the path, and the nodes of the vertex are split by
their value there: the tokens that similar sets share. Buckets of up to BUCKET nodes are compared by
brute force, larger ones are split again, at most DEPTH times; one that is still larger is taken as a
whole. Runs are repeated until a pair at the threshold is met with chance TARGET.

What the buckets yield are candidate groups, found as components of (node, group) links. In each
group all sets are then compared exactly, in one cell, or in pairs of blocks if the group is large;
cells have a bounded number of words. A cell returns per node its links and the smallest node it is
connected to, never pairs, so the output is linear in the documents however many copies there are.
The exact comparison of a group of g different texts takes g^2 set comparisons, spread over
(g / BLOCK)^2 / 2 tasks: the links are counted, none is dropped.

Defined results: texts with one to four words have one shingle of all their words; a text without
words (null, empty, signs only) is a class of its own without links; copies are linked; rows without
an identifier take part and have the class of the others, null if no member has an identifier.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.llm.common import cut, packed, unpacked, whole_text
from epispark.llm.components import components

WORDS, THRESHOLD = 5, 0.8
COORDINATES, TARGET, DEPTH, BUCKET = 64, 0.999, 3, 1024
#: Signatures may fall short of the threshold by so much before a pair is not compared exactly:
#: 3.6 standard deviations at 64 coordinates.
SLACK = 0.18
#: Nodes and words of a block, and rows that one Python call handles together.
BLOCK, BLOCK_WORDS, TOGETHER = 1024, 1_000_000, 20_000
#: Words that one Python call compares, on average.
CELL_WORDS = 500_000
#: Words that are hashed together in a Python worker, more only in one text.
STRETCH = 250_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: Column) -> Column:
    """64-bit hashes of the words."""
    return F.transform(F.filter(F.split(F.lower(whole_text(text)), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def runs_needed(threshold: float = THRESHOLD, target: float = TARGET, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met in a bucket with chance `target`.

    A run meets the pair below a vertex of depth d with chance p(d) = 1 - exp(-p(d - 1)), p(0) = 1:
    the number of shared children is about Poisson with mean 1."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - target) / math.log(1 - p))


def shingles(values: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of many word lists, and the number of each list; repeated shingles stay."""
    h = values.view(np.uint64)
    sizes = np.diff(offsets)
    n = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    begin = np.repeat(offsets[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length = np.repeat(np.minimum(sizes, words), n)
    s = np.zeros(len(begin), dtype=np.uint64)
    for k in range(words):
        inside = length > k
        s = np.where(inside, s * MIX + h[np.minimum(begin + k, len(h) - 1)], s) if len(h) else s
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(29)
    return s, n


def signatures(s: np.ndarray, n: np.ndarray, seed: int = 5) -> np.ndarray:
    """Minimum hashes, one row a set; every set has a shingle."""
    rng = np.random.default_rng(seed)
    masks = rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)
    odds = rng.integers(0, 2**32, COORDINATES, dtype=np.uint32) | np.uint32(1)
    out = np.empty((len(n), COORDINATES), dtype=np.uint32)
    ends = np.cumsum(n)
    short = (s >> np.uint64(32)).astype(np.uint32)
    at = 0
    while at < len(n):  # in stretches that stay in the processor's cache
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 100_000, side="right")))
        low = ends[at - 1] if at else 0
        part, starts = short[low:ends[upto - 1]], ends[at:upto] - n[at:upto] - low
        for c in range(COORDINATES):
            out[at:upto, c] = np.minimum.reduceat((part ^ masks[c]) * odds[c], starts)
        at = upto
    return out


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _sign(batches):
    for batch in batches:
        values, offsets = _lists(batch.column("words"))
        parts, at = [np.empty((0, COORDINATES), dtype=np.uint32)], 0
        while at < len(offsets) - 1:  # in stretches of bounded memory
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH, side="right")) - 1)
            parts.append(signatures(*shingles(values[offsets[at]:offsets[upto]], offsets[at:upto + 1] - offsets[at])))
            at = upto
        sig = np.concatenate(parts)
        flat = pa.array(sig.ravel().view(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * COORDINATES), flat)
        names = ["id", "doc", "mark", "node", "size"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), lists], names=[*names, "sig"])


def _labels(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of 0..m-1 is connected to by the links i-j."""
    label = np.arange(m)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def _compare(table: pa.Table, least: int) -> pa.Table:
    """Brute force over the buckets of one group of rows: node -> another node of its candidate group."""
    table = table.sort_by("path")
    path, node = table["path"].to_numpy(), table["node"].to_numpy()
    sig = _lists(table["sig"])[0].reshape(-1, COORDINATES)
    starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    sizes = np.diff(np.r_[starts, len(path)])
    left, right = [], []
    for m in np.unique(sizes[sizes > 1]):
        rows = starts[sizes == m][:, None] + np.arange(m)
        step = max(1, TOGETHER // int(m))
        for k in range(0, len(rows), step):
            part = rows[k:k + step]
            for d in range(1, m):
                a, b = part[:, :-d].ravel(), part[:, d:].ravel()
                alike = (sig[a] == sig[b]).sum(axis=1) >= least
                left.append(a[alike])
                right.append(b[alike])
    none = np.empty(0, dtype=np.int64)
    label = _labels(len(node), np.concatenate(left or [none]), np.concatenate(right or [none]))
    linked = node[label] != node
    return pa.table({"a": node[linked], "b": node[label][linked]})


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of bounded slices of the incidence matrix."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    _, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[token] > 1
    row, token = row[shared], token[shared]
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    out, width = np.zeros((m, m), dtype=np.float32), max(1, 4_000_000 // m)
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [low, low + width])
        part = np.zeros((m, min(width, int(token[b - 1]) - low + 1)), dtype=np.float32)
        part[row[a:b], token[a:b] - low] = 1
        out += part @ part.T
    return out


def _verify(table: pa.Table, threshold: float) -> pa.Table:
    """Exact comparison in each cell of one group of rows."""
    cell = np.stack([table[c].to_numpy() for c in ("group", "i", "j")], axis=1)
    values, offsets = _lists(table["words"])
    node, block, copies = (table[c].to_numpy() for c in ("node", "block", "copies"))
    order = np.lexsort((node, cell[:, 2], cell[:, 1], cell[:, 0]))
    out: list[list] = [[], [], []]
    begin = 0
    while begin < len(order):
        end = begin
        while end < len(order) and (cell[order[end]] == cell[order[begin]]).all():
            end += 1
        rows = order[begin:end]
        rows = rows[np.r_[True, node[rows][1:] != node[rows][:-1]]]  # a repeated identifier gives rows twice
        begin = end
        if len(rows) < 2:
            continue
        sets = []
        for r in rows:
            sets.append(np.unique(shingles(values[offsets[r]:offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]))[0]))
        size = np.array([len(x) for x in sets], dtype=np.float64)
        common = _common(sets).astype(np.float64)
        linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if cell[rows[0], 1] != cell[rows[0], 2]:
            linked &= block[rows][:, None] != block[rows][None, :]
        label = _labels(len(rows), *np.nonzero(linked))
        out[0].append(node[rows])
        out[1].append(node[rows][label])
        out[2].append(linked @ copies[rows])
    none = [np.empty(0, dtype=np.int64)]
    return pa.table(dict(zip(("node", "root", "links"), [np.concatenate(x or none).astype(np.int64) for x in out])))


def _paths(nodes: DataFrame, threshold: float, runs: int, seed: int) -> DataFrame:
    """Children of the roots of all runs."""
    rng = random.Random(seed)
    chosen = [(r, c) for r in range(runs) for c in range(COORDINATES) if rng.random() < 1 / (threshold * COORDINATES)]
    children = F.array(*[F.xxhash64(F.lit(r), F.lit(c), F.col("sig")[c]) for r, c in chosen])
    return nodes.select("node", F.explode(children).alias("path"))


def _split(large: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Children of vertices below the root, which sample their coordinates by a hash of the path."""
    share = round(2**20 / (threshold * COORDINATES))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda c: F.pmod(F.xxhash64("path", c), F.lit(2**20)) < share)
    children = F.transform(chosen, lambda c: F.xxhash64("path", c, F.element_at("sig", c + 1)))
    return large.select("path", "node").join(nodes.select("node", "sig"), "node").select("node", F.explode(children).alias("path"))


def _shared(paths: DataFrame) -> DataFrame:
    """Rows of paths that at least two nodes have, with their number."""
    sizes = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    return cut(paths.join(sizes, "path"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD,
            target: float = TARGET, seed: int = 3) -> DataFrame:
    """doc (identifier), mark (hash of the text), class_id, n_links, first; one row per input row.

    Identifiers are whole numbers or text that reads as one (other text fails the cast); null ones are allowed.

    Classes are the components of the links (similarity at or above the threshold); class_id is the
    smallest identifier of the class, n_links the number of other rows that the row is linked to.
    `first` says whether the row has that identifier, or without any the smallest hash."""
    texts = df.select(df[id_col].cast("long").alias("doc"), whole_text(df[text_col]).alias("text"))
    worded = (texts.select(F.coalesce("doc", F.xxhash64("text")).alias("id"), "doc", F.xxhash64("text").alias("mark"), words_of(F.col("text")).alias("words"))
              .withColumn("node", F.when(F.size("words") > 0, F.xxhash64("words"))).withColumn("size", F.size("words")))
    signed = cut(worded.where("node is not null").select("id", "doc", "mark", "node", "size", "words").mapInArrow(
        _sign, "id long, doc long, mark long, node long, size int, sig array<int>"))
    nodes = cut(signed.groupBy("node").agg(F.min("id").alias("id"), F.min("doc").alias("doc"), F.count("*").alias("copies"),
                                           F.max("size").alias("size"), F.any_value("sig").alias("sig")))

    shared = _shared(_paths(nodes, threshold, runs_needed(threshold, target), seed))
    leaves, whole = shared.where(F.col("n") <= BUCKET), shared.where(F.col("n") > BUCKET)
    for _ in range(DEPTH - 1):
        if whole.isEmpty():
            break
        shared = _shared(_split(whole, nodes, threshold))
        leaves, whole = leaves.unionByName(shared.where(F.col("n") <= BUCKET)), shared.where(F.col("n") > BUCKET)

    bins = max(1, leaves.count() // TOGETHER)
    least = math.floor((threshold - SLACK) * COORDINATES)
    compared = (leaves.select("path", "node").join(nodes.select("node", "sig"), "node")
                .groupBy(F.pmod(F.xxhash64("path"), F.lit(bins)).alias("bin"))
                .applyInArrow(lambda rows: _compare(rows, least), "a long, b long"))
    whole = whole.join(whole.groupBy("path").agg(F.min("node").alias("b")), "path").select(F.col("node").alias("a"), "b").where("a <> b")
    found = components(compared.unionByName(whole))

    group = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "group")
    members = cut(group.join(nodes.drop("sig"), "node"))
    blocks = members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_WORDS)).alias("blocks"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    blocked = members.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    cells = (blocked.select("node", "group", "copies", "block", F.explode(others).alias("cell")).select("*", "cell.*").drop("cell"))
    candidates = members.select("node", "id")
    # the texts of candidate nodes; a row with a repeated identifier must have the words of the node
    sets = (worded.where("node is not null").select("id", "node", "words").join(candidates, ["id", "node"]).select("node", "words"))
    # a node is in as many cells as its group has blocks; the words of all cells are spread over the bins
    bins = (blocked.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0) // CELL_WORDS + 1
    verified = cut(cells.join(sets, "node").select("node", "group", "i", "j", "block", "copies", "words")
                   .groupBy(F.pmod(F.xxhash64("group", "i", "j"), F.lit(bins)).alias("bin"))
                   .applyInArrow(lambda rows: _verify(rows, threshold), "node long, root long, links long"))
    roots = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    named = (nodes.select("node", "id", "doc", "copies").join(roots, "node", "left").join(links, "node", "left")
             .select("node", "id", "doc", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    first = named.groupBy("root").agg(F.min("doc").alias("class_id"), F.min("id").alias("least"))
    result = named.join(first, "root").select("node", "class_id", "least", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    stays = F.when(F.col("class_id").isNull(), F.col("id") == F.col("least")).otherwise(F.col("doc").eqNullSafe(F.col("class_id")))
    linked = signed.select("id", "doc", "mark", "node").join(result, "node").select("doc", "mark", "class_id", "n_links", stays.alias("first"))
    alone = worded.where("node is null").select("doc", "mark", F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return linked.unionByName(alone)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, that of the smallest identifier, with the columns of the input.

    Rows that repeat both identifier and text count as one."""
    stays = classes(df, id_col, text_col, **options).where("first").select(
        F.col("doc").alias("stay"), F.col("mark").alias("stay_mark")).distinct()
    rows = packed(df, id=df[id_col].cast("long"), mark=F.xxhash64(whole_text(df[text_col])))
    same = Window.partitionBy("mark", "id").orderBy("id")
    return unpacked(rows.join(stays, (F.col("mark") == F.col("stay_mark")) & F.col("id").eqNullSafe(F.col("stay")), "left_semi")
                    .withColumn("nth", F.row_number().over(same)).where("nth = 1"))
