"""Document fingerprints: SimHash over words and adjacent word pairs, with damped weights.

The terms of a text are its words and its pairs of adjacent words. The hash of a term votes on every
bit of the fingerprint with a weight that grows with the number of its occurrences, but slowly: the number of bits of the
count (1 for once, 2 for two or three, 3 for four to seven, …). So a line that repeats a word many times does not outvote
the rest, and texts with the same terms in other counts differ. A bit is set where the votes for it exceed half of all.
Votes are whole numbers, summed in 32-bit lanes, two bits to a long, so texts of any length (up to 2^31 votes) are
counted exactly, and all that is kept of a text is one row.

`within_radius` finds all pairs of different fingerprints within a Hamming radius r, by permuted block tables: the
bits are cut into m blocks, and two fingerprints that differ in at most r bits agree in m - r blocks at least. There is a table
for each choice of m - r blocks, keyed by these blocks put first. More blocks make longer keys and more tables. Rows with equal
fingerprints are joined once.

Defined results: a null text counts as empty; a text without words has the fingerprint of zeros; equal texts have equal
fingerprints; repeated rows of one key are summed as one text, so keys are to be different; a bit with exactly half
of the votes is not set; an empty table gives an empty result; columns other than keys and text are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two hashes of 64 bits each.
SEEDS = (11, 29)
BITS = 64 * len(SEEDS)
HALVES = [f"f{s}" for s in range(len(SEEDS))]
#: Blocks that agree in any pair within the radius.
SPARE = 2
#: Lanes of 32 bits: the lowest bit of either half.
LANES = 0x0000000100000001


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def terms(words: Column) -> Column:
    """Hashes of the words and of the pairs of adjacent words, equal ones side by side."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return F.sort_array(F.array_compact(F.concat(F.transform(words, lambda w: F.xxhash64(w)), pairs)))


def voters(sorted_terms: Column) -> Column:
    """The first, second, fourth, eighth … occurrence of each term: as many as its count has bits.

    `sorted_terms` has to be a plain column, which is looked up at every element."""
    def votes(x: Column, i: Column) -> Column:
        def other(back: int) -> Column:
            return ~F.get(sorted_terms, i - back).eqNullSafe(x)

        out = F.when(other(1), True)
        for k in range(1, 31):
            out = out.when(other(2 ** k - 1), False).when(other(2 ** k), True) if k > 1 else out.when(other(2), True)
        return out.otherwise(False)

    return F.filter(sorted_terms, votes)


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per value of `keys` with the halves f0, f1 of the fingerprint of its text.

    All terms of a row are summed in the task that reads it; where the input is already partitioned
    by one of the keys nothing is shuffled, else one row per text."""
    # one step at a time, so that none is evaluated again inside the next
    worded = df.select(*keys, words_of(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    listed = worded.select(*keys, terms(F.col("words")).alias("terms"))
    term = listed.select(*keys, F.explode_outer(voters(F.col("terms"))).alias("t"))
    hashes = term.select(*keys, *[F.when(F.col("t").isNotNull(), F.xxhash64("t", F.lit(seed))).alias(f"h{s}") for s, seed in enumerate(SEEDS)])
    lanes = [F.sum(F.shiftrightunsigned(f"h{s}", i).bitwiseAND(F.lit(LANES))).alias(f"v{s}_{i}")
             for s in range(len(SEEDS)) for i in range(32)]
    votes = hashes.groupBy(*keys).agg(F.count("h0").alias("n"), *lanes)
    return votes.select(*keys, *[_bits(s).alias(HALVES[s]) for s in range(len(SEEDS))])


def _bits(s: int) -> Column:
    parts = []
    for i in range(32):
        lane = F.coalesce(F.col(f"v{s}_{i}"), F.lit(0))
        for bit, count in ((i, lane.bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(lane, 32))):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            parts.append(F.when(2 * count > F.col("n"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    while len(parts) > 1:  # a balanced tree keeps the expression shallow
        parts = [reduce(Column.bitwiseOR, parts[k:k + 2]) for k in range(0, len(parts), 2)]
    return parts[0]


def distance(a: list[Column], b: list[Column]) -> Column:
    return reduce(add, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)])


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - distance(a, b) / F.lit(float(BITS))


def as_text(halves: list[Column]) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


def near_counts(prints: DataFrame, radius: int) -> DataFrame:
    """f0, f1, n_near: for each different fingerprint, how many rows of others lie within the radius,
    its own copies but one included."""
    copies = prints.groupBy(*HALVES).agg(F.count("*").alias("copies"))
    pairs = within_radius(prints, radius)
    other = pairs.select("a0", "a1", "b0", "b1").unionByName(pairs.select(
        F.col("b0").alias("a0"), F.col("b1").alias("a1"), F.col("a0").alias("b0"), F.col("a1").alias("b1")))
    sums = (other.join(copies, (F.col("b0") == F.col("f0")) & (F.col("b1") == F.col("f1"))).groupBy("a0", "a1")
            .agg(F.sum("copies").alias("others")))
    return (copies.join(sums, (F.col("f0") == F.col("a0")) & (F.col("f1") == F.col("a1")), "left")
            .select(*HALVES, (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_near")))


def within_radius(prints: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """All pairs of different fingerprints at most `radius` bits apart.

    `prints` has the columns f0, f1; copies of a fingerprint are joined once. Of `blocks` (radius + SPARE if not given), all but
    `radius` make the key of a table. Returns a0, a1, b0, b1 (a below b) and `bits`, each pair once: from the table of the
    first blocks in which both agree."""
    blocks = blocks or radius + SPARE
    if not radius < blocks <= BITS:
        raise ValueError("there must be more blocks than bits may differ")
    distinct = prints.select(*HALVES).where(" and ".join(f"{h} is not null" for h in HALVES)).distinct()
    edges = [(k * BITS // blocks, (k + 1) * BITS // blocks) for k in range(blocks)]
    tables = list(combinations(range(blocks), blocks - radius))

    def block(halves: list[Column], low: int, high: int) -> list[Column]:
        pieces = []
        for s, half in enumerate(halves):
            a, b = max(low, 64 * s) - 64 * s, min(high, 64 * s + 64) - 64 * s
            if a < b:
                part = F.shiftrightunsigned(half, a)
                pieces.append(part if b - a == 64 else part.bitwiseAND(F.lit((1 << (b - a)) - 1)))
        return pieces

    own = [block([F.col(h) for h in HALVES], *e) for e in edges]
    table = distinct.select(*HALVES, F.posexplode(F.array(*[
        F.xxhash64(*[piece for k in chosen for piece in own[k]]) for chosen in tables])).alias("table", "key"))
    a, b = table.alias("a"), table.alias("b")
    left, right = [F.col(f"a.{h}") for h in HALVES], [F.col(f"b.{h}") for h in HALVES]
    same = [reduce(Column.__and__, [x == y for x, y in zip(block(left, *e), block(right, *e))]) for e in edges]
    agree = F.slice(F.array_compact(F.array(*[F.when(s, F.lit(k)) for k, s in enumerate(same)])), 1, blocks - radius)
    of_table = F.element_at(F.array(*[F.array(*map(F.lit, chosen)) for chosen in tables]), F.col("a.table") + 1)
    return (a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key"))
                   & (F.struct(*left) < F.struct(*right)) & (distance(left, right) <= radius))
            .where(agree == of_table)
            .select(*[c.alias(f"a{i}") for i, c in enumerate(left)], *[c.alias(f"b{i}") for i, c in enumerate(right)],
                    distance(left, right).alias("bits")))
