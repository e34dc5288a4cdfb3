"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word stems is learned first: terms that occur in clearly more toxic than other
training texts, by likelihood ratio. Then every text becomes DENSE numbers: lexicon densities, lexicon
terms near second-person words, shares of capitals, marks and digits, and rates of obfuscated words
(letters replaced by digits or signs; such words are looked up in their plain form). Trees are
boosted on these numbers, and an isotonic regression on training texts that the trees have not seen
turns their output into a score.

Training reads a bounded sample: at most SAMPLE texts of either class, in the order of a hash of the
identifier, with weights that restore the shares of the classes. Scoring is one pass over the texts.

Defined results: a null or empty text gets a score like any other; rows without a label or without
an identifier are scored, not learned from; with one class only, or no labels, every score is that
class's share (0 without labels). Equal texts get equal scores, repeated rows one score each; rows of the sample that
tie in the hash are taken in the order of their text; an empty table gives an empty result. Time is linear in a text's
length, also in runs of marks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import regex
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import cut, whole_text

SAMPLE, TREES, DEPTH = 4000, 20, 3
#: Of the sample, one row in so many calibrates.
CALIBRATE = 4
#: Least likelihood ratio and support of a lexicon term, and most terms.
LEAST_RATIO, LEAST_TEXTS, TERMS = 18.0, 8, 400
STEMS = (3, 4, 5, 6, 7)
#: Words from a second-person word to a lexicon term.
NEAR = 5
THRESHOLD = 0.7
#: Second-person words of the languages in the tables.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes vosotros tus".split())
#: Signs that stand for letters.
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
FIRST, LAST = regex.compile(r"[\p{L}\p{N}]"), regex.compile(r"(?r)[\p{L}\p{N}]")
FEATURES = ("hits", "share of hits", "different hits", "share of strongest", "hits near second person", "second person", "obfuscated hits",
            "obfuscated words", "capitals", "exclamation and question marks", "other marks", "digits", "words", "characters a word")
DENSE = len(FEATURES)
#: Characters of the words that a Python worker keeps, and of the longest of them.
KEPT_WORDS, LONG = 1_500_000, 60
_readers: dict[str, "Reader"] = {}


def _byte_classes() -> np.ndarray:
    """Class of each byte: 1 capital, 2 exclamation or question mark, 3 other mark, 4 digit."""
    kinds = np.zeros(256, dtype=np.uint8)
    for b in range(33, 127):
        c = chr(b)
        kinds[b] = 1 if c.isupper() else 2 if c in "!?" else 4 if c.isdigit() else 0 if c.isalpha() else 3
    return kinds


CLASSES = _byte_classes()


def inner(token: str) -> str:
    """The token from its first letter or digit to its last, found from either end."""
    first = FIRST.search(token)
    return token[first.start():LAST.search(token).end()] if first else ""


class Reader:
    """Features of texts, with a bounded table of the words seen."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.seen: dict[str, tuple[int, str]] = {}
        self.size = 0

    def term(self, word: str) -> str | None:
        if word in self.lexicon:
            return word
        return next((word[:k] + "+" for k in STEMS if len(word) > k and word[:k] + "+" in self.lexicon), None)

    def kind(self, token: str) -> tuple[int, str]:
        """0 plain, 1 second person, 2 lexicon, 3 obfuscated lexicon, 4 obfuscated; and the term."""
        word = inner(token)
        if word in SECOND_PERSON:
            return 1, ""
        if found := self.term(word):
            return 2, found
        if word.isalpha() or not any(map(str.isalpha, token)):
            return 0, ""
        plain = token.translate(PLAIN)
        for form in (inner(plain), inner(word.translate(PLAIN))):
            if found := self.term(form):
                return 3, found
        return (4, "") if any(map(str.isdigit, word)) or "*" in word or "@" in word else (0, "")

    def features(self, text: str) -> list[float]:
        tokens = text.lower().split()
        kinds = []
        for t in tokens:
            k = self.seen.get(t)
            if k is None:
                k = self.kind(t)
                if len(t) <= LONG:
                    if self.size >= KEPT_WORDS:
                        self.seen.clear()
                        self.size = 0
                    self.seen[t] = k
                    self.size += len(t)
            kinds.append(k)
        codes = np.fromiter((k for k, _ in kinds), np.int8, len(kinds))
        hits, people = np.flatnonzero((codes == 2) | (codes == 3)), np.flatnonzero(codes == 1)
        found = [kinds[i][1] for i in hits]
        close = 0
        if len(hits) and len(people):
            at = np.searchsorted(people, hits)
            before = hits - people[np.maximum(at - 1, 0)]
            after = people[np.minimum(at, len(people) - 1)] - hits
            close = int((((before >= 0) & (before <= NEAR)) | ((after >= 0) & (after <= NEAR))).sum())
        n, raw = max(1, len(tokens)), np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        marks = np.bincount(CLASSES[raw], minlength=5) / max(1, len(raw))
        best = max((self.lexicon[t] for t in found), default=0.0)
        return [float(len(hits)), len(hits) / n, float(len(set(found))), best, float(close), len(people) / n,
                float((codes == 3).sum()), float((codes >= 3).sum() / n), *map(float, marks[1:5]), float(np.log1p(len(tokens))), len(text) / n]


def _reader(name: str, lexicon: dict[str, float]) -> Reader:
    """One reader per Python worker and lexicon."""
    if name not in _readers:
        _readers.clear()
        _readers[name] = Reader(lexicon)
    return _readers[name]


def features(lexicon: dict[str, float]):
    """A vectorised function text -> array of DENSE numbers."""
    name = hashlib.sha256(repr(sorted(lexicon.items())).encode()).hexdigest()

    @F.pandas_udf("array<double>")
    def of(texts):
        import pandas as pd

        reader = _reader(name, lexicon)
        return pd.Series([reader.features(t) for t in texts.fillna("")])

    def apply(text: Column) -> Column:
        return of(whole_text(text))

    return apply


def _stems(words: Column, k: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("+")))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms of the toxic class with their likelihood ratio, at most TERMS; `sample` has text, label."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    stems = [_stems(F.col("words"), k) for k in STEMS]
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = float(sizes.get(1.0, 0)), float(sizes.get(0.0, 0))
    if not toxic or not other:
        return {}
    counted = (sample.select("label", words.alias("words"))
               .select("label", F.explode(F.array_distinct(F.concat("words", *stems))).alias("term"))
               .groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")))
    a, b, n = F.col("a"), F.col("b"), toxic + other
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    both = a + b
    ratio = 2 * (part(a, both * toxic / n) + part(b, both * other / n)
                 + part(toxic - a, (n - both) * toxic / n) + part(other - b, (n - both) * other / n))
    rows = (counted.where((a >= LEAST_TEXTS) & (a / toxic > 8 * (b + 0.5) / other)).withColumn("ratio", ratio)
            .where(F.col("ratio") >= LEAST_RATIO).orderBy(F.col("ratio").desc(), "term").limit(TERMS))
    return {r["term"]: r["ratio"] for r in rows.select("term", "ratio").collect()}


class Model:
    """What `fit` learned; `score` applies it to the rows of a DataFrame."""

    def __init__(self, lexicon, trees, curve, constant):
        self.lexicon, self.trees, self.curve, self.constant = lexicon, trees, curve, constant

    def score(self, df: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """`df` packed as column `row`, and the score, 0 to 1."""
        row = F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")
        if self.trees is None:
            return df.select(row, F.lit(float(self.constant)).alias(name))
        dense = df.select(row, array_to_vector(features(self.lexicon)(df[f"`{text_col}`"])).alias("dense"))
        raw = self.trees.transform(dense).withColumn("raw", vector_to_array("probability")[1])
        # the curve is a step function in places; a little of the raw score keeps the order
        return self.curve.transform(raw.select("row", "raw")).select(
            "row", (0.98 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("step"))) + 0.02 * F.col("raw")).alias(name))


def fit(documents: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> Model:
    """Learn from `documents` (id, text) and `labels` (id, label 0 or 1); rows without either are passed over."""
    known = labels.where(F.col("label").isin(0, 1) & F.col("id").isNotNull()).select(
        "id", F.xxhash64("id", F.lit(seed)).alias("draw"), F.col("label").cast("double").alias("label")).distinct()
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if len(sizes) < 2:
        return Model({}, None, None, max(sizes, default=0.0))
    drawn = [known.where(F.col("label") == y).orderBy("draw", "id").limit(sample) for y in sorted(sizes)]
    weight = F.when(F.col("label") == 1, max(1.0, sizes[1.0] / sample)).otherwise(max(1.0, sizes[0.0] / sample))
    # at most 2 * sample identifiers are broadcast
    rows = documents.select("id", whole_text(F.col("text")).alias("text")).join(F.broadcast(drawn[0].unionByName(drawn[1])), "id")
    rows = cut(rows.withColumn("weight", weight).repartition(16, "draw"))
    calibrating = F.pmod(F.xxhash64("draw"), F.lit(CALIBRATE)) == 0
    lexicon = learn_lexicon(rows.where(~calibrating))
    dense = cut(rows.select("label", "weight", calibrating.alias("calibrating"), array_to_vector(features(lexicon)(F.col("text"))).alias("dense"))).coalesce(4)
    learner = GBTClassifier(featuresCol="dense", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, cacheNodeIds=False)
    train = dense.where("not calibrating")
    if train.select("label").distinct().count() < 2:
        return Model(lexicon, None, None, sizes[1.0] / (sizes[0.0] + sizes[1.0]))
    model = learner.fit(train)
    held = model.transform(dense.where("calibrating")).select("label", "weight", vector_to_array("probability")[1].alias("raw"))
    if held.isEmpty():
        held = model.transform(train).select("label", "weight", vector_to_array("probability")[1].alias("raw"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="step").fit(held)
    return Model(lexicon, model, curve, None)
