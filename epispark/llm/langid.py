"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get one probability per language. A word (a run of letters in
lower case, with the word-start mark in front) has as probability the sum over all its segmentations
into pieces, computed by a forward pass; pieces never cross words, so a text is the product of its
words. Piece probabilities are fitted by expectation maximisation over the counted words of a bounded
sample: at most SAMPLE different texts a language, taken in the order of a hash. Every round runs as a Spark
job over (language, word, count); what it returns is one count per language and piece at most.

The forward pass of a word is kept in a bounded table per Python worker.

Defined results: a text that is null or has no letter is `und` with score 0; without any labelled
text every text is `und`; characters outside the vocabulary have one small probability each; ties go
to the language that sorts first; rows that repeat a text count once in the sample and get one prediction each; an
empty table gives an empty result. Words of any length are summed whole. The model holds one number per piece and
language, so languages by the thousand need memory for a table of that size.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.llm.common import cut, whole_text

SAMPLE, ROUNDS = 1500, 3
UNDETERMINED = "und"
START = "▁"
#: Probability of a character that no piece covers, and weight of a piece never seen.
UNKNOWN, PRIOR = 1e-9, 0.01
#: Words that a Python worker keeps, and their characters.
KEPT_WORDS, KEPT_CHARACTERS = 600_000, 6_000_000
#: Words that are looked up together, and length from which a word is summed on its own.
TOGETHER, LONG = 100_000, 40
#: Key of a piece in the trie.
PIECE = ""
LETTERS = regex.compile(r"\p{L}+")
_models: dict[str, "Scorer"] = {}


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model that consist of letters, with or without the word start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(k).lower() for k in range(model.get_piece_size())
              if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
    return sorted(p for p in pieces if p == START or LETTERS.fullmatch(p.removeprefix(START)))


class Scorer:
    """Forward (and backward) sums of words over piece probabilities of all languages at once."""

    def __init__(self, name: str, languages: list[str], pieces: list[str], chance: np.ndarray):
        self.name, self.languages = name, languages
        self.rows = {p: tuple(row) for p, row in zip(pieces, chance.tolist())}
        self.longest = max(map(len, pieces), default=1)
        self.prefixes = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        self.chance = np.vstack([np.asarray(chance, dtype=np.float64).reshape(len(pieces), len(languages)), np.full((1, len(languages)), UNKNOWN)])
        self.trie: dict = {}
        for k, p in enumerate(pieces):
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[PIECE] = k
        self.index: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(languages)))
        self.size = 0

    def arcs(self, word: str, begin: int = 0, stop: int | None = None):
        """(start, end, piece) for every piece that starts in the word, or between two places; single unknown characters as None."""
        for i in range(begin, len(word) if stop is None else stop):
            one = word[i]
            if one not in self.rows:
                yield i, i + 1, None
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                piece = word[i:j]
                if piece not in self.prefixes:
                    break
                if piece in self.rows:
                    yield i, j, piece

    def log_chance(self, word: str) -> list[float]:
        """Logarithm of the summed probability of all segmentations, per language."""
        n, zero = len(word), [0.0] * len(self.languages)
        sums = [None] * (n + 1)
        sums[0] = [1.0] * len(self.languages)
        unknown, rows, scale, floor = (UNKNOWN,) * len(self.languages), self.rows, 0.0, 0
        done = 0
        for i, j, piece in self.arcs(word):
            if i > done:  # all sums up to i are final: rescale them together when they get small
                done = i
                if i - floor >= 24:
                    top = max(sums[i] or zero)
                    if 0 < top < 1e-60:
                        for k in range(i, min(n, i + self.longest) + 1):
                            if sums[k]:
                                sums[k] = [x / top for x in sums[k]]
                        scale += math.log(top)
                    floor = i
            here = sums[i]
            if here is None:
                continue
            chance = unknown if piece is None else rows[piece]
            there = sums[j]
            sums[j] = [a * p for a, p in zip(here, chance)] if there is None else [t + a * p for t, a, p in zip(there, here, chance)]
        return [math.log(max(x, 1e-300)) + scale for x in (sums[n] or zero)]

    def expected(self, word: str, language: int) -> dict[str, float]:
        """Expected number of each piece in a segmentation of the word."""
        if len(word) > LONG:
            return self._expected_long(word, language)
        arcs = [(i, j, p, UNKNOWN if p is None else self.rows[p][language]) for i, j, p in self.arcs(word)]
        n = len(word)
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        ahead[0] = behind[n] = 1.0
        for i, j, _, c in arcs:
            ahead[j] += ahead[i] * c
        for i, j, _, c in reversed(arcs):
            behind[i] += c * behind[j]
        out: dict[str, float] = defaultdict(float)
        if ahead[n] > 0:
            for i, j, p, c in arcs:
                if p is not None:
                    out[p] += ahead[i] * c * behind[j] / ahead[n]
        return out

    def _expected_long(self, word: str, language: int, stretch: int = 4096) -> dict[str, float]:
        """The same in logarithms, which do not vanish; the way back holds the pieces of one stretch at a time."""
        n, lowest = len(word), -math.inf

        def add(a: float, b: float) -> float:
            if a < b:
                a, b = b, a
            return a if b == lowest else a + math.log1p(math.exp(b - a))

        def chance(piece: str | None) -> float:
            return math.log(max(UNKNOWN if piece is None else self.rows[piece][language], 1e-300))

        ahead, behind = array("d", [0.0]) + array("d", [lowest]) * n, array("d", [lowest]) * n + array("d", [0.0])
        for i, j, p in self.arcs(word):
            ahead[j] = add(ahead[j], ahead[i] + chance(p))
        out: dict[str, float] = defaultdict(float)
        for begin in range((n - 1) // stretch * stretch, -1, -stretch):
            for i, j, p in reversed(list(self.arcs(word, begin, min(n, begin + stretch)))):
                log = chance(p)
                behind[i] = add(behind[i], log + behind[j])
                if p is not None and (share := ahead[i] + log + behind[j] - ahead[n]) > -700:
                    out[p] += math.exp(share)
        return out

    def learn(self, words: list[str]) -> None:
        """Adds the logarithms of new words to the table, many words in one forward pass."""
        first = len(self.index)
        self.size += sum(map(len, words))
        self.index.update(zip(words, range(first, first + len(words))))
        while len(self.table) < first + len(words):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        short = [k for k, w in enumerate(words) if len(w) < LONG]
        for k in (k for k, w in enumerate(words) if len(w) >= LONG):
            self.table[first + k] = self.log_chance(START + words[k])
        if not short:
            return
        # arcs of all words; those with one end and one length belong to different words
        by_end: dict[tuple[int, int], tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        root, unknown = self.trie, len(self.rows)
        for row, k in enumerate(short):
            word = START + words[k]
            n = len(word)
            for i in range(n):
                node, alone = root, True
                for j in range(i, n):
                    node = node.get(word[j])
                    if node is None:
                        break
                    piece = node.get(PIECE)
                    if piece is not None:
                        alone = alone and j > i
                        at = by_end[j + 1, j + 1 - i]
                        at[0].append(row)
                        at[1].append(piece)
                if alone:
                    at = by_end[i + 1, 1]
                    at[0].append(row)
                    at[1].append(unknown)
        sums = np.zeros((LONG + 1, len(short), len(self.languages)))
        sums[0] = 1
        for (end, length), (rows, pieces) in sorted(by_end.items()):
            sums[end, rows] += sums[end - length, rows] * self.chance[pieces]
        ends = np.fromiter((len(words[k]) + 1 for k in short), np.int64, len(short))
        self.table[[first + k for k in short]] = np.log(np.maximum(sums[ends, np.arange(len(short))], 1e-300))

    def rows_of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def scores(self, texts) -> list[tuple[str, float]]:
        """(language, score) of each text; new words are learned for a stretch of texts at once."""
        out, waiting, held = [], [], 0
        for text in texts:
            words = LETTERS.findall(text.lower())
            waiting.append(words)
            held += len(words)
            if held >= TOGETHER:
                out += self._settle(waiting)
                waiting, held = [], 0
        return out + self._settle(waiting)

    def _settle(self, lists: list[list[str]]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(lists)
        out = []
        sums = [np.zeros(len(self.languages)) for _ in lists]
        # a very long text is taken in parts, so that the table stays bounded
        parts = [(k, words[at:at + TOGETHER]) for k, words in enumerate(lists) for at in range(0, len(words), TOGETHER)]
        while parts:
            now, size = [], 0
            while parts and (not now or size + len(parts[0][1]) <= 2 * TOGETHER):
                size += len(parts[0][1])
                now.append(parts.pop(0))
            new = list(set().union(*(words for _, words in now)).difference(self.index))
            if len(self.index) + len(new) > KEPT_WORDS or self.size > KEPT_CHARACTERS:
                self.index.clear()
                self.size = 0
                new = list(set().union(*(words for _, words in now)))
            self.learn(new)
            for k, words in now:
                sums[k] += self.table[self.rows_of(words)].sum(axis=0)
        for words, total in zip(lists, sums):
            if not words:
                out.append((UNDETERMINED, 0.0))
                continue
            # Words of a text depend on each other, so the evidence counts as that of sqrt(n) words.
            odds = np.exp((total - total.max()) / math.sqrt(len(words)))
            best = int(total.argmax())
            out.append((self.languages[best], float(odds[best] / odds.sum())))
        return out


def _scorer(name: str, languages: list[str], pieces: list[str], chance: np.ndarray) -> Scorer:
    """One scorer per Python worker and model; a new model replaces the one before."""
    if name not in _models:
        _models.clear()
        _models[name] = Scorer(name, languages, pieces, chance)
    return _models[name]


def drawn(labelled: DataFrame, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """lang, text: at most `sample` different texts a language, in the order of a hash.

    Copies count once, so a text with very many of them neither fills the sample nor one task."""
    rows = labelled.select(F.col(lang_col).alias("lang"), whole_text(F.col(text_col)).alias("text")).where("lang is not null")
    rows = rows.withColumn("draw", F.xxhash64("text", F.lit(7)))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()  # one row a language
    # about 1.3 times the sample by the hash alone, so that the window below ranks few rows; a lookup, since a join would
    # shuffle the texts, and one flat table, whatever the number of languages
    if not sizes:
        return rows.select("lang", "text")
    shares = F.create_map(*[F.lit(x) for lang, n in sizes for x in (str(lang), math.ceil(min(1.0, 1.3 * sample / max(1, n)) * 2**30))])
    share = F.element_at(shares, F.col("lang").cast("string"))
    near = rows.where(F.pmod("draw", F.lit(2**30)) < share).dropDuplicates(["lang", "draw"])
    return near.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("nth") <= sample).select("lang", "text")


def fit(labelled: DataFrame, text_col: str, lang_col: str, vocabulary_path: str, *, sample: int = SAMPLE, rounds: int = ROUNDS):
    """(languages, pieces, chance): piece probabilities per language from a bounded sample of texts."""
    kept = cut(drawn(labelled, text_col, lang_col, sample))
    words = cut(kept.select("lang", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")).alias("word"))
                .groupBy("lang", "word").agg(F.count("*").alias("n")))
    languages = sorted(r["lang"] for r in kept.select("lang").distinct().collect())
    pieces = vocabulary(vocabulary_path)
    chance = np.full((len(pieces), len(languages)), 1.0 / max(1, len(pieces)))
    place, column = {p: k for k, p in enumerate(pieces)}, {lang: k for k, lang in enumerate(languages)}
    for _ in range(rounds if languages else 0):
        seen = np.full_like(chance, PRIOR)
        for lang, piece, n in _expected_counts(words, languages, pieces, chance).collect():  # bounded by the vocabulary
            seen[place[piece], column[lang]] += n
        chance = seen / seen.sum(axis=0)
    return languages, pieces, chance


def _expected_counts(words: DataFrame, languages: list[str], pieces: list[str], chance: np.ndarray) -> DataFrame:
    def count(batches):
        scorer, sums = Scorer("fit", languages, pieces, chance), defaultdict(float)
        place = {lang: k for k, lang in enumerate(languages)}
        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                for piece, x in scorer.expected(START + word, place[lang]).items():
                    sums[lang, piece] += x * n
        yield pa.RecordBatch.from_pylist([{"lang": a, "piece": b, "n": x} for (a, b), x in sums.items()], schema=pa.schema(
            [("lang", pa.string()), ("piece", pa.string()), ("n", pa.float64())]))

    return words.mapInArrow(count, "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def predict(model):
    """A vectorised function text -> struct(lang, score)."""
    languages, pieces, chance = model
    chance = np.ascontiguousarray(chance, dtype=np.float32)
    name = f"{hash((tuple(languages), chance.tobytes()))}"

    @F.pandas_udf("lang string, score double")
    def of(texts):
        import pandas as pd

        scorer = _scorer(name, languages, pieces, chance)
        return pd.DataFrame(scorer.scores(texts.fillna("")), columns=["lang", "score"])

    def apply(text: Column) -> Column:
        return of(whole_text(text))

    return apply
