"""Small inputs and plain computations that the operators are held against."""

import random
import re

LANGS = {"en": "the of and to in that is for it as".split(), "fr": "le la les des du une dans pour pas sur".split()}


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    return " ".join(rng.choice(LANGS[lang]) if rng.random() < 0.3 else "".join(rng.choice("abdelmnorstu") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source) with copies, near copies, nulls, empty and short texts, a long one and repeated rows."""
    rng = random.Random(seed)
    rows = [(k, prose(rng, rng.choice([3, 8, 40, 120]), rng.choice(["en", "fr"])), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])) for k in range(n)]
    base = prose(rng, 100)
    for k in range(n, n + 8):
        words = base.split()
        words[rng.randrange(100)] = f"new{k}"
        rows.append((k, " ".join(words), "en", "a"))
    rows += [(n + 10 + k, base, "en", "a") for k in range(6)]
    rows += [(n + 20, None, None, None), (n + 21, "", "en", "b"), (n + 22, "!!! ???", "en", "b"), (n + 23, prose(rng, 30_000), "en", "b"), (n + 24, " \t\n", "en", "b")]
    rows += [rows[0], rows[0], (None, rows[1][1], "en", "a"), (None, "only here without a number", "en", None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that the operators use inside.
CLASHES = ["row", "id", "run", "head", "digest", "key", "bucket", "size", "words", "node", "score", "dense", "nth", "mark", "stay", "times", "shard", "kept"]


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def shingle_set(text: str | None) -> frozenset:
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a: frozenset, b: frozenset) -> bool:
    return bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
