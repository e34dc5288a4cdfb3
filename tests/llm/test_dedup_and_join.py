import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, clashing, documents, prose, shingle_set, similar

from epispark.llm import exact_dedup, fingerprints, jaccard
from epispark.llm.components import components


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(docs, keep):
    rows = documents()
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    pick = lambda ids: (min if keep == "min" else max)([i for i in ids if i is not None], default=None)
    got = exact_dedup.duplicates(docs, keep=keep).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["row"]["text"] or ""
        assert (r["keep_id"], r["group_size"]) == (pick(groups[text]), len(groups[text]))
        assert r["digest"] == hashlib.sha256(text.encode()).hexdigest()
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["id"] == r["keep_id"] for r in kept)


def test_exact_hot_text_is_cut_into_runs(spark):
    rows = [(k, "same" if k % 2 else f"text {k}", "en", "a") for k in range(400)]
    got = exact_dedup.duplicates(spark.createDataFrame(rows, SCHEMA)).where("kept").select("id").collect()
    assert sorted(r[0] for r in got) == [0, 1, *range(2, 400, 2)]


def test_exact_shuffles_the_text_once(docs):
    plan = exact_dedup.duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and plan.count("hashpartitioning(digest") == 1 and "SinglePartition" not in plan


def test_exact_keeps_columns_and_empty_tables(docs, none):
    own = clashing(docs)
    assert exact_dedup.deduplicate(own).columns == own.columns
    assert exact_dedup.deduplicate(none).count() == 0


def test_exact_normalises(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(r[0] for r in exact_dedup.deduplicate(df, normalise=F.lower).select("doc_id").collect()) == [1, 3]


def brute(rows):
    sets = [shingle_set(r[1]) for r in rows]
    links = [sum(similar(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j in range(i):
                if similar(a, sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for k, r in zip(label, rows):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return {(r[0], r[1]): (least.get(k, r[0]), n) for r, k, n in zip(rows, label, links)}


def test_join_equals_brute_force(docs):
    from pyspark.sql import functions as F

    rows = documents()
    want = brute(rows)
    marks = {(r[0], r[1]): r[2] for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    want = sorted(((key[0], marks[key], *want[key]) for key in [(r[0], r[1]) for r in rows]), key=str)
    got = sorted((tuple(r) for r in jaccard.classes(clashing(docs)).select("doc", "mark", "class_id", "n_links").collect()), key=str)
    assert got == want


def test_one_of_each(docs, none):
    own = clashing(docs)
    got = jaccard.one_of_each(own)
    assert got.columns == own.columns
    rows, want = got.collect(), brute(documents())
    ids = [r["doc_id"] for r in rows]
    classes = {c for key, (c, _) in want.items() if c is not None}
    assert sorted(i for i in ids if i is not None) == sorted(classes)
    assert [r["text"] for r in rows if r["doc_id"] is None] == ["only here without a number"]
    assert jaccard.one_of_each(none).count() == 0


def test_join_splits_large_buckets_and_groups(spark, monkeypatch):
    """Recursion, whole leaves and blocks give the same links as one cell."""
    rng = random.Random(4)
    base = prose(rng, 60).split()
    rows = []
    for k in range(90):
        words = list(base)
        for _ in range(k % 3):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(words), "en", "a"))
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "CELL_WORDS", 500)
    want = brute(rows)
    got = jaccard.classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc"], r["class_id"], r["n_links"]) for r in got} == {(k[0], *v) for k, v in want.items()}


def test_shingles_and_signatures():
    words = np.arange(1, 13, dtype=np.int64)
    s, n = jaccard.shingles(words, np.array([0, 7, 8, 12]))
    assert n.tolist() == [3, 1, 1] and len(set(s.tolist())) == 5
    again, _ = jaccard.shingles(words[:7], np.array([0, 7]))
    assert (again == s[:3]).all()
    sig = jaccard.signatures(s, n)
    assert sig.shape == (3, jaccard.COORDINATES) and (jaccard.signatures(again, np.array([3])) == sig[:1]).all()


def test_runs_reach_the_target():
    assert jaccard.runs_needed(target=0.999) > jaccard.runs_needed(target=0.9) >= 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (7, 7)] + [(100 + k, 101 + k) for k in range(30)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 11: 10, 12: 10} | {101 + k: 100 for k in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(spark, texts):
    """Votes counted one by one over the same term hashes, each weighted by the bits of its count."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    hashes = df.select("k", F.transform(fingerprints.terms(fingerprints.words_of(F.coalesce("text", F.lit("")))), lambda t: F.array(*[F.xxhash64(t, F.lit(s)) for s in fingerprints.SEEDS])).alias("h")).collect()
    out = {}
    for k, h in hashes:
        weights = {x: n.bit_length() for x, n in Counter(map(tuple, h)).items()}
        votes = [sum(((x[s] >> b) & 1) * n for x, n in weights.items()) for s in range(2) for b in range(64)]
        out[k] = tuple(sum((2 * votes[64 * s + b] > sum(weights.values())) << b for b in range(64)) for s in range(2))
    return out


def test_fingerprints_equal_plain_votes(spark):
    texts = ["", None, "one", "one two", "one two one two one two", "!!", "a " * 5000 + "b c", "x y " * 9, *[r[1] for r in documents(3, 20)]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = {r["k"]: tuple(r[h] % (1 << 64) for h in fingerprints.HALVES) for r in fingerprints.fingerprints(df, ["k"], "text").collect()}
    assert got == plain_fingerprint(spark, texts) and got[0] == (0, 0)
    assert fingerprints.fingerprints(df.limit(0), ["k"], "text").count() == 0


def test_counts_weigh_but_do_not_outvote(spark):
    """Same terms in other counts differ; one word a thousand times more does not turn the whole fingerprint."""
    base = documents(5, 30)[25][1] or "some words"
    words = " ".join(r[1] for r in documents(6, 40) if r[1] and len(r[1]) < 2000)
    texts = [words, words + (" " + words.split()[0]) * 1000, words + " " + base, words.split()[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r["k"]: (r["f0"] % (1 << 64)) << 64 | r["f1"] % (1 << 64) for r in fingerprints.fingerprints(df, ["k"], "text").collect()}
    assert 0 < (got[0] ^ got[1]).bit_count() < 20 < (got[0] ^ got[3]).bit_count()


@pytest.mark.parametrize(("radius", "blocks"), [(0, None), (3, None), (7, None), (3, 4), (3, 7), (12, 14)])
def test_radius_search_finds_all_pairs(spark, radius, blocks):
    rng = random.Random(radius)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = []
    for _ in range(12):
        a = [rng.getrandbits(64), rng.getrandbits(64)]
        for _ in range(6):
            b = list(a)
            for _ in range(rng.randint(0, 5)):
                b[rng.randrange(2)] ^= 1 << rng.randrange(64)
            prints.append(tuple(b))
    prints += prints[:3]
    df = spark.createDataFrame([tuple(map(signed, p)) for p in prints] + [(None, 1)], "f0 long, f1 long")
    got = [(r[0] % (1 << 64), r[1] % (1 << 64), r[2] % (1 << 64), r[3] % (1 << 64), r[4]) for r in fingerprints.within_radius(df, radius, blocks).collect()]
    want = set()
    for a in set(prints):
        for b in set(prints):
            bits = sum((x ^ y).bit_count() for x, y in zip(a, b))
            if tuple(map(signed, a)) < tuple(map(signed, b)) and bits <= radius:
                want.add((*a, *b, bits))
    assert len(got) == len(set(got)) and set(got) == want


def test_near_counts(spark):
    rng = random.Random(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(64) for _ in range(2)]
    prints = [(base[0] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)), base[1]) for _ in range(30)] + [tuple(base)] * 4 + [(5, 9)]
    df = spark.createDataFrame([tuple(map(signed, p)) for p in prints], "f0 long, f1 long")
    got = {(r["f0"] % (1 << 64), r["f1"] % (1 << 64)): r["n_near"] for r in fingerprints.near_counts(df, 3).collect()}
    near = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b)) <= 3
    assert got == {p: sum(near(p, q) for q in prints) - 1 for p in prints}
