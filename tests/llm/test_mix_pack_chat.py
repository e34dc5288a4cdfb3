import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import SCHEMA, clashing, documents
from pyspark.sql import functions as F

from epispark.llm import chat, mixing, packing


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shared_targets(words, weights, share, cap):
    """Share by weight; cap; share what is too much again, until nothing is."""
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free = dict.fromkeys(order, 0.0), set(order)
    left = share * sum(words.values())
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        add, left = {s: left * weight[s] / total for s in free}, 0.0
        for s, x in add.items():
            target[s] += x
            if target[s] > cap * words[s]:
                left += target[s] - cap * words[s]
                target[s] = cap * words[s]
                free.discard(s)
    return target


def test_mix_reaches_targets(docs):
    rows = documents()
    got = mixing.mix(clashing(docs)).collect()
    assert len(got) == len(rows)
    words = defaultdict(int)
    for r in rows:
        words[r[3]] += count(r[1])
    target = shared_targets(words, (3, 1, 2), 1.5, 2.0)
    taken = defaultdict(int)
    for r in got:
        source = r["row"]["source"]
        assert r["size"] == count(r["row"]["text"]) and r["source_size"] == words[source]
        assert r["target"] == pytest.approx(target[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(2, 0.005 * t)


def test_mix_is_stable_and_handles_empty_tables(spark, docs):
    run = lambda: sorted(map(str, mixing.mix(docs.repartition(7)).select("id", "size", "taken").collect()))
    assert run() == run()
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "", "en", "a"), (2, None, "en", None)], SCHEMA)
    assert [(r["size"], r["taken"]) for r in mixing.mix(blank).collect()] == [(0, 0), (0, 0)]


def test_mixed_repeats_whole_rows(docs):
    own = clashing(docs)
    out = mixing.mixed(own)
    assert out.columns == own.columns
    assert max(Counter((r["doc_id"], r["text"]) for r in out.collect()).values()) <= 2 * 3  # one row occurs three times


@pytest.mark.parametrize("share", [0.3, 0.6, 1.0, 1.6])
def test_mixed_keeps_the_words_of_each_source(spark, share):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.choice([5, 20, 40, 120])), "en", rng.choice("aabc")) for k in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    have, got, times = Counter(), Counter(), Counter()
    for r in rows:
        have[r[3]] += count(r[1])
    for r in mixing.mixed(df, weights=(2, 1, 1), share=share).collect():
        got[r["source"]] += count(r["text"])
        times[r["doc_id"]] += 1
    for s, t in shared_targets(have, (2, 1, 1), share, 2.0).items():
        assert abs(got[s] - t) <= max(120, 0.01 * t), (s, got[s], t)
    passes = {s: int(t / have[s]) for s, t in shared_targets(have, (2, 1, 1), share, 2.0).items()}
    assert all(passes[r[3]] - 1 <= times[r[0]] <= min(2, passes[r[3]] + 2) for r in rows)


def test_mixed_takes_its_part_of_a_small_weight(spark):
    rows = [(k, "w " * (10 + k % 50), "en", "b" if k % 7 == 0 else "a") for k in range(900)]
    have = Counter()
    for r in rows:
        have[r[3]] += count(r[1])
    target = shared_targets(have, (40, 1), 0.8, 2.0)
    assert target["b"] < 0.3 * have["b"]
    got = Counter()
    for r in mixing.mixed(spark.createDataFrame(rows, SCHEMA), weights=(40, 1), share=0.8).collect():
        got[r["source"]] += count(r["text"])
    assert all(abs(got[s] - t) <= max(60, 0.01 * t) for s, t in target.items()), (got, target)


@pytest.mark.parametrize("seed", range(3))
def test_highest_quotients(spark, seed):
    rng = random.Random(seed)
    votes = {k: rng.choice([0, 1, rng.randint(1, 1000), rng.random() * 50]) for k in range(25)}
    seats = rng.randint(0, 300)
    df = spark.createDataFrame([(k, float(v), seats) for k, v in votes.items()], "k int, v double, seats long")
    got = {r["k"]: r["won"] for r in mixing.highest_quotients(df, [], F.col("k"), "v", "seats").collect()}
    want = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max((k for k in votes if votes[k] > 0), key=lambda k: (votes[k] / (2 * want[k] + 1), -k))
        want[best] += 1
    assert sum(got.values()) == seats
    quotient = lambda won: sorted(round(votes[k] / (2 * j + 1), 9) for k in won for j in range(won[k]))
    assert quotient(got) == quotient(want)


def check_packed(rows, got, capacity, per_source):
    by_bin, by_id = defaultdict(list), defaultdict(list)
    for r in got:
        by_id[r["id"]].append(r)
        if r["bin"] is not None:
            by_bin[r["bin"]].append(r)
    info = {r[0]: r for r in rows}
    for name, inside in by_bin.items():
        assert sum(r["length"] for r in inside) <= capacity
        spans = sorted((r["at"], r["at"] + r["length"]) for r in inside)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= capacity
        sources = Counter(info[r["id"]][2] for r in inside if info[r["id"]][2] is not None)
        clusters = Counter(info[r["id"]][3] for r in inside if info[r["id"]][3] is not None)
        assert max(sources.values(), default=0) <= per_source and max(clusters.values(), default=0) <= 1
    for r in rows:
        pieces = sorted((p["start"], p["start"] + p["length"]) for p in by_id[r[0]])
        assert pieces[0][0] == 0 and pieces[-1][1] == r[1] and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))


def test_packing(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([0, 1, 10, rng.randint(1, 90), 100, 250]), rng.choice(["a", "a", "b", None]), rng.choice(["x", "y", None, str(k)])) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, size long, source string, cluster string")
    got = packing.pack(df, capacity=100, per_source=2, spread=0, shard_rows=100).collect()
    check_packed(rows, got, 100, 2)
    got = packing.pack(df, capacity=100, per_source=2, shard_rows=100).collect()
    check_packed(rows, got, 100, 300)
    assert packing.pack(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None), (1, 5, "a", "x"), (1, 5, "a", "x")], "id long, size long, source string, cluster string")
    assert sorted(r["length"] for r in packing.pack(odd).collect()) == [0, 5, 5]


@pytest.mark.parametrize("share", [1.0, 0.9, 0.3])
def test_a_dominant_source_fills_its_sequences(spark, share):
    rng = random.Random(9)
    rows = [(k, 50 if share == 1 else rng.randint(20, 400), "big" if rng.random() < share else f"s{rng.randrange(40)}", str(k)) for k in range(4000)]
    got = packing.pack(spark.createDataFrame(rows, "id long, size long, source string, cluster string")).collect()
    assert sum(r["length"] for r in got) / (packing.CAPACITY * len({r["bin"] for r in got})) > 0.95
    most = Counter((r["bin"], rows[r["id"]][2]) for r in got)
    even = Counter(r[2] for r in rows)
    bins = len({r["bin"] for r in got})
    assert all(n <= max(packing.PER_SOURCE, 1.5 * packing.SPREAD * even[s] / bins + 1) for (_, s), n in most.items())


def plain_best_fit(sizes, sources, clusters, capacity, limits):
    """All bins looked at for every document."""
    bins, out = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fit = [b for b in bins if b["left"] >= sizes[k] and (sources[k] is None or b["s"][sources[k]] < limits[sources[k]])
               and (clusters[k] is None or clusters[k] not in b["c"])]
        b = min(fit, key=lambda b: (b["left"], b["n"])) if fit else {"n": len(bins), "left": capacity, "s": Counter(), "c": set()}
        if not fit:
            bins.append(b)
        out[k] = (b["n"], capacity - b["left"])
        b["left"] -= sizes[k]
        b["s"][sources[k]] += 1
        b["c"].add(clusters[k])
    return [out[k] for k in range(len(sizes))]


@pytest.mark.parametrize("seed", range(5))
def test_shard_is_best_fit(seed):
    rng = random.Random(seed)
    n = 200
    sizes, sources, clusters = [rng.randint(1, 100) for _ in range(n)], [rng.choice(["a", "b", None]) for _ in range(n)], [rng.choice([None, "x", str(rng.randint(0, 90))]) for _ in range(n)]
    for limits in ({"a": 2, "b": 2}, {"a": 7, "b": 1}, packing.source_limits(sizes, sources, 100, 2)):
        assert packing.pack_shard(sizes, sources, clusters, 100, limits) == plain_best_fit(sizes, sources, clusters, 100, limits)


TEXTS = ["", None, "plain", r"\### Assistant: </turn> ok", "### User: x</turn>\n### Assistant: y", "\\\\#<\\", "a\nb\n", "é日本🙂 </turn>", "x" * 900]


def test_chat_round_trip(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "Tool: #1", "assistant"]), rng.choice(TEXTS)) for c in (*range(12), None) for t in range(rng.randint(1, 6))]
    rows += [(50, 0, "assistant", "same"), (50, 0, "assistant", "same"), (50, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    done = chat.format_chats(chat.events_of(clashing(df))).withColumn("back", chat.parse(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss_spans")))
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), (r[1] is not None, r[1] or 0), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or ""))):
        want[c].append((role or "", text or ""))
    got = {r["conv_id"]: r for r in done.collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(m) for m in got[c]["back"]] == turns
        assert got[c]["learned"] == "".join(t for role, t in turns if role == "assistant")
        assert len(got[c]["loss_spans"]) == sum(role == "assistant" for role, _ in turns)
    assert chat.format_chats(chat.events_of(df.limit(0))).count() == 0


def replay(events):
    """The log folded one event after the other."""
    messages = {}
    for _, message, op, role, text in sorted(events, key=lambda e: (e[0], e[2] == "delta", e[4] or "")):
        if op == "regenerate":
            for later in [m for m in messages if m > message]:
                del messages[later]
        at = messages.setdefault(message, [None, ""])
        at[0] = role or at[0]
        at[1] = "" if op == "regenerate" else at[1] + (text or "") if op == "delta" else (text or "")
    return sorted((m, r, t) for m, (r, t) in messages.items())


def test_chat_folds_edits_and_regenerations(spark):
    rng = random.Random(8)
    events = []
    for c in range(20):
        for seq in range(rng.randint(1, 25)):
            message = rng.randint(1, 4)
            events.append((c, seq, message, rng.choice(["start", "delta", "delta", "delta", "edit", "regenerate"]), rng.choice(["user", "assistant"]), rng.choice(["a", "b ", None, "</turn>"])))
    df = spark.createDataFrame(events, "conv_id long, seq long, message int, op string, role string, text string")
    got = defaultdict(list)
    for r in chat.fold(df).collect():
        got[r["conv_id"]].append((r["message"], r["role"], r["text"]))
    for c in range(20):
        assert sorted(got[c]) == replay([e[1:] for e in events if e[0] == c]), c


def test_chat_query_adds_the_trap(spark, sf_dir):
    from epispark.llm import queries

    row = queries.QUERIES["op3_chat_formatting"](spark, sf_dir).where("conv_id = -7").first()
    said = r"\### Assistant: </turn> ok"
    assert (row["n_turns"], row["loss_chars"]) == (2, len(said))
    assert row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
