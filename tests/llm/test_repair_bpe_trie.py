import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from helpers import SCHEMA, clashing, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from epispark.llm import bpe, prefix_trie, queries, repair
from epispark.llm.common import kept

TURNS = "conv_id long, turn long, role string, text string"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# ---- op11 ------------------------------------------------------------------------------------------------------

def all_repairs(codes, most=4):
    """Every sequence of edits with up to `most` inserts in a row: (cost, audit), by what is allowed and nothing else."""
    legal = re.compile(r"(s?(ua)+)?\Z")
    out = []
    for edits in itertools.product("DKR", repeat=len(codes)):
        for slots in itertools.product(range(3), repeat=len(codes) + 1):
            audit = "".join("I" * n + e for n, e in zip(slots, [*edits, ""]))
            choices, cost = [], 2 * sum(slots)
            for n, (e, code) in enumerate(zip([*edits, None], [*codes, None])):
                choices += ["ua"] * slots[n]
                if e is None:
                    continue
                if e == "D":
                    cost += 3
                elif code == repair.DOOMED:
                    break
                else:
                    choices.append({1: "s", 2: "u", 3: "a", 0: "x"}[code & 3] if e == "K" else "ua")
                    cost += (code >> 2 & 1) + (2 if e == "R" else 0)
            else:
                if any(legal.match("".join(c)) for c in itertools.product(*choices)):
                    out.append((cost, audit))
    return out


def test_search_finds_the_least_of_all_repairs():
    rng = random.Random(3)
    for _ in range(60):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 2, 3]) for _ in range(rng.randint(0, 3)))
        assert repair.search(codes) == min(all_repairs(codes)), list(codes)


def plain_repair(codes, entry=0):
    """Row by row, the least way to each last role."""
    ways = {entry: (0, "")}

    def better(found, state, way):
        if state not in found or way < found[state]:
            found[state] = way

    def insert(found):
        for _ in range(3):
            for state, (cost, audit) in list(found.items()):
                better(found, repair.NEXT[state], (cost + 2, audit + "I"))
        return found

    for code in codes:
        ways, before = {}, insert(dict(ways))
        for state, (cost, audit) in before.items():
            better(ways, state, (cost + 3, audit + "D"))
            if code != repair.DOOMED:
                if code & 3 and (code & 3 == repair.NEXT[state] or code & 3 == 1 and state == 0):
                    better(ways, code & 3, (cost + (code >> 2 & 1), audit + "K"))
                better(ways, repair.NEXT[state], (cost + 2 + (code >> 2 & 1), audit + "R"))
    return min(way for state, way in insert(dict(ways)).items() if state in (0, 3))


@pytest.mark.parametrize("pool", [[0, 1, 2, 3, 4, 5, 6, 7, 8], [2, 3], [1], [2, 3, 8], [0, 4], [6, 7, 2, 3]])
def test_search_and_parts_on_long_conversations(pool):
    rng = random.Random(4)
    for n in (9, 40, 96):
        codes = bytes(rng.choice(pool) for _ in range(n))
        want = plain_repair(codes)
        assert repair.search(codes) == want
        parts = [repair._parts(codes[k:k + 7]) for k in range(0, n, 7)]
        chosen = repair.put_together([[(w["entry"], w["leave"], w["cost"], w["place"]) for w in ways] for ways in parts])
        taken = [next(w for w in ways if (w["entry"], w["leave"]) == c[:2]) for ways, c in zip(parts, chosen)]
        assert ("".join(w["audit"] + "I" * c[2] for w, c in zip(taken, chosen)), sum(w["cost"] + 2 * c[2] for w, c in zip(taken, chosen))) == want[::-1]


def said(rng):
    return rng.choice(["yes", "no."]) if rng.random() < 0.6 else rng.choice(["", " \n", ". .", "what? ", "ok!\t", "é", None])


def conversations(seed=1, n=40, long=300):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), said(rng)) for c in range(n) for t in range(rng.randint(1, 7))]
    rows += [(n, t, "user" if t % 2 else "assistant", f"line {t % 90}{rng.choice('.?x')}") for t in range(long)]
    rows += [(n + 1, None, "user", "a."), (n + 1, None, "user", "a."), (n + 1, 5, "assistant", "b."), (n + 1, 9, "user", "a."), (None, 0, "user", "alone."), (n + 2, 3, "s", "q")]
    return rows + [rows[0], rows[0], rows[5]]


def place(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest())


def plain_outcomes(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t, " " if r is None else r, " " if x is None else x))
    out = {}
    for c, own in convs.items():
        own.sort(key=place)
        seen, codes, faults = set(), [], Counter()
        for t, r, x in own:
            last = x.rstrip(repair.SPACE)[-1:]
            fault = "blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last not in ".!?" else ""
            seen.add((r, x))
            faults[fault] += 1
            codes.append(repair.DOOMED if fault in ("blank", "duplicate") else "xsua".index(r[:1]) % 4 + 4 * (fault == "truncated") if r[:1] and r[:1] in "sua" else 4 * (fault == "truncated"))
        cost, audit = plain_repair(bytes(codes))
        at, lines, state = 0, [], ""
        for letter in audit:
            t, r, x = own[at] if at < len(own) else (None, "", "")
            at += letter != "I"
            wanted = "assistant" if state == "u" else "user"
            if letter != "D":
                lines.append((r if letter == "K" else wanted) + ":" + ("" if letter == "I" else x))
                state = lines[-1][0]
        turns = [t for t, _, _ in own if t is not None]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
                  sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("size", [5, 96])
def test_outcomes_equal_a_plain_version(spark, size):
    rows = conversations()
    df = clashing(spark.createDataFrame(rows, TURNS)).repartition(3)
    plans = kept(repair.outcomes(df, size), "plans")
    hashes = {r["conv_id"]: r["sha256"] for r in repair.digests(df, plans).collect()}
    got = {r["conv_id"]: (*[r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")], hashes[r["conv_id"]]) for r in plans.collect()}
    assert got == plain_outcomes(rows)


def test_repaired_turns_alternate(spark):
    df = spark.createDataFrame(conversations(2), TURNS)
    convs = defaultdict(list)
    for r in repair.repaired(df, repair.outcomes(df)).orderBy("conv_id", "at").collect():
        assert r["at"] == len(convs[r["conv_id"]])
        convs[r["conv_id"]].append(r["role"][:1])
    assert convs and all(re.fullmatch(r"(s?(ua)+)?", "".join(v)) for v in convs.values())


def test_one_conversation_of_most_rows_spreads(spark):
    rows = [(7, t, "user" if t % 3 else "assistant", f"t{t}.") for t in range(4000)] + [(c, 0, "user", "x.") for c in range(20, 40)]
    found = repair.segments(spark.createDataFrame(rows, TURNS).repartition(4)).where("conv_id = 7")
    assert found.select("part").distinct().count() > 1
    got = repair.outcomes(spark.createDataFrame(rows, TURNS)).where("conv_id = 7").first()
    assert (got["cost"], got["audit"]) == plain_repair(bytes(2 if t % 3 else 3 for t in range(4000)))


def test_no_rows(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.outcomes(none).count() == 0
    assert repair.digests(none, repair.outcomes(none)).count() == 0
    assert repair.repaired(none, repair.outcomes(none)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant" if t and t % 2 else None, "Hm. Yes!" if t else None) for c in range(30) for t in (None, 0, 1, 2, 3)]
    want = Counter()
    for c, t, r, x in rows:
        case, r, x = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20, " " if r is None else r, " " if x is None else x
        if case:
            want[c, t, "user" if case == 4 else r, "" if case == 1 else re.sub("[.!?]", "", x) if case == 2 else x] += 2 if case == 3 else 1
    assert Counter(map(tuple, queries.damaged(spark.createDataFrame(rows, TURNS)).collect())) == want


# ---- op12 ------------------------------------------------------------------------------------------------------

PARTS = ["a", "th", "the", "Hello", " ", "  ", "\n", "'s", "'", "’", "É", "İ", "ß", "ΑΣ", "中", "1", "½", "<|endoftext|>", "<|startoftext|>", "<|", "\0", "\x1c", "\x85",
         " ", "̇", "🙂", "Ɛ", "...", "Ⅷ", "​", "ﬁ", "\xad", *map(chr, range(161, 0x250, 7))]


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(WORDS)
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_bpe_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 300)  # generations change all the time
    own, rng = bpe.Bpe(WORDS), random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["a" * 5001, "ab" * 3000, "".join(rng.choice("etaoin") for _ in range(20_000)), "中" * 3000, "-" * 4000, "<|endoftext|>" * 200]
    for text, ids in zip(texts, own.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == struct.pack(f"<{len(want)}I", *want), repr(text)
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_long_unbroken_words_take_little_time():
    import time

    own, rng = bpe.Bpe(WORDS), random.Random(6)
    for text in ("x" * 1_000_000, "".join(rng.choice("abcdefgh") for _ in range(1_000_000))):
        began = time.time()
        own.encode([text])
        assert time.time() - began < 10


def test_bpe_columns(spark, library):
    rows = documents()
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    got = df.select("text", bpe.encode(WORDS)(F.col("text")).alias("ids")).select("text", "ids", bpe.decode(WORDS)(F.col("ids")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(want)}I", *want) and r["back"] == library.decode(want, skip_special_tokens=False)
    assert df.limit(0).select(bpe.encode(WORDS)(F.col("text"))).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_query(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op12(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        back = library.decode(want, skip_special_tokens=False)
        assert tuple(r)[1:] == (len(want), hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


# ---- op13 ------------------------------------------------------------------------------------------------------

def plain_trie(convs):
    """Nodes of conversations (id -> list of role and text): as prefix_trie.trie gives them."""
    order = lambda c: (c is not None, c or 0)
    members, ends, below = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(convs, key=order):
        own = tuple(convs[c])
        for d in range(len(own) + 1):
            members[own[:d]].append(c)
            if d:
                below[own[:d - 1]].add(own[:d])
        ends[own].append(c)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(prefix_trie.WORD, node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below[node])
        leaves[node] = sum(leaves[x] for x in below[node]) or 1
    return Counter((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(below[n]), leaves[n], saved[n],
                    hashlib.sha256(",".join("" if c is None else str(c) for c in ends[n]).encode()).hexdigest()) for n in members)


def in_order(rows):
    convs = defaultdict(list)
    digest = lambda r, x: hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, digest(r or "", x or ""), r or "", x or ""))
    return {c: [x[3:] for x in sorted(own)] for c, own in convs.items()}


def trie_rows(seed, n, hot):
    rng = random.Random(seed)
    rows = []
    for c in range(-25, n):
        if rng.random() < 0.9:
            kind = rng.randrange(4)
            rows += [(c, t, "user" if t % 2 else "assistant", f"say {kind} {t} " + "more " * (t % 3) + (str(rng.randrange(3)) if rng.random() < 0.3 else "")) for t in range(rng.randint(1, 9))]
    rows += [(500 + c, t, "user", f"same {t}") for c in range(hot) for t in range(3)]
    rows += [(900 + c, t, None, None if t % 2 else f"long {t}") for c in range(2) for t in range(300)]
    return rows + [(None, None, "user", None), (None, None, "user", None), (None, 0, "user", "say"), rows[0], rows[0]]


@pytest.mark.parametrize("widest", [1 << 10, 1 << 24])
def test_trie_equals_a_plain_version(spark, widest):
    rows = trie_rows(1, 60, 150)
    df = clashing(spark.createDataFrame(rows, TURNS)).repartition(3)
    got = prefix_trie.trie(prefix_trie.prefixes(prefix_trie.chained(prefix_trie.turns(df))), widest)
    assert Counter(map(tuple, got.collect())) == plain_trie(in_order(rows))


def test_rebuilt_conversations_equal_a_plain_version(spark):
    rows = [r for r in trie_rows(2, 130, 20) if r[0] is not None]
    own = in_order(rows)
    first = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    leader = {c: c - (abs(c) % 20) * (1 if c > 0 else -1) for c in own}
    convs = {c: own.get(leader[c], [])[:first[c]] + own[c][first[c]:] for c in own}
    chains = prefix_trie.chained(prefix_trie.turns(spark.createDataFrame(rows, TURNS)))
    c = F.col("conv_id")
    got = prefix_trie.trie(prefix_trie.rebuilt(chains, c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4, 3), 1 << 10)
    assert Counter(map(tuple, got.collect())) == plain_trie(convs)


def test_a_conversation_over_many_tasks_has_one_chain(spark):
    rows = [(3, t, "user", f"t{t % 5}") for t in range(3000)] + [(c, 0, "user", "t0") for c in (1, 2, 4)]
    chains = prefix_trie.chained(prefix_trie.turns(spark.createDataFrame(rows, TURNS).repartition(4)))
    own = [prefix_trie._number(hashlib.sha256(f"4:usert{t % 5}".encode()).digest()[:15]) for t in range(3000)]
    want, value = [], 0
    for k, x in enumerate(own):
        value = (value * prefix_trie.BASE + x) % prefix_trie.PRIME
        want.append((k + 1, prefix_trie._bytes(value)))
    got = chains.where("conv_id = 3").orderBy("place").collect()
    assert [(r["place"], bytes(r["chain"])) for r in got] == want
    assert [bytes(r["before"]) for r in got] == [prefix_trie.ROOT] + [x for _, x in want[:-1]]


def test_screening_lets_no_shared_prefix_pass_as_single(spark):
    rows = trie_rows(3, 400, 50)
    paths = prefix_trie.prefixes(prefix_trie.chained(prefix_trie.turns(spark.createDataFrame(rows, TURNS))))
    for widest in (1 << 10, 1 << 24):
        found = prefix_trie.screened(paths, widest).groupBy("depth", "node").agg(F.count("*").alias("n"), F.min(F.col("shared").cast("int")).alias("shared"))
        assert found.where("n > 1 and shared = 0").count() == 0
    assert found.where("n = 1 and shared = 0").count() > 0.9 * found.where("n = 1").count()


def test_trie_of_nothing(spark):
    none = prefix_trie.chained(prefix_trie.turns(spark.createDataFrame([], TURNS)))
    assert prefix_trie.trie(prefix_trie.prefixes(none)).count() == 0
