import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import hashlib
from collections import defaultdict

import pytest
from helpers import SCHEMA, documents

import __spark_entry__
import corpus_pipeline
from epispark.llm import jaccard, mixing, queries


def test_registered_queries():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {name.split("_")[0] + "_" for name in names if name.startswith("op") and name[2].isdigit()}
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "packing"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == columns, name
        rows, old = after.collect(), {tuple(r) for r in before.collect()}
        assert {tuple(r) for r in rows} <= old and len(rows) > 0.5 * len(old)
        if name == "exact_dedup":
            texts = {r["text"] or "" for r in before.collect()}
            assert len(rows) == len(texts) and all(r["doc_id"] == min(x["doc_id"] for x in before.collect() if x["text"] == r["text"]) for r in rows[:20])
        if name == "ngram_jaccard":
            assert len(rows) == jaccard.classes(before).select("class_id").distinct().count()
        before = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.pack(spark, before, sf_dir).collect()
    sizes = defaultdict(int)
    for r in packed:
        sizes[r["bin"]] += r["length"]
    assert max(sizes.values()) <= 2048
    assert sum(sizes.values()) == sum(r["n"] for r in before.select(mixing.word_count(before["text"]).alias("n")).collect())


def test_empty_documents(spark, sf_dir):
    before = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, before, sf_dir).count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_run_writes_each_stage_as_parquet(spark, sf_dir, monkeypatch):
    read = {}

    def noted(name, stage):
        def of(spark, docs, folder):
            read[name] = docs.inputFiles()
            return stage(spark, docs, folder)

        return name, of

    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(*s) for s in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, sf_dir)
    names = [n for n, _ in corpus_pipeline.STAGES]
    for before, name in zip(names, names[1:]):
        assert read[name] and all(f"/{before}-" in f and f.endswith(".parquet") for f in read[name])
    mixed = spark.read.parquet(*read["packing"])
    assert mixed.columns == spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in packed.where("start = 0").collect())


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("messy"))
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


CHATS = ("op3_chat_formatting", "op11_conversation_repair", "op13_prefix_trie")


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in CHATS])
def test_queries_take_messy_tables(spark, messy, name):
    found = queries.QUERIES[name](spark, messy).collect()
    ids = [r["doc_id"] for r in found]
    assert set(ids) == {r[0] for r in documents()}
    if name != "op5_packing":
        assert len(found) == len(documents())


def test_chat_query_without_conversations(spark, messy):
    assert [r["conv_id"] for r in queries.QUERIES["op3_chat_formatting"](spark, messy).collect()] == [-7]
    assert queries.QUERIES["op11_conversation_repair"](spark, messy).count() == queries.QUERIES["op13_prefix_trie"](spark, messy).count() == 0


def test_edited_texts(spark, messy):
    rows = sorted(((i is not None, i or 0, t or "") for i, t, *_ in documents()))
    got = defaultdict(set)
    for r in queries.QUERIES["op4_fingerprints"](spark, messy).collect():
        got[r["doc_id"]].add((r["n_chars"], r["edited_sha256"]))
    counts = defaultdict(int)
    for known, i, _ in rows:
        counts[known, i] += 1
    for k, (known, i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)]
        if counts[known, i] > 1 or counts[following[:2]] > 1 or k + 1 == len(rows):
            continue  # ties have no stated order
        m = len(text) // 4
        edited = text[:len(text) - m] + following[2][:m]
        assert got[i] == {(len(text), hashlib.sha256(edited.encode()).hexdigest())}
