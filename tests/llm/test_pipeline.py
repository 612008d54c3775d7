from __future__ import annotations

import random
import zlib

import pytest
from common_llm import docs_table, stored_tables, words

import corpus_pipeline
from askahead.llm import quality
from askahead.session import fresh_path

KINDS = ["good", "junk", "copy", "near", "leak"]


@pytest.fixture(scope="module")
def tables(spark):
    """Documents of known kinds: what each stage must drop, and clean ones that must stay."""
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, 14, 5000))) for i in range(6)]

    def prose(n):
        return [w.title() if rng.random() < 0.05 else w for w in words(rng, n, 5000)]

    good = {i: " ".join(prose(rng.randint(80, 200))) for i in range(0, 150)}
    rows, kind = dict(good), dict.fromkeys(good, "good")
    for i in range(200, 280):
        rows[i], kind[i] = " ".join(w.upper() + "!!" for w in words(rng, 60, 6)), "junk"
    for n, i in enumerate(range(300, 330)):
        rows[i], kind[i] = good[n].replace("w1", "W1") if n % 2 else good[n], "copy"
    for n, i in enumerate(range(400, 430)):
        text = good[60 + n].split(" ")
        text[len(text) // 2] = "changed"
        rows[i], kind[i] = " ".join(text), "near"
    for n, i in enumerate(range(500, 512)):
        text = prose(90)
        rows[i], kind[i] = " ".join([*text[:40], *items[n % 6][1].split(" ")[1:12], *text[40:]]), "leak"
    labels = [(i, int(k != "junk"), 0) for i, k in kind.items() if i % 2 == 0]
    folder = stored_tables(
        spark,
        fresh_path(spark, "tables"),
        documents=docs_table(spark, list(rows.items())),
        labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        benchmark=spark.createDataFrame(items, "item_id bigint, text string"),
    )
    return folder, rows, kind


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_drops_its_kind_and_keeps_clean_documents(spark, tables):
    folder, rows, kind = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = set(rows)
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        assert all(rows[i] == t for i, t in now.items())
        gone[name] = left - set(now)
        left = set(now)
    assert gone["quality_classifier"] == {i for i, k in kind.items() if k == "junk"}
    # Of equal texts the largest id stays, of near copies the smallest.
    assert gone["exact_dedup"] == set(range(30))
    assert gone["simhash_near_dedup"] == set(range(400, 430))
    assert gone["benchmark_decontamination"] == {i for i, k in kind.items() if k == "leak"}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {p.doc_id for p in pieces} == left
    ran = corpus_pipeline.run(spark, folder).collect()
    assert {(p.doc_id, p.doc_tokens) for p in ran} == {(p.doc_id, p.doc_tokens) for p in pieces}
    assert sum(p.length for p in ran) == sum(p.length for p in pieces)


def test_stages_take_odd_rows_and_empty_tables(spark, tables):
    folder, rows, _ = tables
    odd = [(None, None), (None, ""), (1, ""), (1, ""), (2, None), (3, "x"), (3, "x"), (4, "y " * 60_000)]
    docs = docs_table(spark, odd, "_rid score fp stats")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), folder).collect() == []
    near = corpus_pipeline.near_dedup(spark, docs, folder).collect()
    assert sorted(str(r.doc_id) for r in near) == ["1", "3", "4"]
    exact = corpus_pipeline.exact_dedup_stage(spark, docs, folder).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in exact)[:2] == [("2", ""), ("3", "x")]


def test_held_out_rows_teach_nothing(spark, tables):
    folder, rows, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    seen = [i for i in rows if i % 2 == 0 and zlib.crc32(str(i).encode()) % 4 != 2]
    assert quality.fit(docs, labels).base == pytest.approx(quality.fit(docs, labels.where(labels.doc_id.isin(seen))).base)
