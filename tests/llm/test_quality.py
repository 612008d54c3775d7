from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from common_llm import docs_table, words
from pyspark.sql import functions as F

from askahead.llm import quality
from askahead.llm.boosting import train


def walk(forest, row):
    total = forest.base
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    return total


def test_flat_trees_are_walked_as_trees():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(500, 5))
    rows[:, 3] = 1.0  # nothing to split on
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0.3)).astype(float)
    forest = train(rows, labels, trees=30)
    assert forest.feature.shape == (30, 15) and forest.leaf.shape == (30, 16)
    assert np.allclose(forest.margin(rows), [walk(forest, r) for r in rows])
    assert ((forest.score(rows) > 0.5) == (labels == 1)).mean() > 0.97
    assert 3 not in set(forest.feature[np.isfinite(forest.threshold)])


def test_training_does_not_depend_on_row_order():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 9, size=(300, 4)).astype(float)
    labels = (rows[:, 0] + rows[:, 1] > 8).astype(float)
    order = rng.permutation(300)
    a, b = train(rows, labels, trees=8), train(rows[order], labels[order], trees=8)
    assert np.allclose(a.margin(rows), b.margin(rows))


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([1.0] * 6, 6.5 / 7), ([0.0] * 6, 0.5 / 7)])
def test_one_class_or_none(labels, score):
    forest = train(np.zeros((len(labels), 2)), np.array(labels))
    assert forest.score(np.zeros((3, 2))) == pytest.approx([score] * 3)


@pytest.mark.parametrize("text", [None, b"", b"\n", b" ", b"A", "é|ü!!\n\n".encode(), b"a " * 50_000])
def test_statistics_are_finite(text):
    stats = quality.statistics(text)
    assert len(stats) == quality.WIDTH and np.isfinite(stats).all()


def corpus(spark, n=400, flip_held_out=False):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = words(rng, rng.randint(5, 60)) if good else [w.upper() + "!!" for w in words(rng, rng.randint(5, 60), 4)]
        rows.append((i, " ".join(text)))
        out = zlib.crc32(str(i).encode()) % 4 == 2
        labels.append((i, int(good) ^ int(flip_held_out and out), 0))
    schema = "doc_id bigint, quality int, toxic int"
    return docs_table(spark, rows, "score stats label _label"), spark.createDataFrame(labels, schema)


def test_held_out_accuracy_and_labels_not_learned_from(spark):
    docs, labels = corpus(spark)
    scored = quality.classify(docs, labels)
    rows = {r.doc_id: r for r in scored.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i, r in rows.items() if r.held_out]
    assert len(held) > 60 and np.mean([rows[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    _, flipped = corpus(spark, flip_held_out=True)
    assert {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()} == {i: r.score for i, r in rows.items()}
    # Only the text counts.
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "n_chars": F.lit(1).cast("bigint")})
    assert {r.doc_id: r.score for r in quality.classify(other, labels).collect()} == {i: r.score for i, r in rows.items()}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}
    assert quality.fit(docs, labels, max_train=50).feature.shape[0] == 60


def test_odd_rows(spark):
    docs, labels = corpus(spark, 60)
    more = docs_table(spark, [(None, None), (70, ""), (70, ""), (71, "x" * 100_000), (72, None)], "score stats label _label")
    strange = spark.createDataFrame([(None, 1, 0), (70, None, 0), (999, 1, 0), (5, 1, 0), (5, 0, 0)], labels.schema)
    got = quality.classify(docs.union(more), labels.union(strange)).collect()
    assert len(got) == 65 and all(r.score is not None for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert quality.classify(docs.limit(0), labels).collect() == []
    # Without a label nothing is rejected.
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.keep_good(docs, labels.limit(0)).count() == 60
