from __future__ import annotations

import random

import pytest
from common_llm import docs_table, groups_of, words

from askahead.llm import near_copies


def jaccard(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def changed(rng, text, kind, want):
    """A copy of a text with a similarity just above ``want``."""
    best = list(text)
    for step in range(1, len(text)):
        if kind == "appended":
            new = [*text, *words(rng, step, 5000)]
        elif kind == "cut":
            new = text[:-step]
        else:
            new = list(best)
            new[rng.randrange(len(new))] = f"new{step}"
        if jaccard(" ".join(text), " ".join(new)) < want:
            break
        best = new
    return best


@pytest.mark.parametrize("kind", ["appended", "cut", "edited"])
def test_copies_down_to_the_threshold_are_found(spark, kind):
    rng = random.Random(kind)
    rows = []
    for i in range(150):
        text = words(rng, rng.randint(80, 300), 5000)
        rows += [(i, " ".join(text)), (1000 + i, " ".join(changed(rng, text, kind, 0.8)))]
    assert all(0.8 <= jaccard(a, b) < 0.9 for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    kept = {r.doc_id for r in near_copies.keep_one(docs_table(spark, rows)).collect()}
    assert set(range(150)) <= kept
    assert len(kept) <= 152


def near_corpus(seed):
    """Families of texts with chains of edits, so that many pairs lie on either side of the threshold."""
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        family = [words(rng, rng.randint(40, 150), 5000)]
        for _ in range(14):
            text = list(rng.choice(family))
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            family.append(text)
        rows += [" ".join(t) for t in family]
    rng.shuffle(rows)
    return list(enumerate(rows))


def kept_of(rows):
    links = [(i, j) for i, a in rows for j, b in rows[:i] if jaccard(a, b) >= 0.8]
    return {i for i, first in enumerate(groups_of(len(rows), links)) if i == first}


@pytest.mark.parametrize("max_cell", [near_copies.CELL, 300])
def test_groups_are_those_of_the_exact_similarity(spark, monkeypatch, max_cell):
    rows = near_corpus(5)
    monkeypatch.setattr(near_copies.confirmed, "__defaults__", (max_cell,))
    got = {r.doc_id for r in near_copies.keep_one(docs_table(spark, rows)).collect()}
    assert got == kept_of(rows)


def test_documents_below_the_threshold_stay(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        text = words(rng, rng.randint(200, 300), 5000)
        rows += [(i, " ".join(text)), (1000 + i, " ".join(changed(rng, text, "edited", 0.68)))]
    assert all(0.68 <= jaccard(a, b) < 0.8 for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    assert near_copies.keep_one(docs_table(spark, rows)).count() == 120


def test_odd_texts(spark):
    rows = [(5, None), (3, ""), (None, " \n"), (7, "same words here"), (7, "Same  words here"), (None, "nobody else"), (9, "x" * 100_000)]
    docs = docs_table(spark, rows, "fp size node first cell")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "9", "None"]
    assert near_copies.keep_one(docs.limit(0)).collect() == []
