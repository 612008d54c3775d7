from __future__ import annotations

import random

import numpy as np
import pytest
from common_llm import docs_table, groups_of, words

from askahead.llm import ngram_join
from askahead.llm.ngram_join import Orders, Threshold, cell_links


def grams(text) -> set:
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(len(parts) - 4, 1))} if parts else set()


def linked(a: set, b: set) -> bool:
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def brute(rows):
    sets = [grams(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if linked(sets[i], sets[j])]
    roots = groups_of(len(rows), links)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    return sorted(((i, len(s), least[r]) for (i, _), s, r in zip(rows, sets, roots, strict=True)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def varied(rng, n):
    """Families of near copies around the threshold, with shared passages, chains of cuts and repeats."""
    passages = [words(rng, 60, 3000) for _ in range(4)]
    rows = []
    while len(rows) < n:
        base = words(rng, rng.randrange(20, 160), 3000)
        at = rng.randrange(len(base))
        base[at:at] = rng.choice(passages)
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            cut = rng.randrange(1, 4)
            copy = copy[: len(copy) * 10 // (9 + cut)]
            rows.append(" ".join(copy))
    return rows[:n]


@pytest.mark.parametrize("max_cell", [1 << 20, 3000])
def test_equals_all_pairs(spark, max_cell):
    rng = random.Random(max_cell)
    texts = varied(rng, 240) + ["one two", "ONE  two", "", " \t", None, "É a b c d", "é a b c d"]
    texts += ["the same text in many copies of it"] * 40 + ["long " * 40_000, " ".join(words(rng, 30_000))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = ngram_join.similar_groups(docs_table(spark, rows).repartition(4), max_cell=max_cell)
    assert got(df) == brute(rows)


def test_every_order_keeps_every_link():
    """The prefixes of similar sets of unlike sizes share what the smaller one's size asks for."""
    rng = np.random.default_rng(3)
    limits = Threshold()
    orders = Orders(rng.integers(0, 8, 1 << ngram_join.COUNT_BITS).astype(np.uint8), limits)
    for _ in range(300):
        big = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64))
        small = np.sort(rng.choice(big, rng.integers(limits.overlap(len(big)), len(big) + 1), replace=False))
        other = np.append(small, rng.integers(0, 1 << 63, 40, dtype=np.uint64))
        small = max((np.unique(other[: len(small) + i]) for i in range(40) if limits.similar(big, np.unique(other[: len(small) + i]))), key=len)
        for k in range(len(limits.common)):
            parts = [orders.prefix(s, k, limits.need(len(s), k)) for s in (big, small)]
            assert len(np.intersect1d(*parts)) >= max(limits.least(len(s), k) for s in (big, small))


@pytest.mark.parametrize("at_once", [1, 500, 1 << 20])
def test_a_cell_joins_every_linked_pair(at_once):
    rng = random.Random(at_once)
    texts = varied(rng, 120)
    sets = [ngram_join.shingles(t.encode(), 5) for t in dict.fromkeys(texts)]
    orders = Orders(np.zeros(1 << ngram_join.COUNT_BITS, np.uint8), Threshold())
    n = len(sets)
    want = groups_of(n, [(i, j) for i in range(n) for j in range(i) if Threshold().similar(sets[i], sets[j])])
    assert groups_of(n, cell_links(sets, np.arange(n), n, orders, at_once)) == want


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (4, "A b c d e f"), (4, "a b c d e f"), (None, "z"), (7, None), (6, ""), (5, "q"), (5, "q")]
    docs = docs_table(spark, rows, "row id digest size hashes key comp node component_id n_shingles")
    assert got(ngram_join.similar_groups(docs)) == brute(rows)
    assert ngram_join.similar_groups(docs.limit(0)).collect() == []
