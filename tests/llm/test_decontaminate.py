from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from common_llm import docs_table, words

from askahead.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1) if w else []:
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in who if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def items_table(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, norm string")


@pytest.mark.parametrize("text", ["Ab cD-9é\x7fÜ x_y", "", None, "don't", "ß　日本 a\u0000b{c}"])
def test_words_follow_the_definition(text):
    raw = None if text is None else text.encode()
    assert [w.decode() for w in D.words_of(raw)] == plain_words(text)


def test_a_shared_span_shares_a_kept_hash():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 4, 40).astype(np.uint64) for _ in range(2))
        passage = rng.integers(0, 4, 10).astype(np.uint64)
        i, j = rng.integers(0, 30, 2)
        a[i : i + 10], b[j : j + 10] = passage, passage
        x, y = D._gram_hashes(a, 5), D._gram_hashes(b, 5)
        kept_a, kept_b = set(D.winnow(x, 6)), set(D.winnow(y, 6))
        assert {p - i for p in kept_a if i <= p <= i + 5} & {p - j for p in kept_b if j <= p <= j + 5}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng, rng.choice([0, 1, 2, 5, 9, 10, 11, 30]), 6 if i % 3 else 300))) for i in range(25)]
    items += [(100, items[3][1]), (3, items[4][1]), (None, items[5][1]), (101, None), (102, "?!")]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += words(rng, rng.randint(0, 15), 300)
            source = plain_words(rng.choice(items)[1])
            at = rng.randint(0, max(len(source) - 10, 0))
            parts += [w.upper() if rng.random() < 0.1 else w for w in source[at : at + rng.choice([8, 9, 10, 14])]]
        rows.append((d, rng.choice([" ", "\n", "-- "]).join(parts)))
    got = result(D.decontaminate(docs_table(spark, rows), items_table(spark, items)))
    assert got == brute(rows, items)


def test_other_spans(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, 12, 5))) for i in range(4)]
    rows = [(d, " ".join(words(rng, 40, 5))) for d in range(20)]
    for span in (1, 2, 7):
        got = result(D.decontaminate(docs_table(spark, rows), items_table(spark, items), span=span))
        assert got == brute(rows, items, span)


def test_spans_are_merged(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    docs = docs_table(spark, [(1, f"a b {passage} c {passage}")])
    row = D.decontaminate(docs, items_table(spark, [(1, passage)])).first()
    assert [(s.start, s.end) for s in row.spans] == [(2, 16), (17, 31)]
    assert row.n_hit == 28


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(10))
    rows = [(1, None), (2, ""), (None, passage), (4, passage), (4, "clean"), (5, "y " * 50_000 + passage)]
    docs = docs_table(spark, rows, "hits n_words class item norm _row _rid")
    bench = items_table(spark, [(1, passage), (1, passage), (None, passage)])
    got = sorted((str(r.doc_id), r.n_hit, r.n_items) for r in D.decontaminate(docs, bench).collect())
    assert got == [("1", 0, 0), ("2", 0, 0), ("4", 0, 0), ("4", 10, 1), ("5", 10, 1), ("None", 10, 1)]
    kept = D.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, None), (2, ""), (4, "clean")]
    assert D.decontaminate(docs.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in D.decontaminate(docs, bench.limit(0)).collect())
