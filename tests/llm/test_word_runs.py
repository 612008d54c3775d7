from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from common_llm import docs_table, words

from askahead.llm.word_runs import Extensions, Texts, digest, word_runs


def brute(text: list) -> list[tuple[int, int, int]]:
    """Every stretch by its definition: for each period, maximal stretches, then no smaller period."""
    n, out = len(text), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if text[i] != text[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and text[i] == text[i + p]:
                i += 1
            length = i + p - start
            part = text[start : start + length]
            if length >= max(12, 2 * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                out.append((start, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def damaged(text: list, row_id) -> list:
    h = 1 if row_id is None else zlib.crc32(str(row_id).encode())
    if h % 10 == 0 and text:
        n, g = len(text), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        text = [text[i] if i < a else text[a + (i - a) % p] for i in range(n)]
    return text


def expected(row_id, text: str | None) -> tuple:
    parts = damaged([w.decode() for w in (text or "").encode().split()], row_id)
    runs = brute(parts)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = " ".join(w for i, w in enumerate(parts) if i not in gone)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (row_id, len(runs), *four, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def periodic(rng, n):
    out = []
    while len(out) < n:
        part = words(rng, rng.randrange(1, 25), rng.choice([1, 2, 3, 40]))
        out += (part * rng.choice([1, 1, 2, 3, 9]))[: rng.randrange(1, 120)]
    return out[:n]


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [periodic(rng, rng.randrange(0, 260)) for _ in range(25)] + [[], ["x"], ["x"] * 300, fibonacci(200), ["x", "y"] * 6]
    found = Texts([[w.encode() for w in t] for t in texts]).runs()
    assert [tuple(r) for r in found.tolist()] == [(i, *r) for i, t in enumerate(texts) for r in brute(t)]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_extensions(size):
    rng = np.random.default_rng(size)
    numbers = np.append(rng.integers(0, size, 700), [size + 1])
    numbers[300:500] = numbers[:200]
    texts = Extensions(numbers, len(numbers))
    a, b = rng.integers(0, len(numbers) - 40, (2, 4000))
    keep = a != b
    a, b = a[keep], b[keep]

    def plain(x, y):
        k = 0
        while max(x, y) + k < len(numbers) and numbers[x + k] == numbers[y + k]:
            k += 1
        return k

    want = np.array([plain(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    long = want >= 13
    assert long.any() and (texts.longest(a[long], b[long]) == want[long]).all()


def test_documents_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " \t".join(periodic(rng, rng.randrange(0, 200)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (None, "a b " * 9), (3, "É é " * 8), (3, "É é " * 8), (203, "w w " * 20)]
    docs = docs_table(spark, rows, "id runs kept n_words period start").repartition(3)
    got = sorted((tuple(r) for r in digest(word_runs(docs, plant=True)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str)
    assert digest(word_runs(docs.limit(0))).collect() == []


def test_very_long_texts(spark):
    rng = random.Random(1)
    unlike = words(rng, 120_000, 50_000)
    rows = [(1, "again " * 200_000), (2, " ".join(unlike)), (3, " ".join(unlike[:30_000] * 2)), (4, "x" * 3_000_000)]
    out = {r.doc_id: r for r in word_runs(docs_table(spark, rows)).collect()}
    assert [tuple(r) for r in out[1].runs] == [(0, 200_000, 1)] and out[1].kept_text == "again"
    assert out[2].runs == [] and len(out[2].kept_text.split()) == 120_000
    assert (0, 60_000, 30_000) in [tuple(r) for r in out[3].runs]
    assert out[4].kept_text == "x" * 3_000_000 and out[4].n_words == 1
