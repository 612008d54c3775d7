from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from common_llm import docs_table
from tokenizers import Tokenizer

from askahead.llm import packing
from askahead.llm.packing import SumOfSquares
from askahead.llm.queries import token_file

FILE = "byte_bpe_50k.json"


def check(sequences, documents, length):
    """Every id once, sequences gapless and full or a power of two long."""
    parts = defaultdict(dict)
    for _, pieces in sequences:
        total = sum(len(p[2]) // 4 for p in pieces)
        assert total == length or (total < length and total & (total - 1) == 0)
        assert all(p[2] for p in pieces)
        for doc, start, ids, n in pieces:
            assert n == len(documents[doc]) // 4
            assert start not in parts[doc]
            parts[doc][start] = ids
    assert {d: b"".join(p[s] for s in sorted(p)) for d, p in parts.items()} == {d: x for d, x in documents.items() if x}
    assert len({n for n, _ in sequences}) == len(sequences)


@pytest.mark.parametrize(("length", "max_open"), [(8, 4096), (64, 3), (64, 4096), (2048, 50)])
def test_every_id_lies_in_one_piece(length, max_open):
    rng = random.Random(length + max_open)
    packer = SumOfSquares(length, max_open)
    documents = {}
    for d in range(400):
        n = rng.choice([0, 1, length, length + 1, 3 * length, rng.randint(1, 2 * length)])
        documents[d] = np.array([rng.randrange(50_000) for _ in range(n)], "<u4").tobytes()
        packer.add(d, documents[d])
        assert packer.n_open <= max_open
    packer.finish()
    check(packer.take(), documents, length)


def test_levels_are_chosen_by_the_sum_of_squares():
    rng = random.Random(4)
    length = 20
    packer = SumOfSquares(length)

    def cost(counts):
        return sum(int(c) ** 2 for c in counts[1:length])

    for d in range(300):
        size = rng.randint(1, length - 1)
        best = {}
        for level in range(length - size + 1):
            if level and not packer.counts[level]:
                continue
            after = packer.counts.copy()
            after[level] -= bool(level)
            if level + size < length:
                after[level + size] += 1
            best[level] = cost(after)
        assert best[packer.level_for(size)] == min(best.values())
        packer.add(d, b"\1\0\0\0" * size)
        assert [len(x) for x in packer.open[1:]] == packer.counts[1:length].tolist()


def test_exact_fits_are_found():
    packer = SumOfSquares(10)
    for d in range(100):
        packer.add(d, b"\1\0\0\0" * (3 if d % 2 else 7))
    done = packer.take()
    assert len(done) > 40 and packer.n_open < 20


def test_documents_are_packed_whole(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "Bee", "thé", "x1\n"]) for _ in range(rng.choice([0, 3, 60, 3000])))) for i in range(60)]
    rows += [(None, None), (7, "again"), (7, "again"), (200, "日本")]
    docs = docs_table(spark, rows, "id ids start length")
    pieces = packing.pack(docs, token_file(FILE)).collect()
    tk = Tokenizer.from_file(token_file(FILE))
    want = sorted(np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in rows)
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.cumsum([0, *[p.length for p in parts[:-1]]]).tolist()
        total = sum(p.length for p in parts)
        assert total == 2048 or total & (total - 1) == 0
    assert sum(p.length for p in pieces) == sum(map(len, want)) // 4
    one = {i: x for i, x in zip([r[0] for r in rows], [None] * len(rows), strict=True) if i not in (7, None)}
    for i in one:
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert bytes(b"".join(p.ids for p in mine)) in want
        assert {p.doc_tokens for p in mine} == {sum(p.length for p in mine)}
    sums = packing.with_checksums(packing.pack(docs, token_file(FILE)))
    assert sums.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(r.ids_crc32 for r in sums.collect()) == sorted(zlib.crc32(p.ids) for p in pieces)
    assert packing.pack(docs.limit(0), token_file(FILE)).collect() == []
