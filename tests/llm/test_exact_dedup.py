from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from common_llm import docs_table

from askahead.llm import exact_dedup
from askahead.llm.cuckoo import CuckooIndex


def digest(i):
    return hashlib.sha256(str(i).encode()).digest()


@pytest.mark.parametrize("buckets", [1, 2, 64])
def test_index_behaves_like_a_dictionary(buckets):
    rng = random.Random(buckets)
    index, known = CuckooIndex(buckets), {}
    for _ in range(6000):
        d = digest(rng.randrange(1500))
        if d in known:
            assert index.find(d) == known[d]
            if rng.random() < 0.4:
                assert index.delete(d)
                del known[d]
        else:
            assert index.find(d) == -1 and not index.delete(d)
            known[d] = index.insert(d)
        assert len(index) == len(known)
    assert all(index.find(d) == ref for d, ref in known.items())
    assert len(set(known.values())) == len(known)


def test_equal_prints_are_told_apart_by_their_keys():
    index = CuckooIndex(4)
    same = [(7).to_bytes(8, "little") + bytes([i]) for i in range(6)]  # one print, one pair of buckets
    for d in same:
        index.insert(d)
    assert len({index.find(d) for d in same}) == 6
    assert index.delete(same[2]) and index.find(same[2]) == -1 and index.find(same[3]) >= 0


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        out.append((i, max(ids, default=None), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("per_task", [500_000, 3])
def test_equals_brute_force(spark, per_task):
    rng = random.Random(per_task)
    texts = ["Same", "sAME", "É", "é", "", None, " same", "x\ny", "long " * 3000] + [f"own {i}" for i in range(30)]
    rows = [(i, "COPY" if rng.random() < 0.4 else rng.choice(texts)) for i in range(200)]
    rng.shuffle(rows)
    df = exact_dedup.exact_groups(docs_table(spark, rows).repartition(5), digests_per_task=per_task)
    assert got(df) == brute(rows)
    kept = [r for r in df.collect() if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len({r.text_sha256 for r in kept}) == len(kept) == len({lower(t) for _, t in rows})


def test_odd_rows(spark):
    rows = [(None, "a"), (None, "A"), (3, "b"), (3, "B"), (1, "b"), (None, "b"), (7, None), (6, "")]
    docs = docs_table(spark, rows, "sha id keep_id group_size _rid kept")
    assert got(exact_dedup.exact_groups(docs)) == brute(rows)
    kept = exact_dedup.keep_last(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "None"]
    assert exact_dedup.exact_groups(docs.limit(0)).collect() == [] == exact_dedup.keep_last(docs.limit(0)).collect()
