from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from common_llm import docs_table, groups_of, words

from askahead.llm import simhash
from askahead.llm.components import components
from askahead.llm.simhash import BKTree, Likeness


def plain_fingerprint(text, k=3):
    found = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate(
        {ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    if not found:
        return 0
    k = min(k, len(found))
    hashes = [xxhash.xxh64(" ".join(found[i : i + k]).encode(), seed=42).intdigest() for i in range(len(found) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize(
    "text",
    [None, "", "  \n ", "One", "one TWO", "a b c", "a b c a b c a b", "É é\x85x\xa0y Z", "x\ty\x0bz\x0cq\rr\x1cs", "w " * 300],
)
def test_fingerprints_follow_the_definition(text):
    raw = None if text is None else text.encode()
    assert simhash.fingerprint(raw) == plain_fingerprint(text)


def test_long_texts_are_hashed_whole(monkeypatch):
    text = " ".join(words(random.Random(1), 5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_BLOCK", 64)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def near(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("radius", [0, 2, 6])
def test_trees_find_all_within_the_radius(radius):
    rng = random.Random(radius)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [near(rng, rng.choice(values), rng.randint(0, 8)) for _ in range(200)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    assert len(tree.values) == len(set(values))
    for v in values[:40] + [rng.getrandbits(64)]:
        found = {tree.values[i] for i in tree.within(v, radius)}
        assert found == {x for x in values if (x ^ v).bit_count() <= radius}


@pytest.mark.parametrize("like", [Likeness(), Likeness(radius=6, check_words=5, check_bits=13)])
def test_shard_links_join_all_groups(like):
    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(20)]
    checks = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(300):
        i = rng.randrange(len(prints))
        prints.append(near(rng, prints[i], rng.randint(0, 7)))
        checks.append(near(rng, checks[i], rng.randint(0, 16)))
    if not like.check_words:
        checks = [0] * len(prints)
    n = len(prints)
    links = [
        (i, j) for i in range(n) for j in range(i)
        if (prints[i] ^ prints[j]).bit_count() <= like.radius and (checks[i] ^ checks[j]).bit_count() <= like.check_bits
    ]
    for max_tree in (1000, 20, 1):
        stars = simhash.shard_links(np.array(prints, np.uint64), np.array(checks, np.uint64), like, 0, max_tree)
        assert groups_of(n, stars) == groups_of(n, links)


def test_masks_cover_all_bits():
    for radius in (2, 6):
        masks = simhash.divide(0, radius)
        assert len(masks) == radius + 1
        assert sum(masks) == (1 << 64) - 1
        assert all(m & masks[0] == masks[0] for m in simhash.divide(masks[0], radius))


def corpus(seed, n):
    rng = random.Random(seed)
    rows = [(i, " ".join(words(rng, rng.choice([0, 1, 2, 30, 200])))) for i in range(n)]
    for i in range(n, 2 * n):
        base = rng.choice(rows)[1].split(" ")
        if rng.random() < 0.7:
            base[rng.randrange(len(base))] = rng.choice(["w1", "W7", ""])
        rows.append((i, " ".join(base)))
    return rows


def test_dense_groups_are_not_searched_pair_by_pair():
    rng = random.Random(4)
    center = rng.getrandbits(64)
    prints = list({near(rng, center, rng.randint(0, 3)) for _ in range(6000)})
    groups = simhash.Groups(np.array(prints, np.uint64), np.zeros(len(prints), np.uint64), Likeness(radius=6))
    steps = 0
    counted = groups.root

    def root(i):
        nonlocal steps
        steps += 1
        return counted(i)

    groups.root = root
    groups.link(np.arange(len(prints)), 0, 256)
    assert len(groups.stars()) == len(prints) - 1
    assert steps < 100 * len(prints)


@pytest.mark.parametrize(("max_tree", "max_shard"), [(256, 200_000), (3, 200_000), (3, 4)])
def test_groups_equal_brute_force(spark, max_tree, max_shard):
    rows = corpus(3, 80)
    rng = random.Random(5)
    rng.shuffle(rows)
    got = {r.doc_id: r for r in simhash.near_groups(docs_table(spark, rows), max_tree=max_tree, max_shard=max_shard).collect()}
    rows.sort()
    prints = [plain_fingerprint(t) for _, t in rows]
    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert [got[i].fingerprint for i, _ in rows] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i, _ in rows] == groups_of(n, links)


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (None, " \n"), (7, "same words here and there"), (7, "same words here and there"),
            (None, "nobody else says this"), (9, "x" * 100_000)]
    docs = docs_table(spark, rows, "fp check root mask value component_id")
    got = sorted((str(r.doc_id), r.fingerprint == "0" * 16, r.component_id) for r in simhash.near_groups(docs).collect())
    assert got == [("3", True, 3), ("5", True, 3), ("7", False, 7), ("7", False, 7), ("9", False, 9), ("None", False, None),
                   ("None", True, 3)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "9", "None"]
    assert simhash.near_groups(docs.limit(0)).collect() == [] == simhash.keep_one(docs.limit(0)).collect()


def test_a_second_fingerprint_tells_apart_what_the_first_cannot(spark):
    rng = random.Random(2)
    text = words(rng, 300)
    close = [*text[:150], "other", *text[151:]]
    shuffled = sorted(text)  # the same words in another order
    rows = [(1, " ".join(text)), (2, " ".join(close)), (3, " ".join(shuffled))]
    like = Likeness(words=1, radius=6, distinct=True, check_words=5, check_bits=13)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs_table(spark, rows), like=like).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_passages_repeated_in_one_copy_do_not_part_it_from_the_other(spark):
    rng = random.Random(6)
    text = words(rng, 200)
    rows = [(1, " ".join(text)), (2, " ".join(text + text[:40] * 30))]  # five-word sets that differ by one seam
    like = Likeness(words=1, radius=6, distinct=True, check_words=5, check_bits=13)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs_table(spark, rows), like=like).collect()}
    assert got == {1: 1, 2: 1}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "strings", "none"])
def test_components(spark, kind):
    rng = random.Random(11)
    links = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(30, i) for i in range(60)] + [(5, 5)],
        "random": [(rng.randrange(100), rng.randrange(100)) for _ in range(60)],
        "strings": [(1, 2), (2, 3), (7, 9), (9, 7)],
        "none": [],
    }[kind]
    rng.shuffle(links)
    name = (lambda i: f"n{i:03d}") if kind == "strings" else (lambda i: i)
    schema = "a string, b string" if kind == "strings" else "a bigint, b bigint"
    got = {r.node: r.root for r in components(spark.createDataFrame([(name(a), name(b)) for a, b in links], schema)).collect()}
    roots = groups_of(101, links)
    assert got == {name(i): name(roots[i]) for i in {x for a, b in links if a != b for x in (a, b)}}
