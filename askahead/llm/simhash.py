"""Near-duplicates by SimHash fingerprints and BK-trees.

Fingerprints within the radius r share at least one of r + 1 bit blocks exactly. So one shard holds the fingerprints
that agree on one block, and its BK-trees find all partners there; no fingerprint meets the rest of the corpus. Large
shards are divided again by blocks of their remaining bits, which loses no partner.

All trees together grow with the corpus, so they are not broadcast from the driver: a shuffle brings each shard to the
task that builds its tree and searches it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askahead.llm.common import stored, text_bytes, with_row_id
from askahead.llm.components import components

BITS, SEED = 64, 42
_BLOCK = 1 << 15
_MAX_MASKS = 400


def fingerprint(text: bytes | None, words_per_shingle: int = 3, distinct: bool = False) -> int:
    """Unsigned 64-bit SimHash of the XXH64 of all word shingles, repeats included; no words give zero.

    A-Z count as lower case, words are separated by ASCII white space. Fewer words than a shingle form one shingle. With
    ``distinct`` each shingle counts once.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    if distinct:
        grams = list({b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)})
        return _majority(grams[at : at + _BLOCK] for at in range(0, len(grams), _BLOCK))
    n = len(words) - k + 1
    return _majority(
        map(b" ".join, zip(*(words[at + i : min(n, at + _BLOCK) + i] for i in range(k)), strict=False))
        for at in range(0, n, _BLOCK)
    )


def _majority(blocks: Iterable[Iterable[bytes]]) -> int:
    """The bits that are set in over half of the hashes."""
    counts, n = np.zeros(BITS, np.int64), 0
    for block in blocks:
        hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in block], "<u8")
        counts += _bit_counts(hashes)
        n += len(hashes)
    return _over_half(counts, n)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of these hashes, each counted once."""
    parts = (_bit_counts(hashes[at : at + _BLOCK]) for at in range(0, len(hashes), _BLOCK))
    return _over_half(sum(parts, np.zeros(BITS, np.int64)), len(hashes))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _over_half(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


@dataclass(frozen=True)
class Likeness:
    """When two documents are linked: their fingerprints of ``words``-word shingles differ in at most ``radius`` bits.

    With ``check_words`` a second fingerprint, of shingles of that many words, must not differ in more than
    ``check_bits``; the cosine it estimates is cos(pi * bits / 64). ``distinct`` holds for both fingerprints.
    """

    words: int = 3
    radius: int = 2
    distinct: bool = False
    check_words: int | None = None
    check_bits: int = 0


def _fingerprints(like: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            prints = [fingerprint(t, like.words, like.distinct) for t in texts]
            checks = [fingerprint(t, like.check_words, like.distinct) if like.check_words else 0 for t in texts]
            columns = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (prints, checks)]
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, *rest], ["fp", "check", *batch.schema.names[1:]])

    return run


def fingerprints(docs: DataFrame, carry: list[str], like: Likeness, text: str = "text") -> DataFrame:
    """(fp, check, carried columns) per document, both fingerprints as signed longs."""
    kinds = (f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    fields = ", ".join(["fp bigint", "check bigint", *kinds])
    return docs.select(text_bytes(text).alias("_text"), *carry).mapInArrow(_fingerprints(like), fields)


class BKTree:
    """Metric tree over 64-bit fingerprints; children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> list[int]:
        """Insert a fingerprint; returns the nodes from the root to its own. Equal fingerprints share a node."""
        path, node = [], 0
        while self.values:
            path.append(node)
            distance = (self.values[node] ^ value).bit_count()
            if distance == 0:
                return path
            below = self.children[node].get(distance)
            if below is None:
                self.children[node][distance] = len(self.values)
                break
            node = below
        self.values.append(value)
        self.children.append({})
        return [*path, len(self.values) - 1]

    def within(self, value: int, radius: int, skip: Callable[[int], bool] = lambda node: False) -> Iterator[int]:
        """Nodes at most ``radius`` away, following only edges that the triangle inequality leaves open.

        Subtrees for whose top node ``skip`` is true when they are reached are left out.
        """
        open_nodes = [0] if self.values else []
        while open_nodes:
            node = open_nodes.pop()
            if skip(node):
                continue
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                yield node
            for edge, below in self.children[node].items():
                if distance - radius <= edge <= distance + radius:
                    open_nodes.append(below)


class Groups:
    """Groups of the members of one shard, joined by searching BK-trees over some of them at a time."""

    def __init__(self, prints: np.ndarray, checks: np.ndarray, like: Likeness) -> None:
        self.prints, self.like = prints, like
        self.values, self.checks = prints.tolist(), checks.tolist()
        self.parent = list(range(len(prints)))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def agree(self, i: int, other: int) -> bool:
        """Whether two members with close fingerprints are linked; asked only while they are in different groups."""
        return (self.checks[other] ^ self.checks[i]).bit_count() <= self.like.check_bits

    def search(self, positions: list[int]) -> None:
        """Link all members at these positions by one tree.

        Subtrees that lie in the group a new member has joined already are not searched, so a dense group costs about
        as much as its number of members.
        """
        tree, root = BKTree(), self.root
        members: list[list[int]] = []
        one_group: list[bool] = []  # all members of the subtree were in the group of its top node when they came
        for i in positions:
            value = self.values[i]

            def settled(node: int, i: int = i) -> bool:
                return one_group[node] and root(members[node][0]) == root(i)

            for node in tree.within(value, self.like.radius, settled):
                for other in members[node]:
                    a, b = root(i), root(other)
                    if a != b and self.agree(i, other):
                        self.parent[max(a, b)] = min(a, b)
            *above, node = tree.add(value)
            if node == len(members):
                members.append([])
                one_group.append(True)
            for top in [*above, node]:
                one_group[top] = one_group[top] and (not members[top] or root(members[top][0]) == root(i))
            members[node].append(i)

    def link(self, positions: np.ndarray, mask: int, max_tree: int) -> None:
        """Link the members at these positions, which agree on the bits of ``mask``.

        More than ``max_tree`` are divided by further blocks first. Where a block does not tell them apart, as among
        copies of one text, they stay together, as that is what the tree's own shortcut is for.
        """
        if len(positions) > max_tree:
            parts = []
            for deeper in divide(mask, self.like.radius):
                value = self.prints[positions] & np.uint64(deeper)
                order = np.argsort(value, kind="stable")
                cuts = np.flatnonzero(np.diff(value[order])) + 1
                runs = [r for r in np.split(positions[order], cuts) if len(r) > 1]
                if max(map(len, runs), default=0) * 2 > len(positions):
                    break
                parts += [(r, deeper) for r in runs]
            else:
                for run, deeper in parts:
                    self.link(run, deeper, max_tree)
                return
        self.search(positions.tolist())

    def stars(self) -> list[tuple[int, int]]:
        """(member, first member of its group), as positions, for all but the first."""
        return [(i, r) for i in range(len(self.parent)) if (r := self.root(i)) != i]


def shard_links(prints: np.ndarray, checks: np.ndarray, like: Likeness, mask: int, max_tree: int) -> list[tuple[int, int]]:
    """(member, first member of its group) for the linked members of one shard, as positions."""
    groups = Groups(prints, checks, like)
    groups.link(np.arange(len(prints)), mask, max_tree)
    return groups.stars()


def shard_stars(like: Likeness, max_tree: int):
    """Groups of rows sorted by shard (mask, value); a shard that crosses a batch border is carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: np.ndarray) -> pa.RecordBatch:
            changes = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
            starts, ends = np.append(0, changes), np.append(changes, rows.shape[1])
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in np.flatnonzero(ends - starts > 1):
                prints, checks = np.ascontiguousarray(rows[2:, starts[i] : ends[i]]).view(np.uint64)
                mask = int(rows[0, starts[i]]) & ((1 << BITS) - 1)
                pairs = np.array(shard_links(prints, checks, like, mask, max_tree), np.int64).reshape(-1, 2) + starts[i]
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
            sides = [rows[2:, np.concatenate(x)] for x in (a, b)]
            columns = [pa.array(c) for side in sides for c in side]
            return pa.RecordBatch.from_arrays(columns, ["fp", "check", "fp2", "check2"])

        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            if not rows.size:
                continue
            # All up to the last change of shard is complete.
            last = np.flatnonzero((rows[:2] != rows[:2, -1:]).any(axis=0))
            cut = last[-1] + 1 if last.size else 0
            if held and (cut or (held[-1][:2, -1] != rows[:2, 0]).any()):
                yield links(np.concatenate([*held, rows[:, :cut]], axis=1))
                held = []
            elif cut:
                yield links(rows[:, :cut])
            held.append(rows[:, cut:])
        if held:
            yield links(np.concatenate(held, axis=1))

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def divide(mask: int, radius: int) -> list[int]:
    """Masks that add one of radius + 1 blocks of the bits not yet in ``mask``."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    blocks = np.array_split(np.array(free), radius + 1)
    return [mask | sum(1 << int(i) for i in block) for block in blocks]


def shards(distinct: DataFrame, radius: int, max_shard: int) -> DataFrame:
    """(mask, value, fp, check): every fingerprint once per shard; two within the radius meet in one shard at least.

    A shard is the set of fingerprints that agree on the bits of a mask. Shards above ``max_shard`` go on to longer
    masks, until the masks leave so few bits free that none can be larger, or number ``_MAX_MASKS``.
    """
    masks = divide(0, radius)
    value = F.col("fp").bitwiseAND(F.col("mask"))
    rows = distinct.select("fp", "check", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    done = []
    while True:
        rows = rows.select("mask", value.alias("value"), "fp", "check")
        if len(masks) > _MAX_MASKS or all(1 << (BITS - m.bit_count()) <= max_shard for m in masks):
            break
        large = stored(rows.groupBy("mask", "value").count().where(F.col("count") > max_shard), "large_shards")
        if large.isEmpty():
            break
        marked = rows.join(large, ["mask", "value"], "left")
        done.append(marked.where(F.col("count").isNull()).select("mask", "value", "fp", "check"))
        children = {m: divide(m, radius) for m in masks}
        entries = [
            x for m, c in children.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(y)) for y in c)))
        ]
        deeper = F.explode(F.create_map(*entries)[F.col("mask")]).alias("mask")
        rows = stored(marked.where(F.col("count").isNotNull()).select("fp", "check", deeper), "divided_shards")
        masks = sorted({y for c in children.values() for y in c})
    return reduce(DataFrame.union, [*done, rows])


def near_groups(
    docs: DataFrame,
    carry: list[str] | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    like: Likeness | None = None,
    max_tree: int = 256,
    max_shard: int = 200_000,
) -> DataFrame:
    """(id, fingerprint, component_id, root, carried columns): one row per document.

    Documents are linked as ``like`` says; ``component_id`` is the smallest id reachable over links, itself included,
    and ``root`` names the component also where ids are null. Null and empty texts have no words and the fingerprint
    zero, which is linked like any other. Null ids are passed over for ``component_id``, which is null where a component
    has no other. Repeated rows stay repeated. Other columns of ``docs`` are ignored. An empty table gives an empty one.

    Shards above ``max_shard`` are dealt anew by more bits; within its task, a shard above ``max_tree`` is searched by
    several trees. Neither changes the result.
    """
    like = like or Likeness()
    carry = [c for c in carry or [] if c != id_col]
    key = ["fp", "check"]
    prints = stored(fingerprints(docs, [id_col, *carry], like, text), "fingerprints")
    nodes = prints.groupBy(*key).agg(F.min(id_col).alias("_first"))

    def digits(c: str) -> F.Column:
        return F.lower(F.lpad(F.hex(c), BITS // 4, "0"))

    def node(fp: str, check: str) -> F.Column:
        return F.concat(digits(fp), digits(check)) if like.check_words else F.col(fp)

    links = (
        shards(nodes.select(*key), like.radius, max_shard)
        .repartition("mask", "value")
        .sortWithinPartitions("mask", "value", *key)
        .mapInArrow(shard_stars(like, max_tree), "fp bigint, check bigint, fp2 bigint, check2 bigint")
    )
    # Each shard has sent a star per group instead of all its pairs; stars are joined to components here.
    roots = components(links.select(node(*key).alias("a"), node("fp2", "check2").alias("b")))
    nodes = nodes.withColumn("node", node(*key)).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = stored(nodes, "nodes")
    # Stored, so that adaptive execution can split the join where one component owns much of the corpus.
    smallest = stored(nodes.groupBy("root").agg(F.min("_first").alias("component_id")), "smallest_ids")
    named = nodes.join(smallest, "root").select(*key, "component_id", F.col("root").cast("string").alias("root"))
    return prints.join(named, key).select(id_col, digits("fp").alias("fingerprint"), "component_id", "root", *carry)


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id, nulls last, of equal ids any one."""
    numbered, rid = with_row_id(docs)
    groups = stored(near_groups(numbered, [rid], id_col, **options), "near_groups")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(rid).alias("row"))
    best = groups.groupBy("root").agg(F.min(order).alias("b")).select(F.col("b.row").alias(rid))
    # Most rows stay, so their numbers grow with the corpus: one and the same plan at every size.
    return numbered.join(best.hint("merge"), rid, "left_semi").select(docs.columns)
