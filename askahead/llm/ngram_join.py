"""Similarity join on word n-grams: documents whose sets of shingles have a Jaccard similarity of at least a threshold.

Prefix filtering: if a set of n shingles shares o of them with another, the first c common ones are among its first
n - o + c, under *any* order of all shingles. Several orders are used one after the other, with a growing c. Each puts
frequent shingles last (by a table of counts with a fixed number of cells) and breaks ties by a permutation of its own.
Sets that share a prefix shingle under the first order are joined to components of candidates. Under the next orders only
sets of one component are compared. Under each order a set leaves if fewer than about c of its prefix shingles occur in
another, and the rest are joined to smaller components. No pair is written in
that: a shingle links its sets to one of them, first within an Arrow batch, so that even a shingle of most documents
arrives once per batch.

Components that are still large, as among texts made of a few common passages, are divided by orders with exact counts:
shingles are counted within the component, and sets are joined by their rarest ones only, until that divides no more.

Links are then verified in cells. A component of bounded size is one cell: a pair is compared if it shares prefix
shingles under every order, its sizes allow the threshold and it is not in one group yet. A larger component is dealt to
blocks and meets some of its sets, the pivots, in each block. Pivots are added until all sets outside the component's
largest group have been pivots; every link then joins two sets of one group, or has been compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askahead.llm.common import prepare, stored, text_bytes
from askahead.llm.components import components
from askahead.llm.decontaminate import BITMAP_BITS, hash_bitmap

SEED = 42
# Cells of the table of counts; its size does not depend on the corpus.
COUNT_BITS = 18


@dataclass(frozen=True)
class Threshold:
    """Sets link when ``of`` * intersection >= ``shared`` * union; shingles have ``words`` words.

    Each order of ``common`` asks for so many percent of a set's shingles in common, in a prefix longer by as many.
    """

    words: int = 5
    shared: int = 80
    of: int = 100
    common: tuple[int, ...] = (10, 40, 80)

    def overlap(self, n: int) -> int:
        """The least number of shingles that a set of n shares with any set like it."""
        return -(-self.shared * n // self.of)

    def need(self, n: int, order: int) -> int:
        """How many common shingles the prefix of a set of n is long enough for; never less for a larger set."""
        return min(max(1, self.common[order] * n // 100), self.overlap(n))

    def least(self, n: int, order: int) -> int:
        """How many of them the prefix of any set like it holds, too.

        A smaller set's prefix is shorter, but it must share as many of its fewer shingles. With rounding, the prefix of
        either holds two less than the other's size asks for, as long as ``common`` is not above the threshold.
        """
        return max(1, self.need(n, order) - 2)

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both * self.of >= (len(a) + len(b) - both) * self.shared


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted hashes of the different shingles; fewer words than a shingle form one, no words none."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    k = min(words, len(parts))
    grams = set(map(b" ".join, zip(*(parts[i:] for i in range(k)), strict=False)))
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))


def _as_hashes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


# Of a text: its id, the digest of its set and the set's size. Of a task: how many shingles fell in each cell of the table
# of counts, one row per chunk of the table.
_PRINTS = "digest binary, key bigint, size bigint, chunk int, counts binary"
_CHUNK = 1 << 12


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "key", "size", "chunk", "counts"]
        counts, schema = np.zeros(1 << COUNT_BITS, np.int64), None
        for batch in batches:
            schema = batch.schema
            sets = [shingles(text, words) for text in batch.column(0).to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            columns = [
                pa.array(digests, pa.binary()),
                pa.array([_key(d) for d in digests], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.nulls(len(sets), pa.int32()),
                pa.nulls(len(sets), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], [*names, "id"])
            flat = np.concatenate([np.empty(0, np.uint64), *sets])
            np.add.at(counts, (flat >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
        if schema is not None:
            chunks = counts.reshape(-1, _CHUNK)
            n = len(chunks)
            empty = [pa.nulls(n, kind) for kind in (pa.binary(), pa.int64(), pa.int64())]
            packed = pa.array([c.tobytes() for c in chunks], pa.binary())
            rows = [*empty, pa.array(np.arange(n, dtype=np.int32)), packed, pa.nulls(n, schema.field(1).type)]
            yield pa.RecordBatch.from_arrays(rows, [*names, "id"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(raw, np.int64)
    packed = [np.log2(np.maximum(c, 1)).astype(np.uint8).tobytes() for c in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "classes"])


def frequency_classes(prints: DataFrame) -> np.ndarray:
    """The binary logarithm of the number of shingles in each cell of the table, over all documents."""
    chunks = prints.where("chunk is not null").select("chunk", "counts").repartition("chunk")
    rows = chunks.mapInArrow(_add_up, "chunk int, classes binary").collect()  # 2 ** COUNT_BITS bytes, whatever the table
    classes = np.zeros((1 << COUNT_BITS) // _CHUNK * _CHUNK, np.uint8).reshape(-1, _CHUNK)
    for row in rows:
        classes[row["chunk"]] = np.frombuffer(row["classes"], np.uint8)
    return classes.ravel()


class Orders:
    """Several total orders of shingles; all put those of a higher frequency class later."""

    def __init__(self, classes: np.ndarray, threshold: Threshold) -> None:
        self.classes, self.threshold = classes, threshold
        draw = np.random.default_rng(SEED).integers(1 << 63, size=len(threshold.common), dtype=np.uint64)
        self.factors = draw * np.uint64(2) + np.uint64(1)

    def prefix(self, hashes: np.ndarray, order: int, need: int = 1) -> np.ndarray:
        """The first shingles under one order, enough to hold the first ``need`` that it shares with a set like it.

        Equal places are taken in the order of the hashes.
        """
        rank = self.classes[hashes >> np.uint64(64 - COUNT_BITS)].astype(np.uint64) << np.uint64(58)
        rank |= (hashes * self.factors[order]) >> np.uint64(6)
        return hashes[np.argsort(rank, kind="stable")[: len(hashes) - self.threshold.overlap(len(hashes)) + need]]

    def first(self, hashes: np.ndarray, order: int) -> np.ndarray:
        """The prefix that this order looks at."""
        return self.prefix(hashes, order, self.threshold.need(len(hashes), order))


def _known(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which keys have their bit set."""
    place = keys.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


# A row of a shingle has the set that stands for it in a batch, and the set again as its head if others there share the
# shingle. A row with a count says how many shingles link a set to a head.
_STARS = "token bigint, key bigint, head bigint, n int"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _pair_counts(key: np.ndarray, head: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different (key, head) with the sum of its weights."""
    order = np.lexsort((head, key))
    key, head, weight = key[order], head[order], weight[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (head[1:] != head[:-1])))
    return key[first], head[first], np.add.reduceat(weight, first).astype(np.int32)


def _stars(tokens: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of all shingles of a batch, and counts of the links within it."""
    order = np.lexsort((keys, tokens))
    tokens, keys = tokens[order], keys[order]
    different = np.append(True, (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1]))
    tokens, keys = tokens[different], keys[different]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    sizes = np.diff(np.append(first, len(tokens)))
    shared, n = sizes > 1, len(first)
    heads = pa.array(keys[first], mask=~shared)
    rows = [pa.array(tokens[first].view(np.int64)), pa.array(keys[first]), heads, pa.nulls(n, pa.int32())]
    yield pa.RecordBatch.from_arrays(rows, ["token", "key", "head", "n"])
    inside = np.repeat(shared, sizes)
    if inside.any():
        key, head, n = _pair_counts(keys[inside], np.repeat(keys[first], sizes)[inside], np.ones(inside.sum(), np.int32))
        spread = (key.view(np.uint64) * _MIX).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (spread, key, head, n)], ["token", "key", "head", "n"])


def _stars_of_texts(orders: Orders):
    """Texts to rows of their sets under the first order, by the keys of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {}
            for text in batch.column(0).to_pylist():
                found = shingles(text, orders.threshold.words)
                if len(found):
                    sets.setdefault(_key(xxhash.xxh3_128_digest(found.tobytes())), found)
            if sets:
                parts = [orders.first(s, 0) for s in sets.values()]
                keys = np.repeat(np.array(list(sets), np.int64), [len(p) for p in parts])
                yield from _stars(np.concatenate(parts), keys)

    return run


def _stars_of_sets(orders: Orders, order: int):
    """Rows (key, component, hashes) to rows under an order; shingles of different components differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [orders.first(_as_hashes(raw), order) for raw in batch.column(2).to_pylist()]
            if parts:
                sizes = [len(p) for p in parts]
                comp = np.repeat(batch.column(1).to_numpy().view(np.uint64) * _MIX, sizes)
                tokens = (np.concatenate(parts) ^ (comp ^ comp >> np.uint64(29))) * _MIX
                yield from _stars(tokens, np.repeat(batch.column(0).to_numpy(), sizes))

    return run


def _links_to_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shingle and set to (key, head, n): how many shingles link a set to a head."""
    names = ["key", "head", "n"]
    # The first set of the last shingle; what follows may share it.
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
    for batch in batches:
        counted = batch.column(3).is_valid()
        links = batch.filter(counted)
        if links.num_rows:
            yield pa.RecordBatch.from_arrays(links.columns[1:], names)
        rows = batch.filter(pa.compute.invert(counted))
        if not rows.num_rows:
            continue
        fresh = [rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).is_valid().to_numpy(zero_copy_only=False)]
        token, key, done = (np.concatenate(x) for x in zip(held, fresh, strict=True))
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        sizes = np.diff(np.append(first, len(token)))
        head = np.repeat(key[first], sizes)
        # Rows come in the order of their sets, so that a shingle of one set has that set first and last.
        last = key[first + sizes - 1]
        inside = np.repeat(last != key[first], sizes)
        if inside.any():
            columns = _pair_counts(key[inside], head[inside], (~done[inside]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
        known = done[first[-1]] or bool(inside[-1])
        held = [token[-1:], key[first[-1:]], np.array([known])]


def _divided(stars: DataFrame, sizes: DataFrame, threshold: Threshold, order: int) -> DataFrame:
    """(key, comp) of the sets that share enough shingles; ``sizes`` has (key, size)."""
    links = (
        stars.repartition("token")
        .sortWithinPartitions("token", "key")
        .mapInArrow(_links_to_heads, "key bigint, head bigint, n int")
    )
    links = stored(links, "links_to_heads")
    # The same as Threshold.least.
    overlap = f"(size * {threshold.shared} + {threshold.of - 1}) div {threshold.of}"
    need = F.expr(f"greatest(1, least(size * {threshold.common[order]} div 100, {overlap}) - 2)")
    common = links.groupBy("key").agg(F.sum("n").alias("n")).join(sizes, "key")
    kept = stored(common.where(F.col("n") >= need).select("key").distinct(), "kept_sets")
    # A head may have left itself; it still stands for the shingle.
    edges = links.join(kept, "key", "left_semi").select(F.col("key").alias("a"), F.col("head").alias("b"))
    roots = components(edges).select(F.col("node").alias("key"), F.col("root").alias("comp"))
    return roots.join(kept, "key", "left_semi")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, component, hashes) to a row per shingle."""
    for batch in batches:
        raw = batch.column(2).to_pylist()
        if raw:
            sizes = np.array([len(r) // 8 for r in raw])
            key, comp = (np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1))
            columns = [key, comp, _as_hashes(b"".join(raw)).view(np.int64), np.repeat(sizes, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "comp", "token", "size"])


def _large(comps: DataFrame, sizes: DataFrame, max_cell: int) -> DataFrame:
    """(key, comp, size) of the components with more shingles than a cell holds."""
    sized = comps.join(sizes, "key")
    large = sized.groupBy("comp").agg(F.sum("size").alias("n")).where(F.col("n") > max_cell).select("comp")
    return stored(sized.join(large, "comp"), "large_components")


def _divided_by_counts(sets: DataFrame, comps: DataFrame, threshold: Threshold) -> DataFrame:
    """(key, comp): components divided by the order of the number of sets in the component that have a shingle."""
    rows = sets.select("key", "hashes").join(comps.select("key", "comp"), "key").select("key", "comp", "hashes")
    rows = rows.mapInArrow(_tokens, "key bigint, comp bigint, token bigint, size bigint")
    counts = rows.groupBy("comp", "token").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("n", "token"))
    length = F.expr(f"size - (size * {threshold.shared} + {threshold.of - 1}) div {threshold.of} + 1")
    # Stored, so that adaptive execution can split the join at shingles that very many sets share.
    placed = rows.join(stored(counts, "shingle_counts"), ["comp", "token"]).withColumn("_nth", first)
    placed = stored(placed.where((F.col("_nth") <= length) & (F.col("n") > 1)).select("key", "comp", "token"), "rarest")
    heads = placed.groupBy("comp", "token").agg(F.min("key").alias("head"))
    edges = placed.join(stored(heads, "heads"), ["comp", "token"]).select(F.col("key").alias("a"), F.col("head").alias("b"))
    return components(edges.where("a <> b")).select(F.col("node").alias("key"), F.col("root").alias("comp"))


def _candidate_sets(words: int, bitmap: np.ndarray):
    """Texts to (digest, hashes) of sets whose key may be a candidate's, each once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {}
            for text in batch.column(0).to_pylist():
                raw = shingles(text, words).tobytes()
                sets[xxhash.xxh3_128_digest(raw)] = raw
            keys = np.array([_key(d) for d in sets], np.int64)
            rows = [pa.array(list(c), pa.binary()) for c in (sets.keys(), sets.values())]
            yield pa.RecordBatch.from_arrays(rows, ["digest", "hashes"]).filter(pa.array(_known(keys, bitmap)))

    return run


class Postings:
    """Pairs of sets of a cell that share a shingle in their prefixes under one order."""

    def __init__(self, prefixes: list[np.ndarray], pivots: int) -> None:
        tokens, sizes = np.concatenate(prefixes), [len(p) for p in prefixes]
        order = np.argsort(tokens, kind="stable")
        self.members = np.repeat(np.arange(len(prefixes)), sizes)[order]
        self.ends = np.append(0, np.cumsum(sizes))
        asked, tokens = tokens[: self.ends[pivots]], tokens[order]
        self.low = np.searchsorted(tokens, asked, "left")
        self.hits = np.searchsorted(tokens, asked, "right") - self.low

    def pairs(self, start: int, end: int) -> np.ndarray:
        """Sorted (pivot * members + member), each once, of the pivots from ``start`` to ``end``."""
        part = slice(self.ends[start], self.ends[end])
        low, hits = self.low[part], self.hits[part]
        pivot = np.repeat(np.arange(start, end), np.diff(self.ends[start : end + 1]))
        at = np.repeat(low - np.append(0, np.cumsum(hits)[:-1]), hits) + np.arange(hits.sum())
        return np.unique(np.repeat(pivot, hits) * (len(self.ends) - 1) + self.members[at])


def cell_links(
    sets: list[np.ndarray], groups: np.ndarray, pivots: int, orders: Orders, at_once: int = 1 << 20
) -> list[tuple[int, int]]:
    """Links between the first ``pivots`` sets and all sets, as positions; enough of them to join every linked pair.

    ``groups`` are labels of sets that are joined already. About ``at_once`` common shingles are expanded at a time.
    """
    n, threshold = len(sets), orders.threshold
    sizes = np.array([len(s) for s in sets])
    label = np.unique(groups, return_inverse=True)[1]
    postings = [Postings([orders.prefix(s, k) for s in sets], pivots) for k in range(len(threshold.common))]
    cost = np.append(0, np.cumsum(postings[0].hits))[postings[0].ends[: pivots + 1]]
    links, start = [], 0
    while start < pivots:
        end = max(start + 1, int(np.searchsorted(cost, cost[start] + at_once, "right")) - 1)
        pairs = postings[0].pairs(start, end)
        for order in [None, *postings[1:]]:
            if order is not None:
                pairs = np.intersect1d(pairs, order.pairs(start, end), assume_unique=True)
            i, j = pairs // n, pairs % n
            fits = np.minimum(sizes[i], sizes[j]) * threshold.of >= np.maximum(sizes[i], sizes[j]) * threshold.shared
            pairs = pairs[(j > i) & (label[i] != label[j]) & fits]
            if not len(pairs):
                break
        for i, j in zip((pairs // n).tolist(), (pairs % n).tolist(), strict=True):
            if label[i] != label[j] and threshold.similar(sets[i], sets[j]):
                links.append((i, j))
                label[label == label[j]] = label[i]
        start = end
    return links


def _cells(orders: Orders):
    """Links within each cell; rows (comp, block, pivot, node, grp, hashes) come sorted, pivots first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, members in groupby(rows, key=lambda r: r[:2]):
            pivots, nodes, groups, sets = 0, [], [], []
            for _, _, pivot, node, group, raw in members:
                pivots += pivot
                nodes.append(node)
                groups.append(group)
                sets.append(_as_hashes(raw))
            found = cell_links(sets, np.array(groups), pivots, orders)
            sides = [pa.array([nodes[x[side]] for x in found], pa.int64()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays(sides, ["a", "b"])

    return run


def verified(members: DataFrame, sets: DataFrame, orders: Orders, max_cell: int) -> DataFrame:
    """(a, b): links that join the same nodes as all links between nodes of one component do.

    ``members`` has (node, comp, size), ``sets`` (node, hashes).
    """
    sizes = members.groupBy("comp").agg(F.ceil(F.sum("size") / max_cell).cast("int").alias("blocks"), F.count("*").alias("n"))
    sizes = stored(sizes.where("n > 1").select("comp", "blocks"), "blocks")
    members = stored(members.join(sizes, "comp").select("node", "comp", "blocks"), "members")

    def links(cells: DataFrame) -> DataFrame:
        rows = (
            cells.join(sets, "node")
            .select("comp", "block", "pivot", "node", "grp", "hashes")
            .repartition("comp", "block")
            .sortWithinPartitions("comp", "block", F.desc("pivot"), "node")
        )
        return rows.mapInArrow(_cells(orders), "a bigint, b bigint")

    small = members.where("blocks = 1").select(
        "comp", F.lit(0).alias("block"), F.lit(True).alias("pivot"), "node", F.col("node").alias("grp")
    )
    found = stored(links(small), "links")
    large = stored(
        members.where("blocks > 1").select("*", F.col("node").alias("grp"), F.lit(False).alias("done")), "large_components"
    )
    wanted = 16
    while True:
        # All sets outside the largest group of their component have to be pivots once.
        groups = large.groupBy("comp", "grp").agg(F.count("*").alias("n"))
        largest = groups.groupBy("comp").agg(F.max_by("grp", F.struct("n", "grp")).alias("largest"))
        waiting = F.col("grp") != F.col("largest")
        marked = large.join(stored(largest, "largest_groups"), "comp").withColumn("waits", waiting & ~F.col("done"))
        left = marked.where("waits").groupBy("comp").agg(F.count("*").alias("left"))
        left = stored(left, "waiting")
        if left.isEmpty():
            return found
        share = F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(1 << 30)) / float(1 << 30)
        chosen = F.col("waits") & (share * F.col("left") < wanted)
        marked = stored(marked.join(left, "comp").withColumn("chosen", chosen), "marked")
        blocks = F.pmod(F.xxhash64(F.lit(SEED + 1), "node"), F.col("blocks")).cast("int")
        own = marked.where("not chosen").select("comp", blocks.alias("block"), F.lit(False).alias("pivot"), "node", "grp")
        everywhere = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        pivots = marked.where("chosen").select("comp", everywhere, F.lit(True).alias("pivot"), "node", "grp")
        new = stored(links(own.union(pivots)), "links")
        found = found.union(new)
        roots = components(new.union(large.select(F.col("node").alias("a"), F.col("grp").alias("b"))))
        state = marked.select("node", "comp", "blocks", (F.col("done") | F.col("chosen")).alias("done"), "grp")
        regrouped = state.join(roots, "node", "left").withColumn("grp", F.coalesce("root", "grp")).drop("root")
        large = stored(regrouped.select("node", "comp", "blocks", "grp", "done"), "large_components")
        wanted *= 4


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    threshold: Threshold | None = None,
    max_cell: int = 1 << 20,
) -> DataFrame:
    """(id, n_shingles, component_id): one row per document, repeated rows included.

    Words are separated by ASCII white space, A-Z count as lower case. ``n_shingles`` is the size of a document's set of
    shingles; a text of fewer words is one shingle, null, empty and blank texts have none and are linked with nothing.
    ``component_id`` is the smallest id reachable over links, itself included; null ids are passed over for it, and it is
    null where a component has no other. Texts of any length are read whole, as sorted hashes of 8 bytes per shingle.
    Other columns of ``docs`` are ignored. An empty table gives an empty one.

    ``max_cell`` is the number of shingles that a task verifies at a time; it does not change the result.
    """
    threshold = threshold or Threshold()
    prepare(docs.sparkSession)
    texts = docs.select(text_bytes(text).alias("_text"))
    rows = docs.select(text_bytes(text).alias("_text"), F.col(id_col).alias("id"))
    kind = docs.schema[id_col].dataType.simpleString()
    prints = stored(rows.mapInArrow(_prints(threshold.words), f"{_PRINTS}, id {kind}"), "shingle_prints")
    orders = Orders(frequency_classes(prints), threshold)
    prints = prints.where("chunk is null").drop("chunk", "counts")
    # Equal sets are one node. Numbers are given once, as the table is stored.
    nodes = prints.where("size > 0").groupBy("digest").agg(*(F.min(c).alias(c) for c in ("key", "size", "id")))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # Two different sets with one key only become candidates of each other.
    stars = texts.mapInArrow(_stars_of_texts(orders), _STARS)
    comps = stored(_divided(stars, nodes.groupBy("key").agg(F.min("size").alias("size")), threshold, 0), "candidates")
    bitmap = hash_bitmap(comps.select(F.col("key").alias("hash")))
    members = nodes.join(comps, "key").select("digest", "node", "size", "comp")
    sets = texts.mapInArrow(_candidate_sets(threshold.words, bitmap), "digest binary, hashes binary")
    sets = sets.dropDuplicates(["digest"]).join(members, "digest").drop("digest").withColumnRenamed("node", "key")
    sets = stored(sets, "candidate_sets")
    comps = sets.select("key", "comp")
    for order in range(1, len(threshold.common)):
        rows = sets.select("key", "hashes").join(comps, "key").select("key", "comp", "hashes")
        stars = rows.mapInArrow(_stars_of_sets(orders, order), _STARS)
        comps = stored(_divided(stars, sets.select("key", "size"), threshold, order), "candidates")
    sizes = sets.select("key", "size")
    large = _large(comps, sizes, max_cell)
    left = large.count()
    while left:
        divided = stored(_divided_by_counts(sets, large, threshold), "candidates")
        comps = stored(comps.join(large.select("key"), "key", "left_anti").union(divided), "candidates")
        large = _large(divided, sizes, max_cell)
        before, left = left, large.count()
        if left * 10 > before * 9:
            break
    members = sizes.join(comps, "key").withColumnRenamed("key", "node")
    sets = sets.select(F.col("key").alias("node"), "hashes")
    roots = components(verified(members, sets, orders, max_cell))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named.select("digest", "root", F.col("id").alias("first")), "named")
    smallest = stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "smallest_ids")
    # Stored, so that adaptive execution can split the join where many documents have one set.
    final = stored(named.join(smallest, "root").select("digest", "component_id"), "components")
    return prints.join(final, "digest", "left").select(
        F.col("id").alias(id_col),
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
