"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates are found in two steps. A shard holds the documents that agree on one of ``BANDS`` bands of ``ROWS`` least
shingle hashes each; in each shard a BK-tree over the SimHash fingerprints of the shingle sets finds those within
``RADIUS`` bits. At a similarity of 0.8 a pair meets in no shard with probability (1 - 0.8 ** ROWS) ** BANDS = 0.0018, and
its fingerprints, whose cosine is then 0.889 at least, are further apart with probability 0.0001. Both fall quickly above 0.8.

Links are then confirmed on the texts, by the exact similarity of their sets. Candidates form components; each member is
compared with the first one of its component. Members unlike the first are compared with all others of the component
within ``RADIUS`` bits, in cells of bounded size; of pairs that are in one group already none needs comparing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askahead.llm import simhash
from askahead.llm.common import stored, text_bytes, with_row_id
from askahead.llm.components import components
from askahead.llm.decontaminate import BITMAP_BITS, hash_bitmap
from askahead.llm.simhash import SEED, Likeness

WORDS = 5
BANDS, ROWS = 12, 4
RADIUS = 22
# Least similarity, as a fraction.
SHARED, OF = 4, 5
# Shingles per side of a cell.
CELL = 1 << 21
_BLOCK = 1 << 10
_FACTORS = np.random.default_rng(SEED).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# The trees of a shard compare nothing but the first fingerprint; the second carries the document's number.
_IN_SHARD = Likeness(words=WORDS, radius=RADIUS, distinct=True, check_bits=simhash.BITS)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the different shingles; fewer words than a shingle form one, no words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(WORDS, len(words))
    grams = {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed hash per band of the least products of the hashes with fixed odd factors."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        np.minimum(least, (hashes[at : at + _BLOCK, None] * _FACTORS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes()) - (1 << 63) for b in least.reshape(BANDS, ROWS)]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, prints, sizes, found = [], [], [], []
        for text in batch.column(0).to_pylist():
            hashes = shingles(text)
            digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            prints.append(simhash.majority(hashes))
            sizes.append(len(hashes))
            found.append(bands(hashes) if len(hashes) else [])
        columns = [pa.array(digests, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)),
                   pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
        rest = [batch.column(i) for i in range(1, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*columns, *rest], ["digest", "fp", "size", "bands", *batch.schema.names[1:]])


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): a star per group of documents that a shard's tree joins."""
    rows = nodes.select(F.posexplode("bands").alias("mask", "value"), "fp", F.col("node").alias("check"))
    return (
        rows.select(F.col("mask").cast("bigint").alias("mask"), "value", "fp", "check")
        .repartition("mask", "value")
        .sortWithinPartitions("mask", "value", "fp", "check")
        .mapInArrow(simhash.shard_stars(_IN_SHARD, sys.maxsize), "fp bigint, check bigint, fp2 bigint, check2 bigint")
        .select(F.col("check").alias("a"), F.col("check2").alias("b"))
    )


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets share at least SHARED / OF of their union."""
    if min(len(a), len(b)) * OF < max(len(a), len(b)) * SHARED:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * OF >= (len(a) + len(b) - both) * SHARED


def _with_bit(bitmap: np.ndarray):
    """Rows (key, ...) whose key has its bit set; the key is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
            known = (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            rows = batch.filter(pa.array(known))
            yield pa.RecordBatch.from_arrays(rows.columns[1:], rows.schema.names[1:])

    return run


def _like_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, first text, ...) to (whether they are similar, ...)."""
    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        core = pa.array([a == b or similar(shingles(a), shingles(b)) for a, b in pairs], pa.bool_())
        yield pa.RecordBatch.from_arrays([core, *batch.columns[2:]], ["core", *batch.schema.names[2:]])


class Cell(simhash.Groups):
    """Members of one component, joined where their sets are similar; the ``core`` first ones are joined already."""

    def __init__(self, prints: np.ndarray, sets: list[np.ndarray], core: int) -> None:
        super().__init__(prints, np.zeros(len(prints), np.uint64), _IN_SHARD)
        self.sets, self.links = sets, []
        self.parent[:core] = [0] * core

    def agree(self, i: int, other: int) -> bool:
        found = similar(self.sets[i], self.sets[other])
        if found:
            self.links.append((i, other))
        return found


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each cell; rows (first, cell, core, node, fp, text) come sorted, those of the core first."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, members in groupby(rows, key=lambda r: (r[0], tuple(r[1].values()))):
        core, nodes, prints, sets = 0, [], [], []
        for _, _, is_core, node, fp, text in members:
            core += is_core
            nodes.append(node)
            prints.append(fp)
            sets.append(shingles(text))
        cell = Cell(np.array(prints, np.int64).view(np.uint64), sets, core)
        cell.search(list(range(len(nodes))))
        sides = [pa.array([nodes[x[side]] for x in cell.links], pa.int64()) for side in (0, 1)]
        yield pa.RecordBatch.from_arrays(sides, ["a", "b"])


def confirmed(links: DataFrame, nodes: DataFrame, rows: DataFrame, max_cell: int = CELL) -> DataFrame:
    """(a, b): links of similar sets that join the same documents as all such links among the candidates do.

    ``rows`` has (row, _text) of the documents. A component whose members are not all like its first one is cut into
    blocks of about ``max_cell`` shingles; a cell holds a block of those unlike the first and another block. The cut does
    not change the groups.
    """
    groups = components(links).withColumnRenamed("root", "first")
    groups = stored(groups.join(nodes.select("node", "fp", "size"), "node"), "candidates")
    # Only texts of candidates, and a few whose bit is set by another, are shuffled.
    bitmap = hash_bitmap(groups.select(F.xxhash64("node").alias("hash")))
    texts = rows.select(F.xxhash64("row").alias("key"), "row", "_text").mapInArrow(
        _with_bit(bitmap), "row bigint, _text binary"
    )
    # Stored, so that adaptive execution can split the joins where one component owns much of the corpus.
    texts = stored(texts.join(groups, texts["row"] == groups["node"]).drop("row"), "candidate_texts")
    heads = texts.where(F.col("node") == F.col("first")).select("first", F.col("_text").alias("_head"))
    fields = "core boolean, node bigint, first bigint, size bigint"
    stars = texts.join(heads, "first").select("_text", "_head", "node", "first", "size").mapInArrow(_like_first, fields)
    stars = stored(stars, "like_first")
    sure = stars.where(F.col("core") & (F.col("node") != F.col("first"))).select(F.col("node").alias("a"), F.col("first").alias("b"))

    def blocks(core: bool) -> F.Column:
        return F.ceil(F.sum(F.when(F.col("core") == core, F.col("size")).otherwise(0)) / max_cell).cast("int")

    counts = stars.groupBy("first").agg(blocks(True).alias("cores"), blocks(False).alias("others"))
    counts = stored(counts.where(F.col("others") > 0), "blocks")
    if counts.isEmpty():
        return sure
    block = F.pmod(F.xxhash64(F.lit(SEED), "node"), F.when(F.col("core"), F.col("cores")).otherwise(F.col("others"))).cast("int")

    def cell(core: int, i: F.Column, j: F.Column) -> F.Column:
        return F.struct(F.lit(core).alias("core"), i.alias("i"), j.alias("j"))

    def upto(n: str) -> F.Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    own = F.col("block")
    with_core = F.transform(upto("cores"), lambda j: cell(1, own, j))
    # One block of others meets itself beside the core.
    with_others = F.filter(
        F.transform(upto("others"), lambda j: cell(0, F.least(own, j), F.greatest(own, j))), lambda _: F.col("others") > 1
    )
    at = F.when(F.col("core"), F.transform(upto("others"), lambda i: cell(1, i, own))).otherwise(F.concat(with_core, with_others))
    dealt = stars.join(counts, "first").withColumn("block", block).select("node", "core", F.explode(at).alias("cell"))
    more = (
        texts.join(dealt, "node")
        .select("first", "cell", "core", "node", "fp", "_text")
        .repartition("first", "cell")
        .sortWithinPartitions("first", "cell", F.desc("core"), "node")
        .mapInArrow(_cells, "a bigint, b bigint")
    )
    return sure.union(more)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, nulls last, of equal ids any one.

    Groups are transitive, each link in them is confirmed on the texts. Texts without words are copies of each other, and so are texts with equal sets of shingles.
    """
    numbered, rid = with_row_id(docs)
    fields = "digest binary, fp bigint, size bigint, bands array<bigint>, row bigint, id " + docs.schema[id_col].dataType.simpleString()
    rows = numbered.select(text_bytes(text).alias("_text"), F.col(rid).alias("row"), F.col(id_col).alias("id"))
    prints = stored(rows.mapInArrow(_prints, fields), "shingle_prints")
    # Documents with equal sets are one node, numbered as the first of them.
    same = prints.groupBy("digest").agg(F.min(F.struct("row", "fp", "size", "bands")).alias("n"))
    nodes = stored(same.select("digest", F.col("n.row").alias("node"), "n.fp", "n.size", "n.bands"), "nodes")
    roots = components(confirmed(candidates(nodes), nodes, rows.select("row", "_text")))
    named = nodes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    # Stored, so that adaptive execution can split the join where many documents have one set.
    groups = prints.select("digest", "row", "id").join(stored(named, "named"), "digest")
    best = groups.groupBy("root").agg(F.min(order).alias("b")).select(F.col("b.row").alias(rid))
    # Most rows stay, so their numbers grow with the corpus: one and the same plan at every size.
    return numbered.join(best.hint("merge"), rid, "left_semi").select(docs.columns)
