"""Exact duplicates by SHA-256 digests in cuckoo indexes.

Every scan task first folds the copies it sees into one row per digest, so a text that makes up a third of the corpus
reaches the shuffle once per task. Rows are then dealt by digest, and one index per task settles the groups: a hit is
verified against the stored digest, and a larger id takes the place of the live document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askahead.llm.common import stored, text_bytes, with_row_id
from askahead.llm.cuckoo import CuckooIndex

_OUT_ROWS = 50_000
_GROUP = "sha binary, keep_id bigint, keep_rid bigint, group_size bigint"
_GROUP_ARROW = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("keep_rid", pa.int64()), ("group_size", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        column = pa.array([hashlib.sha256((t or b"").lower()).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([column, batch.column(1)], ["sha", "id"])


class LiveDocuments:
    """The documents that stay, one per digest, with the number of copies."""

    def __init__(self) -> None:
        self.index = CuckooIndex()
        self.live: list[tuple[bool, int, int]] = []
        self.sizes: list[int] = []

    def _enter(self, digest: bytes, document: tuple[bool, int, int], size: int) -> None:
        ref = self.index.insert(digest)
        if ref == len(self.live):
            self.live.append(document)
            self.sizes.append(size)
        else:
            self.live[ref], self.sizes[ref] = document, size

    def add(self, digest: bytes, doc_id: int | None, rid: int, size: int) -> None:
        document = (doc_id is not None, doc_id or 0, rid)
        ref = self.index.find(digest)
        if ref < 0:
            self._enter(digest, document, size)
        elif document > self.live[ref]:
            size += self.sizes[ref]
            self.index.delete(digest)
            self._enter(digest, document, size)
        else:
            self.sizes[ref] += size

    def batches(self) -> Iterator[pa.RecordBatch]:
        refs = [i for i, key in enumerate(self.index.keys) if key is not None]
        for at in range(0, len(refs), _OUT_ROWS):
            part = refs[at : at + _OUT_ROWS]
            docs = [self.live[i] for i in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self.index.keys[i] for i in part], pa.binary()),
                    pa.array([d[1] if d[0] else None for d in docs], pa.int64()),
                    pa.array([d[2] for d in docs], pa.int64()),
                    pa.array([self.sizes[i] for i in part], pa.int64()),
                ],
                schema=_GROUP_ARROW,
            )


def _settle(limit: int):
    """Fold rows with equal digests; beyond ``limit`` digests the task hands on what it has and starts afresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = LiveDocuments()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                live.add(*row)
            if len(live.index) >= limit:
                yield from live.batches()
                live = LiveDocuments()
        yield from live.batches()

    return run


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    rid_col: str | None = None,
    digests_per_task: int = 500_000,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, _rid): one row per document, dropped ones too.

    Texts are equal when they are identical with A-Z as a-z; null counts as empty. Of equal texts the row with the
    largest id stays; null ids are below all others, and of rows with the same id one stays. ``rid_col`` names a stored
    row number of ``docs``, else one is given here. ``digests_per_task`` sets the number of tasks from the row count.
    Other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    source = docs.select(text_bytes(text).alias("_text"), F.struct(F.col(id_col).cast("bigint").alias("d"),
                         (F.col(rid_col) if rid_col else F.lit(0).cast("bigint")).alias("r")).alias("id"))
    rows = source.mapInArrow(_digests, "sha binary, id struct<d: bigint, r: bigint>")
    rid = F.col("id.r") if rid_col else F.monotonically_increasing_id()
    rows = stored(rows.select("sha", F.col("id.d").alias("_id"), rid.alias("_rid")), "digests")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // digests_per_task))
    folded = rows.select("sha", "_id", "_rid", F.lit(1).cast("bigint").alias("n")).mapInArrow(
        _settle(digests_per_task), _GROUP
    )
    groups = folded.repartition(tasks, "sha").mapInArrow(_settle(1 << 62), _GROUP)
    return rows.join(groups, "sha").select(
        F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("keep_id").cast(docs.schema[id_col].dataType).alias("keep_id"),
        "group_size",
        (F.col("_rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "_rid",
    )


def keep_last(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The row that stays of each group of equal texts."""
    numbered, rid = with_row_id(docs)
    kept = exact_groups(numbered, id_col, rid_col=rid, **options).where("kept").select(F.col("_rid").alias(rid))
    # Most rows stay, so their numbers grow with the corpus: one and the same plan at every size.
    return numbered.join(stored(kept, "kept").hint("merge"), rid, "left_semi").select(docs.columns)
