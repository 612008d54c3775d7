"""Packing of tokenized documents into sequences by the sum-of-squares rule, online and within bounded memory.

A document's full stretches of ``length`` ids are sequences of their own; its remainder goes where it makes the sum of
squared counts of open sequences per fill level smallest, which keeps the levels evenly used and so finds exact fits
later. Counts are held in one array over levels. When more than ``max_open`` sequences are open, and at a task's end,
the open ones are joined and cut into full sequences; the last ids of a task make sequences whose lengths are powers of
two. So nothing is padded, and no sequence spans two tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askahead.llm.tokens import ID, encoder

END_ID, LENGTH, MAX_OPEN = 1, 2048, 4096
_TASK_BITS = 40
_OUT_BYTES = 8 << 20

# A piece: document id, ids of its document before it, bytes of its ids, ids of the whole document.
Piece = tuple[int | None, int, bytes, int]


class SumOfSquares:
    """Open sequences of one task; ``done`` collects (sequence number, pieces) of the closed ones."""

    def __init__(self, length: int = LENGTH, max_open: int = MAX_OPEN) -> None:
        self.length, self.max_open = length, max_open
        self.counts = np.zeros(length + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(length)]
        self.n_open = 0
        self.done: list[tuple[int, list[Piece]]] = []
        self.n_done = 0

    def level_for(self, size: int) -> int:
        """Fill level that a piece is put on: the cheapest change of the sum of squares, 0 opens a sequence.

        Leaving level h changes the sum by 1 - 2 n(h), entering level t by 2 n(t) + 1, and a full sequence leaves the
        sum. Of equal changes the fullest level is taken.
        """
        top = self.length - size
        here, there = self.counts[1 : top + 1], self.counts[1 + size : top + size + 1]
        change = 2 * (there - here) + 2
        if top:
            change[-1] = 1 - 2 * here[-1]
            change[here == 0] = np.iinfo(np.int64).max
            best = top - 1 - int(change[::-1].argmin())
            if change[best] <= 2 * self.counts[size] + 1 and here[best]:
                return best + 1
        return 0

    def _close(self, pieces: list[Piece]) -> None:
        self.done.append((self.n_done, pieces))
        self.n_done += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Place a document given by its ids as unsigned 32-bit integers."""
        width = ID.itemsize
        total, full = len(ids) // width, len(ids) // width // self.length * self.length
        for start in range(0, full, self.length):
            self._close([(doc_id, start, ids[start * width : (start + self.length) * width], total)])
        if total > full:
            self._place((doc_id, full, ids[full * width :], total))

    def _place(self, piece: Piece) -> None:
        size = len(piece[2]) // ID.itemsize
        level = self.level_for(size)
        pieces = self.open[level].pop() if level else []
        pieces.append(piece)
        self.counts[level] -= bool(level)
        self.n_open -= bool(level)
        if level + size == self.length:
            self._close(pieces)
            return
        self.open[level + size].append(pieces)
        self.counts[level + size] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self._recut()

    def _recut(self) -> None:
        """Join the open sequences, fullest first, and cut full ones off; at most one stays open."""
        held, fill, width = [], 0, ID.itemsize
        waiting = [p for level in reversed(self.open) for pieces in level for p in pieces]
        self.open, self.n_open = [[] for _ in range(self.length)], 0
        self.counts[:] = 0
        for doc_id, start, ids, total in waiting:
            while ids:
                part = ids[: (self.length - fill) * width]
                held.append((doc_id, start, part, total))
                fill += len(part) // width
                start += len(part) // width
                ids = ids[len(part) :]
                if fill == self.length:
                    self._close(held)
                    held, fill = [], 0
        if held:
            self.open[fill].append(held)
            self.counts[fill], self.n_open = 1, 1

    def finish(self) -> None:
        """Close everything: full sequences, then one for each power of two in what is left."""
        self._recut()
        rest = [p for level in self.open for pieces in level for p in pieces]
        self.open, self.n_open, width = [[] for _ in range(self.length)], 0, ID.itemsize
        left = sum(len(p[2]) for p in rest) // width
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            held = []
            while room:
                doc_id, start, ids, total = rest.pop(0)
                part = ids[: room * width]
                held.append((doc_id, start, part, total))
                room -= len(part) // width
                if len(part) < len(ids):
                    rest.insert(0, (doc_id, start + len(part) // width, ids[len(part) :], total))
            self._close(held)

    def take(self) -> list[tuple[int, list[Piece]]]:
        done, self.done = self.done, []
        return done


_ROWS = pa.schema(
    [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
_DDL = "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def _rows(sequences: list[tuple[int, list[Piece]]], task: int) -> Iterator[pa.RecordBatch]:
    columns: list[list] = [[] for _ in _ROWS]
    size = 0
    for number, pieces in sequences:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // ID.itemsize
            for column, value in zip(columns, (doc_id, start, n, ids, total, task << _TASK_BITS | number, offset), strict=True):
                column.append(value)
            offset += n
            size += len(ids)
        if size > _OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)
            columns, size = [[] for _ in _ROWS], 0
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)


def _pack(path: str, end_id: int, length: int, max_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, np.array([end_id], ID).tobytes()
        packer, task = SumOfSquares(length, max_open), TaskContext.get().partitionId()
        for batch in batches:
            for text, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc_id, encode(text or "") + end)
            yield from _rows(packer.take(), task)
        packer.finish()
        yield from _rows(packer.take(), task)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    length: int = LENGTH,
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece of a document.

    ``ids`` are little-endian unsigned 32-bit integers, ``start`` counts the ids of the document before the piece,
    ``doc_tokens`` all of them with the end id, ``offset`` the ids of the sequence before it. Null and empty texts are
    the end id alone. Every row is packed, whatever its id: null ids stay null, repeated rows are packed each. Other
    columns are ignored; an empty table gives an empty one.
    """
    pieces = docs.select(F.col(text).alias("t"), F.col(id_col).cast("bigint").alias("id")).mapInArrow(
        _pack(tokenizer, end_id, length, max_open), _DDL
    )
    return pieces.withColumnRenamed("id", id_col)


def with_checksums(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
