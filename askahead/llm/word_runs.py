"""Periodic runs of words: stretches that repeat with some period and cannot be extended.

A run of period p with at least 2 p words holds a position i that is a multiple of p, with the same word at i and i + p.
So the words at all multiples of all periods are compared, a harmonic number of pairs, and each equal pair is extended to
both sides. Extension compares a few words; pairs that agree for ``COVER`` words ask for their longest common extension:
suffixes at the positions of a difference cover are sorted by doubling, any two positions reach such a pair after the same
few words, and a sparse table over the common blocks of neighbours in the order answers for all. The sorted samples are
built only where a pair asks for them. Texts of one Arrow batch are worked on together, each between marks of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askahead.llm.common import prepare, text_bytes

LEAST = 12
# Every difference modulo COVER is one of two members of SAMPLES.
COVER, SAMPLES = 13, np.array([0, 1, 3, 9])
_PAIRS = 1 << 20

_SLOT = np.full(COVER, -1)
_SLOT[SAMPLES] = np.arange(len(SAMPLES))
# Steps from residue i until both i and i + difference are in the cover.
_STEPS = np.array(
    [[min((x - i) % COVER for x in SAMPLES if (x + d) % COVER in SAMPLES) for d in range(COVER)] for i in range(COVER)]
)


class Extensions:
    """Longest common extensions between positions of one sequence of numbers."""

    def __init__(self, numbers: np.ndarray, longest: int) -> None:
        """No two positions may agree for more than ``longest`` numbers."""
        blocks = -(-len(numbers) // COVER) + 2
        self.numbers = np.full(blocks * COVER, -1, np.int32)
        self.numbers[: len(numbers)] = numbers
        self.levels = self._levels(blocks - 1, longest)
        self.order = np.argsort(self.levels[-1], kind="stable")
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(self.order))
        self.table = self._table()

    def _levels(self, blocks: int, longest: int) -> list[np.ndarray]:
        """Ranks of the samples by their first 1, 2, 4, ... blocks of COVER numbers."""
        at = (np.arange(blocks)[:, None] * COVER + SAMPLES).ravel()
        windows = np.lib.stride_tricks.sliding_window_view(self.numbers, COVER)[at]
        ids: dict[bytes, int] = {}
        raw = np.ascontiguousarray(windows).view(f"V{COVER * 4}").ravel().tolist()
        ranks = np.fromiter((ids.setdefault(w, len(ids)) for w in raw), np.int64, len(raw))
        levels, step = [ranks], 1
        while step * COVER <= longest and ranks.max() + 1 < len(ranks):
            after = np.zeros_like(ranks)
            ahead = step * len(SAMPLES)
            after[: max(len(ranks) - ahead, 0)] = ranks[ahead:] + 1
            ranks = np.unique(ranks * (ranks.max() + 2) + after, return_inverse=True)[1]
            levels.append(ranks)
            step *= 2
        return levels

    def _table(self) -> np.ndarray:
        """Least number of common blocks in 1, 2, 4, ... neighbours of the order."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        common = np.zeros(len(a), np.int32)
        for level in range(len(self.levels) - 1, -1, -1):
            ranks, step = self.levels[level], 1 << level
            inside = np.maximum(a, b) < len(ranks)
            same = np.zeros(len(a), bool)
            same[inside] = ranks[a[inside]] == ranks[b[inside]]
            common[same] += step
            a[same] += step * len(SAMPLES)
            b[same] += step * len(SAMPLES)
        rows = [common]
        while 2 << (len(rows) - 1) <= len(common):
            half = 1 << (len(rows) - 1)
            row = rows[-1].copy()
            row[:-half] = np.minimum(row[:-half], row[half:])
            rows.append(row)
        return np.stack(rows)

    def longest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common numbers from a and b on, for different positions known to agree for COVER of them."""
        steps = _STEPS[a % COVER, (b - a) % COVER]
        x, y = a + steps, b + steps
        x, y = (self.place[(p // COVER) * len(SAMPLES) + _SLOT[p % COVER]] for p in (x, y))
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low)[1] - 1
        blocks = np.minimum(self.table[level, low], self.table[level, high - (1 << level)])
        done = steps + blocks.astype(np.int64) * COVER
        return done + agreeing(self.numbers, a + done, b + done, 1)


def agreeing(numbers: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many of the next COVER numbers agree, going up or down by ``step``."""
    count = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for d in range(COVER):
        open_ = open_[numbers[a[open_] + d * step] == numbers[b[open_] + d * step]]
        if not len(open_):
            break
        count[open_] += 1
    return count


class Texts:
    """The numbered words of several texts, longest first, with marks between them that occur once."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        ids: dict[bytes, int] = {}
        numbers = [[ids.setdefault(w, len(ids)) for w in words] for words in texts]
        self.order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        self.lengths = np.array([len(texts[i]) for i in self.order], np.int64)
        # COVER marks before the first text and one after each, so that comparisons stay inside.
        self.starts = COVER + np.append(0, np.cumsum(self.lengths + 1))
        self.numbers = np.empty(self.starts[-1] + COVER, np.int32)
        self.numbers[:] = len(ids) + np.arange(len(self.numbers))
        self.text = np.repeat(np.arange(len(self.lengths) + 1), np.append(self.lengths + 1, COVER))
        self.text = np.append(np.full(COVER, -1), self.text)
        for start, i in zip(self.starts.tolist(), self.order, strict=False):
            self.numbers[start : start + len(numbers[i])] = numbers[i]

    @cached_property
    def forward(self) -> Extensions:
        return Extensions(self.numbers, int(self.lengths.max()))

    @cached_property
    def backward(self) -> Extensions:
        return Extensions(self.numbers[::-1], int(self.lengths.max()))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, period) of words that are equal a period apart, at all multiples of all periods, in parts."""
        longest = int(self.lengths.max(initial=0)) // 2
        periods = np.arange(1, longest + 1)
        # Texts with two periods come first.
        ends = self.starts[np.searchsorted(-self.lengths, -2 * periods, "right")]
        counts = np.maximum(ends - periods, 0) // periods + 1
        start, total = 0, np.append(0, np.cumsum(counts))
        while start < longest:
            end = max(start + 1, int(np.searchsorted(total, total[start] + _PAIRS, "right")) - 1)
            period = np.repeat(periods[start:end], counts[start:end])
            at = (np.arange(total[start], total[end]) - np.repeat(total[start:end], counts[start:end])) * period
            inside = at + period < len(self.numbers)
            at, period = at[inside], period[inside]
            equal = (self.numbers[at] == self.numbers[at + period]) & (self.text[at] == self.text[at + period])
            yield at[equal], period[equal]
            start = end

    def extended(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from each position on, and before it."""
        ahead = agreeing(self.numbers, at, at + period, 1)
        behind = agreeing(self.numbers, at - 1, at + period - 1, -1)
        far = np.flatnonzero(ahead == COVER)
        if len(far):
            ahead[far] = self.forward.longest(at[far], at[far] + period[far])
        far = np.flatnonzero(behind == COVER)
        if len(far):
            last = len(self.numbers) - 1
            mirrored = last - (at[far] - 1)
            behind[far] = self.backward.longest(mirrored - period[far], mirrored)
        return ahead, behind

    def runs(self) -> np.ndarray:
        """(text, start, length, period) per run, by text and start, starts counted within the text."""
        found = np.empty((0, 3), np.int64)
        for at, period in self.pairs():
            ahead, behind = self.extended(at, period)
            start, length = at - behind, behind + period + ahead
            run = length >= np.maximum(LEAST, 2 * period)
            part = np.stack([start[run], length[run], period[run]], axis=1)
            part = np.concatenate([found, part])
            # Of equal stretches, the one of the smallest period is the run; the others are its multiples.
            part = part[np.lexsort(part.T[::-1])]
            first = np.ones(len(part), bool)
            first[1:] = (part[1:, :2] != part[:-1, :2]).any(axis=1)
            found = part[first]
        text = self.text[found[:, 0]]
        found = np.column_stack([np.array(self.order, np.int64)[text], found[:, 0] - self.starts[text], found[:, 1:]])
        return found[np.lexsort(found.T[::-1][[0, 1, 2, 3]])]


def planted(words: list[bytes], row_id: int | None) -> list[bytes]:
    """The words with a periodic end in a tenth of all ids, chosen and shaped by the id's checksum; null ids have none."""
    h = 1 if row_id is None else zlib.crc32(str(row_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _scan(plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column(0).to_pylist()]
            if plant:
                texts = [planted(w, i) for w, i in zip(texts, batch.column(1).to_pylist(), strict=True)]
            runs = Texts(texts).runs()
            cuts = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
            kept = []
            for words, start, end in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if end > start:
                    gone = np.zeros(len(words) + 1, np.int64)
                    _, at, length, period = runs[start:end].T
                    np.add.at(gone, at + period, 1)
                    np.add.at(gone, at + length, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                kept.append(b" ".join(words))
            structs = pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(runs[:, 1:].T)], fields=list(_RUN))
            columns = [
                pa.array([len(w) for w in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), structs),
                pa.array(kept, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns], ["id", "n_words", "runs", "kept"])

    return run


def word_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """(id, n_words, runs, kept_text): one row per document, repeated rows included.

    Words are separated by ASCII white space and numbered from 0. ``runs`` has (start, length, period) of every stretch
    with smallest period q and at least max(12, 2 q) words that no neighbouring word extends, by start and period.
    ``kept_text`` joins by spaces the words that lie in no run after its first period. ``plant`` first makes a tenth of
    the documents periodic, chosen by their ids, as test material.

    Null, empty and blank texts have no words, no runs and an empty ``kept_text``. Texts of any length are read whole;
    what a task holds grows with its largest document or batch, not with the table. Null ids are kept as they are. Other
    columns of ``docs`` are ignored. An empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(text_bytes(text).alias("_text"), F.col(id_col).alias("id")).mapInArrow(
        _scan(plant),
        f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, kept binary",
    )
    return found.select(F.col("id").alias(id_col), "n_words", "runs", F.col("kept").cast("string").alias("kept_text"))


def digest(runs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``word_runs``.

    The four numbers are those of the longest run, ties by smallest start and period, and null without a run.
    """
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    first = F.array_min(
        F.transform(
            "runs",
            lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")),
        )
    )
    best = runs.withColumn("_best", first)
    length = -F.col("_best.n")
    return best.select(
        id_col,
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("_best.start").alias("start"),
        length.alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(F.expr("(-_best.n * 1000) div _best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )
