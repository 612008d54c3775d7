"""Repair of conversations: the cheapest edits that leave an optional system turn and then pairs of user and assistant.

Edits of a conversation are paths through a lattice of (rows read, last role written). Both ends are searched at once:
a forward and a reverse heap grow until no cheaper or equally cheap path can cross between them, and of the cheapest
paths the one with the least string of edit initials is taken.

Conversations of any length are cut into pieces of bounded size. A piece that is a whole conversation is searched once,
others from each state to each; a conversation's pieces are then put together in order. Equally cheap edits of the same
rows are never prefixes of each other, as every further insert costs, so the least string is found piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askahead.llm.common import prepare, stored

PIECE = 1 << 10
# ASCII white space.
_WHITE = " \t\n\x0b\f\r"

# What was written last: nothing, a system, user or assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_FINAL = (NOTHING, ASSISTANT)
_ROLES = {USER: "user", ASSISTANT: "assistant"}
# The only role that can be given next, and where a row can be kept by its initial.
_GIVEN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {
    (NOTHING, "s"): SYSTEM,
    (NOTHING, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
_BEFORE_GIVEN = {to: [s for s, t in _GIVEN.items() if t == to] for to in range(4)}
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
_LEGAL = {"su", "ua", "au"}

Row = tuple[str, bool, bool]  # role initial, has to go, is truncated
Path = tuple[int, str]


def _forward(rows: list[Row], i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, initial, next i, next state) of the edits at a node."""
    yield INSERT_COST, "I", i, _GIVEN[state]
    if i < len(rows):
        initial, goes, cut = rows[i]
        yield DELETE_COST, "D", i + 1, state
        if not goes:
            extra = TRUNCATED_COST if cut else 0
            yield REROLE_COST + extra, "R", i + 1, _GIVEN[state]
            kept = _KEPT.get((state, initial))
            if kept is not None:
                yield KEEP_COST + extra, "K", i + 1, kept


def _backward(rows: list[Row], i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, initial, previous i, previous state) of the edits that lead to a node."""
    for before in _BEFORE_GIVEN[state]:
        yield INSERT_COST, "I", i, before
    if i:
        initial, goes, cut = rows[i - 1]
        yield DELETE_COST, "D", i - 1, state
        if not goes:
            extra = TRUNCATED_COST if cut else 0
            for before in _BEFORE_GIVEN[state]:
                yield REROLE_COST + extra, "R", i - 1, before
            for before in range(4):
                if _KEPT.get((before, initial)) == state:
                    yield KEEP_COST + extra, "K", i - 1, before


def cheapest(rows: list[Row], entry: int, exits: tuple[int, ...]) -> tuple[Path, int] | None:
    """((cost, initials), exit) of the cheapest edits from one state to one of others, the least initials among them."""
    n = len(rows)
    # Per side: labels (cost, initials, exit), settled nodes and a heap; nodes that cost the same are settled in order of
    # their distance in rows, as keeping is free.
    front: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    rear: dict[tuple[int, int], tuple[int, str, int]] = {(n, s): (0, "", s) for s in exits}
    heaps = [[(0, 0, entry)], [(0, 0, s) for s in exits]]
    settled: tuple[set, set] = (set(), set())
    best: tuple[int, str, int] | None = None

    def top(side: int) -> float:
        heap = heaps[side]
        while heap and (heap[0][1] if side == 0 else n - heap[0][1], heap[0][2]) in settled[side]:
            heappop(heap)
        return heap[0][0] if heap else float("inf")

    def cross(head: tuple[int, str], cost: int, initial: str, tail: tuple[int, str, int]) -> None:
        nonlocal best
        path = (head[0] + cost + tail[0], head[1] + initial + tail[1], tail[2])
        if best is None or path < best:
            best = path

    while True:
        tops = top(0), top(1)
        # Paths that cost as much as the best are finished, too.
        if min(tops) == float("inf") or (best is not None and sum(tops) > best[0]):
            return best and ((best[0], best[1]), best[2])
        side = 0 if tops[0] <= tops[1] else 1
        cost, depth, state = heappop(heaps[side])
        i = depth if side == 0 else n - depth
        node = (i, state)
        settled[side].add(node)
        if side == 0:
            label = front[node]
            if node in settled[1]:
                cross(label, 0, "", rear[node])
            for w, initial, j, t in _forward(rows, i, state):
                if (j, t) in settled[1]:
                    cross(label, w, initial, rear[j, t])
                new = (cost + w, label[1] + initial)
                if (j, t) not in front or new < front[j, t]:
                    front[j, t] = new
                    heappush(heaps[0], (cost + w, j, t))
        else:
            tail = rear[node]
            if node in settled[0]:
                cross(front[node], 0, "", tail)
            for w, initial, j, t in _backward(rows, i, state):
                if (j, t) in settled[0]:
                    cross(front[j, t], w, initial, tail)
                new = (cost + w, initial + tail[1], tail[2])
                if (j, t) not in rear or new < rear[j, t]:
                    rear[j, t] = new
                    heappush(heaps[1], (cost + w, n - j, t))


def damaged(turns: DataFrame) -> DataFrame:
    """Test material: turns dropped, emptied, cut, repeated or given to the user, by a checksum of conversation and turn.

    Returns (conv_id, turn, role, text); null roles and texts become one space, and count so in the checksum.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.encode(F.concat_ws(":", *name), "UTF-8")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1)))
    rows = turns.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy"))
    return rows.drop("_copy")


def _ordered(turns: DataFrame) -> DataFrame:
    """(conv, piece, at, role, text, initial, blank, duplicate, truncated), each conversation by turn, role and text.

    A range of the order goes to each task, so that no conversation has to fit in one. Equal rows are counted before they
    are shuffled.
    """
    key = ["conv", "role", "text"]
    rows = turns.select(
        F.col("conv_id").alias("conv"),
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").cast("int").alias("n"))
    firsts = rows.groupBy(*key).agg(F.bool_or(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("first"))
    # Stored, so that adaptive execution can split the join where one conversation repeats a row very often.
    firsts = stored(firsts.withColumnsRenamed({c: f"_{c}" for c in key}), "first_turns")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    at_first = F.when(F.col("untimed"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first"))
    core = F.rtrim("text", F.lit(_WHITE))
    blank = core == ""
    duplicate = ~blank & (~F.col("at_first") | (F.col("copy") > 1))
    rows = (
        rows.join(firsts, same)
        .select("conv", "turn", "role", "text", at_first.alias("at_first"), F.explode(F.sequence(F.lit(1), "n")).alias("copy"))
        .repartitionByRange("conv", "turn", "role", "text", "copy")
        .sortWithinPartitions("conv", "turn", "role", "text", "copy")
        .select(
            "conv",
            "turn",
            "role",
            "text",
            F.substring("role", 1, 1).alias("initial"),
            blank.alias("blank"),
            duplicate.alias("duplicate"),
            (~blank & ~duplicate & ~F.right(core, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    return stored(rows.withColumn("piece", F.floor(F.col("at") / PIECE)), "ordered_turns")


class _Rows:
    """The rows of Arrow batches one by one, and the types of their columns."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.batches, self.schema = batches, None

    def __iter__(self) -> Iterator[tuple]:
        for batch in self.batches:
            self.schema = batch.schema
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def batch(self, rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
        """Rows whose first field is this table's first column; the others have the given types."""
        schema = pa.schema([pa.field("conv", self.schema.field(0).type), *(pa.field(n, k) for n, k in kinds.items())])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, piece, whole, initial, goes, truncated) of sorted pieces to one row per piece.

    ``costs`` and ``audits`` are those from each state to each, by 4 * entry + exit; the cost is -1 where there is none.
    """
    table, out = _Rows(batches), []
    kinds = {"piece": pa.int64(), "illegal": pa.int64(), "first": pa.string(), "last": pa.string()}
    kinds |= {"costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
    for (conv, piece), members in groupby(table, key=lambda r: r[:2]):
        members = list(members)
        lattice = [r[3:] for r in members]
        costs, audits = [-1] * 16, [""] * 16
        whole = members[0][2]
        for entry, exits in [(NOTHING, _FINAL)] if whole else [(a, (b,)) for a in range(4) for b in range(4)]:
            found = cheapest(lattice, entry, exits)
            if found:
                costs[4 * entry + found[1]], audits[4 * entry + found[1]] = found[0]
        initials = [r[0] for r in lattice]
        illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, piece, illegal, initials[0], initials[-1], costs, audits))
        if len(out) >= 1000 or not whole:
            yield table.batch(out, **kinds)
            out = []
    if out:
        yield table.batch(out, **kinds)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of conversations in order to (conv, piece, illegal, cost, entry, audit); ``illegal`` and ``cost`` are totals."""
    table = _Rows(batches)
    kinds = {"piece": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "entry": pa.int32(), "audit": pa.string()}
    out = []
    for conv, pieces in groupby(table, key=lambda r: r[0]):
        # Per state: the cost and initials so far, and how it was reached, as links.
        labels: dict[int, tuple[int, str, tuple]] = {NOTHING: (0, "", ())}
        names, illegal, last = [], 0, None
        for _, piece, wrong, first, end, costs, audits in pieces:
            illegal += wrong + (last is not None and last + first not in _LEGAL)
            last = end
            names.append(piece)
            reached: dict[int, tuple[int, str, tuple]] = {}
            for entry, (cost, audit, way) in labels.items():
                for to in range(4):
                    at = 4 * entry + to
                    new = (cost + costs[at], audit + audits[at], (entry, audits[at], way))
                    if costs[at] >= 0 and (to not in reached or new[:2] < reached[to][:2]):
                        reached[to] = new
            labels = reached
        cost, _, way = min((labels[s] for s in _FINAL if s in labels), key=lambda label: label[:2])
        steps = []
        while way:
            steps.append(way[:2])
            way = way[2]
        out += [(conv, name, illegal, cost, *step) for name, step in zip(names, reversed(steps), strict=True)]
        if len(out) >= 1000:
            yield table.batch(out, **kinds)
            out = []
    if out:
        yield table.batch(out, **kinds)


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of pieces, each followed by the piece's rows, to (conv, at, line, edit, role, text).

    ``line`` orders what is written at one row: inserts come before it, those after the last row of a piece behind it.
    """
    table, out = _Rows(batches), []
    kinds = {"at": pa.int64(), "line": pa.int32(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}
    for _, members in groupby(table, key=lambda r: r[:2]):
        members = iter(members)
        conv, _, at, initial, role, text, audit, state = next(members)
        line = 0
        row = next(members)
        for edit in audit:
            if edit == "I":
                state = _GIVEN[state]
                out.append((conv, row[2], line, edit, _ROLES[state], ""))
                line += 1
                continue
            conv, _, at, initial, role, text, _, _ = row
            if edit == "K":
                state = _KEPT[state, initial]
            elif edit == "R":
                state, role = _GIVEN[state], _ROLES[_GIVEN[state]]
            if edit != "D":
                out.append((conv, at, line, edit, role, text))
            line += 1
            after = next(members, None)
            if after is not None:
                row, line = after, 0
            if len(out) >= 1000:
                yield table.batch(out, **kinds)
                out = []
    if out:
        yield table.batch(out, **kinds)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, role, text) to (conv, sha256); texts pass by one at a time."""
    table, out = _Rows(batches), []
    for conv, lines in groupby(table, key=lambda r: r[0]):
        state, between = hashlib.sha256(), b""
        for _, role, text in lines:
            state.update(between + role.encode() + b":" + text.encode())
            between = b"\n"
        out.append((conv, state.hexdigest()))
        if len(out) >= 1000:
            yield table.batch(out, sha256=pa.string())
            out = []
    if out:
        yield table.batch(out, sha256=pa.string())


class Repair:
    """The cheapest repair of every conversation in a table of turns (conv_id, turn, role, text).

    A conversation's rows are taken by turn, nulls first, then role and text. A row that is blank or repeats an earlier
    one's role and text has to be deleted; a truncated one, which does not end in . ! or ?, costs more unless it is
    deleted. Keeping a row is free, giving it the role user or assistant costs 1, deleting it 2, an empty new turn of
    either role 5. Null roles and texts count as one space; a role with another initial than s, u and a cannot be kept.
    Null conversation ids form one conversation, null turns are ignored by ``gaps``. Repeated rows are duplicates. Texts
    of any length pass through whole, one at a time. Other columns are ignored; an empty table gives empty ones.
    """

    def __init__(self, turns: DataFrame) -> None:
        prepare(turns.sparkSession)
        self.kind = turns.schema["conv_id"].dataType.simpleString()
        # A number of tasks, as rows are small for the work behind them and would be merged into few tasks.
        self.tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = _ordered(turns)
        sizes = self.rows.groupBy("conv").agg(F.min("piece").alias("low"), F.max("piece").alias("high"))
        # Only conversations in several pieces; stored, so that the join can be split where one has much of the table.
        several = stored(sizes.where("low < high").select(F.col("conv").alias("_conv")), "divided_conversations")
        marked = self.rows.join(several, F.col("conv").eqNullSafe(F.col("_conv")), "left").withColumn(
            "several", F.col("_conv").isNotNull() | F.col("conv").isNull()
        )
        found = (
            marked.select("conv", "piece", ~F.col("several"), "initial", F.col("blank") | F.col("duplicate"), "truncated", "at")
            .repartition(self.tasks, "conv", "piece")
            .sortWithinPartitions("conv", "piece", "at")
            .drop("at")
            .mapInArrow(
                _pieces,
                f"conv {self.kind}, piece bigint, illegal bigint, first string, last string, "
                "costs array<bigint>, audits array<string>",
            )
        )
        fields = f"conv {self.kind}, piece bigint, illegal bigint, cost bigint, entry int, audit string"
        joined = found.repartition(self.tasks, "conv").sortWithinPartitions("conv", "piece").mapInArrow(_joined, fields)
        self.edits = stored(joined, "edits")

    def turns(self) -> DataFrame:
        """(conv_id, at, line, edit, role, text): the repaired conversations, each in the order of (at, line).

        ``edit`` is K for a kept row, R for one with another role and I for an inserted one.
        """
        nothing = F.lit(None).cast("string")
        heads = self.edits.select(
            "conv", "piece", F.lit(-1).alias("at"), *(nothing.alias(c) for c in ("initial", "role", "text")), "audit", "entry"
        )
        rows = self.rows.select(
            "conv", "piece", "at", "initial", "role", "text", nothing.alias("audit"), F.lit(None).cast("int").alias("entry")
        )
        return (
            heads.union(rows)
            .repartition(self.tasks, "conv", "piece")
            .sortWithinPartitions("conv", "piece", "at")
            .mapInArrow(_replayed, f"conv {self.kind}, at bigint, line int, edit string, role string, text string")
            .withColumnRenamed("conv", "conv_id")
        )

    def summary(self, ids: DataFrame) -> DataFrame:
        """One row per different conv_id of ``ids``: counts of faults, the cost, the edits and a hash of the result.

        The hash is over the lines ``role:text`` joined by line feeds and has to see a conversation's lines in one order,
        so they pass through one task, but only one line is held at a time.
        """
        count = {c: F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")}
        turn = F.col("turn")
        gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("bigint").alias("gaps")
        faults = self.rows.groupBy("conv").agg(gaps, *count.values())
        edits = self.edits.groupBy("conv").agg(
            F.max("illegal").alias("illegal"),
            F.max("cost").alias("cost"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda p: p["audit"]), "").alias("audit"),
        )
        lines = (
            self.turns()
            .repartition(self.tasks, "conv_id")
            .sortWithinPartitions("conv_id", "at", "line")
            .select("conv_id", "role", "text")
            .mapInArrow(_digested, f"conv {self.kind}, sha256 string")
        )
        out = ids.select("conv_id").distinct()
        for n, part in enumerate((faults, edits, lines)):
            out = out.join(part.withColumnRenamed("conv", f"_{n}"), F.col("conv_id").eqNullSafe(F.col(f"_{n}")), "left")
        numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        sha = F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
        return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), sha)
