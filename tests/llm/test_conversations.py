from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from askahead.llm import conversations
from askahead.llm.conversations import Repair, cheapest

TURNS = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\f\r"


def hurt(rows):
    """The damage, row by row in the order of conversation and turn."""
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        names = [" " if x is None else str(x) for x in (conv, turn)]
        fault = zlib.crc32(":".join(names).encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def repairs(rows):
    """(cost, audit, lines) of the cheapest edits, by the least over all edits in each place, from the last row back."""
    n = len(rows)
    # State of the role initials written so far -> what may follow.
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {}
    for i in range(n, -1, -1):
        for _ in range(3):  # inserts stay at their place and cost; two of them lead round
            for state in ("", "s", "u", "a"):
                options = [(0, "", ())] if i == n and state in ("", "a") else []
                for role in ("user", "assistant"):
                    to = step.get((state, role[0]))
                    if to and (i, to) in best:
                        cost, audit, lines = best[i, to]
                        options.append((cost + 5, "I" + audit, (f"{role}:", *lines)))
                if i < n:
                    role, text, fault = rows[i]
                    extra = 5 * (fault == "truncated")
                    if (i + 1, state) in best:
                        cost, audit, lines = best[i + 1, state]
                        options.append((cost + 2, "D" + audit, lines))
                    if fault not in ("blank", "duplicate"):
                        for edit, price, name in [("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")]:
                            to = step.get((state, name[:1]))
                            if to and (i + 1, to) in best:
                                cost, audit, lines = best[i + 1, to]
                                options.append((cost + price + extra, edit + audit, (f"{name}:{text}", *lines)))
                if options:
                    best[i, state] = min(options, key=lambda x: x[:2])
    return best[0, ""]


def expected(rows):
    by_conv = defaultdict(list)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " "))
    for conv, turn, role, text in hurt(order):
        by_conv[conv].append((turn, role, text))
    out = {}
    for conv in {r[0] for r in rows}:
        seen, marked, counts = set(), [], defaultdict(int)
        for _, role, text in by_conv[conv]:
            core = text.strip(WHITE)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        turns = [t for t, _, _ in by_conv[conv] if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, lines = repairs(marked)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)
    return out


def some(rng, n):
    roles = rng.choices(["system", "user", "assistant", "tool", " "], [1, 6, 6, 1, 0.5], k=n)
    return [(r, rng.random() < 0.15, rng.random() < 0.3) for r in roles]


@pytest.mark.parametrize("seed", range(5))
def test_search_equals_all_edits(seed):
    rng = random.Random(seed)
    for _ in range(300):
        rows = some(rng, rng.randrange(0, 9))
        marked = [(r, f"t{i}", "blank" if goes else "truncated" if cut else "") for i, (r, goes, cut) in enumerate(rows)]
        lattice = [(r[:1], goes, cut) for r, goes, cut in rows]
        assert cheapest(lattice, conversations.NOTHING, (0, 3))[0] == repairs(marked)[:2]


@pytest.mark.parametrize("piece", [1 << 10, 3])
def test_tables_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    rng = random.Random(piece)
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \t", "É.", "same.", "a:b.\nc."]
    rows = []
    for conv in [None, *range(60)]:
        for turn in sorted(rng.sample(range(12), rng.randrange(1, 9))):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None])
            rows.append((conv, turn, role, rng.choice([*texts, None, f"own {turn}."])))
    rows += [(7, None, "user", "Untimed."), (7, None, "user", "Untimed."), (99, 5, "user", "x" * 500_000 + ".")]
    rows += [(98, t, ["user", "assistant"][t % 2], f"Long {t % 97}.") for t in range(600)]
    table = spark.createDataFrame(rows, TURNS)
    table = table.selectExpr("*", "1 AS piece", "2 AS at", "'x' AS conv", "'y' AS audit").repartition(3)
    got = {r.conv_id: tuple(r) for r in Repair(conversations.damaged(table)).summary(table).collect()}
    assert got == expected(rows)


def test_pieces_are_dealt_to_all_tasks(spark):
    rows = [(i, t, "user", f"Turn {t}.") for i in range(200) for t in range(3)]
    repair = Repair(spark.createDataFrame(rows, TURNS))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r.p for r in repair.turns().select(F.spark_partition_id().alias("p")).distinct().collect()} == set(range(tasks))


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "assistant", "B."), (2, 0, "user", "only.")]
    out = Repair(spark.createDataFrame(rows, TURNS)).turns().orderBy("conv_id", "at", "line").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in out] == [
        (1, "K", "system", "S."),
        (1, "R", "user", "A."),
        (1, "K", "assistant", "B."),
    ]


def test_nothing_left_and_empty_tables(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "x.")], TURNS)
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in Repair(conversations.damaged(table)).summary(table).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert Repair(table.limit(0)).summary(table.limit(0)).collect() == []
    assert Repair(table.limit(0)).turns().collect() == []
