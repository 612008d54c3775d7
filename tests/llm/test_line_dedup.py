from __future__ import annotations

import random
from collections import defaultdict

import pytest
from common_llm import docs_table
from pyspark.sql import functions as F

from askahead.llm import line_dedup
from askahead.llm.line_dedup import LineRuns

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACE))


def brute(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(float("-inf") if i is None else i)
    keeper = {k: max(d) for k, d in holders.items() if len(d) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        me = float("-inf") if i is None else i
        kept = [x for x in lines if keeper.get(key(x), me) == me]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    shared = [f"{i} Gemeinsame Zeile, long enough to count as ONE - é{i}".ljust(40 + i % 3, "x") for i in range(8)]
    shared += ["É" * 40, "é" * 40, "short line", "x" * 39, "y" * 40]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(shared) if rng.random() < 0.6 else f"own line of document {i} that nobody else has at all {rng.random()}"
            line = rng.choice([line, line.upper() if line.isascii() else line, f"  {line}\t\r", f"\x0b{line}\x0c"])
            lines += [line] * rng.choice([1, 1, 2])
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n", "\n\n"])))
    return rows


@pytest.mark.parametrize(("batches", "fanout"), [(4, 3), (1, 3), (7, 2)])
def test_equals_brute_force(spark, batches, fanout):
    rows = corpus(batches, 60)
    random.Random(1).shuffle(rows)
    df = line_dedup.dedup_lines(docs_table(spark, rows), batches=batches, fanout=fanout)
    assert got(df) == brute(rows)


def test_odd_rows(spark):
    line = "a line that is in a good many documents, over forty"
    rows = [(None, line), (None, f"{line}\nmore"), (1, None), (2, ""), (2, line), (3, line), (3, f"x\n{line}\n{line}"), (4, line.upper()),
            (9, f"{line}\nz"), (9, f"{line}\nz"), (5, "q" * 200_000)]
    docs = docs_table(spark, rows, "batch h1 h2 pos _doc n_docs")
    assert got(line_dedup.dedup_lines(docs, min_docs=4)) == brute(rows, min_docs=4)
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []
    assert got(line_dedup.dedup_lines(docs.where("doc_id is null"))) == brute(rows[:2])


def test_runs_are_levelled_and_keep_the_first_batch_as_keeper(spark):
    runs = LineRuns(fanout=2)
    shape = []
    for batch, doc in enumerate((90, 50, 30, 10, 5)):
        keys = [(k, k, 1, doc) for k in range(batch, 6)]
        runs.add(spark.createDataFrame(keys, "h1 bigint, h2 bigint, n_docs bigint, last_doc bigint"))
        shape.append([len(level) for level in runs.levels])
    assert shape == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    state = {r.h1: (r.n_docs, r.keeper) for r in runs.state().collect()}
    assert state == {k: (min(k, 4) + 1, 90) for k in range(6)}


def test_no_python_runs_on_the_executors(spark):
    df = line_dedup.dedup_lines(docs_table(spark, corpus(2, 20)))
    text = df.select("*", F.sha2("kept_text", 256))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Arrow", "Pandas"))
