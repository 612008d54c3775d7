from __future__ import annotations

import random
import re

import pytest

from askahead.catalog import QUERIES
from askahead.operators import sampling, zones
from askahead.operators.context import numbered_times
from askahead.plans.labels import label_table, training_table


def some_log(events, n=300):
    rng = random.Random(4)
    return events([(rng.randint(1, 20), rng.randint(0, 400) / 4, rng.choice("abc")) for _ in range(n)])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("codes", [None, ["a", "b"]])
def test_a_larger_grid_is_ordered_by_more_tasks(events, monkeypatch, codes):
    log = some_log(events)
    whole = rows_of(label_table(log, codes, [5, 9], 1))
    monkeypatch.setattr(zones, "CELLS_PER_TASK", 20)
    cut = label_table(log, codes, [5, 9], 1)
    assert rows_of(cut) == whole
    # 300 rows with two durations of two or three codes each.
    assert cut.rdd.getNumPartitions() >= 300 * (1 + 2 * 2) / 20


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_codes_are_united_from_stored_predictions(spark):
    assert "Join" not in plan_of(QUERIES["union_codes"](spark, "/root/testdata/sf0.001"))


def test_a_longer_log_is_drawn_for_by_more_tasks(events, monkeypatch):
    log = some_log(events)
    whole = rows_of(training_table(log, None, range(5, 9), 6, 1, 3))
    monkeypatch.setattr(zones, "CELLS_PER_TASK", 20)
    cut = training_table(log, None, range(5, 9), 6, 1, 3)
    assert rows_of(cut) == whole
    # 300 rows are dealt by subject to that many tasks, and no others are combined or shuffled for the drawing.
    dealt = re.findall(r"hashpartitioning\(subject_id#\d+L, (\d+)\), REPARTITION_BY_NUM", plan_of(cut))
    assert dealt and all(int(n) >= 300 / 20 for n in dealt)
    # Rows of large subjects by subject and time.
    text = plan_of(sampling.sample_log(log, None, range(5, 9), 6, 1, 3, light_rows=5))
    dealt = re.findall(r"hashpartitioning\(subject_id#\d+L, time#\d+, (\d+)\), REPARTITION_BY_NUM", text)
    assert dealt and all(int(n) >= 300 / 20 for n in dealt)


def test_rows_of_one_large_time_are_combined_before_the_shuffle(events):
    log = events([(s, d / 4, c) for s in range(4) for d in range(12) for c in "abca"] + [(1, 2.0, "a")] * 500)
    whole = numbered_times(log, 5, 16)
    combined = numbered_times(log, 5, 16, rows_per_task=400)
    assert rows_of(whole) == rows_of(combined)
    # Three codes a time: the fifth row is one of the second time.
    assert {r._nth for r in whole.collect()} == set(range(2, 13))
    assert "time#" in plan_of(whole) and "REPARTITION_BY_NUM" in plan_of(whole)
    assert "REPARTITION_BY_NUM" not in plan_of(combined)
