from __future__ import annotations

import math
import random

import pytest
from calendar_days import day
from pyspark.sql import functions as F

from askahead.functions import exact_sum
from askahead.operators import composite


def total(spark, values, parts=1):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
    return df.agg(exact_sum(F.col("x")).alias("s")).first().s


@pytest.mark.parametrize("seed", range(4))
def test_sum_is_the_same_in_any_order_and_right(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([-1, 1, 1]) * rng.random() * 10.0 ** rng.randint(-18, 6) for _ in range(400)]
    want = math.fsum(values)
    sums = set()
    for parts in (1, 3, 8):
        rng.shuffle(values)
        sums.add(total(spark, values, parts))
    assert len(sums) == 1
    assert sums.pop() == pytest.approx(want, rel=4e-16, abs=0)


def test_values_that_cancel_and_odd_values(spark):
    assert total(spark, [1e15, 1e-15, -1e15]) == 1e-15
    assert total(spark, [-1e-20]) == -1e-20
    assert total(spark, [0.1] * 10) == pytest.approx(1.0, rel=3e-16)
    assert total(spark, [None, 0.5]) == 0.5 and total(spark, [None]) is None
    assert total(spark, [1.0, math.inf]) == math.inf and math.isnan(total(spark, [math.inf, -math.inf, 1.0]))
    assert math.isnan(total(spark, [math.nan, 1.0]))


def test_risk_of_any_event_does_not_depend_on_the_layout(spark):
    rng = random.Random(5)
    rows = [(s, day(0), rng.random() ** 3, f"c{i}") for s in range(30) for i in range(40)]
    schema = "subject_id bigint, prediction_time timestamp_ntz, occurs_probs double, code string"
    got = []
    for parts in (1, 7):
        rng.shuffle(rows)
        out = composite.composite_probs(spark.createDataFrame(rows, schema).repartition(parts), ["max", "or", "sum"])
        got.append({r.subject_id: (r.prob_max, r.prob_or, r.prob_sum) for r in out.collect()})
    assert got[0] == got[1]
    for s in range(30):
        want = 1 - math.prod(1 - p for i, _, p, _ in rows if i == s)
        assert got[0][s][1] == pytest.approx(want, abs=1e-14)
    plan = composite.composite_probs(spark.createDataFrame(rows, schema), ["max", "or"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_max" in plan


def test_certain_and_impossible_risks(spark):
    schema = "subject_id bigint, prediction_time timestamp_ntz, occurs_probs double, code string"

    def risk(*values):
        rows = [(1, day(0), v, "c") for v in values]
        return composite.composite_probs(spark.createDataFrame(rows, schema), ["or"]).first().prob_or

    assert risk(0.3, 1.0) == 1.0 and risk(0.0, 0.0) == 0.0 and risk(None) == 0.0
    assert risk(3.0, 0.5) == pytest.approx(1 - (1 - 3.0) * (1 - 0.5)) and math.isnan(risk(math.nan, 1.0))
