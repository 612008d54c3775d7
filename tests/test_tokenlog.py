from __future__ import annotations

import random

import pytest
from calendar_days import day
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from askahead.operators import tokenlog
from askahead.plans.model_input import model_input
from askahead.session import fresh_path
from askahead.sources.tables import code_vocab

EVENTS = "subject_id bigint, time timestamp_ntz, code string, numeric_value double"
PROBES = "subject_id bigint, prediction_time timestamp_ntz"
CODES = {"a": 1, "b": 2, "c": 3}


def log_of(spark, rows):
    return spark.createDataFrame([(s, None if t is None else day(t), c, v) for s, t, c, v in rows], EVENTS)


def tails(rows, probes, n, cap):
    """By definition: the last n tokens at or before each time; a time counts its last ``cap`` tokens."""
    out = {}
    for s, t in probes:
        mine = sorted((t2, CODES[c], v) for s2, t2, c, v in rows if s2 == s and t2 is not None)
        if mine:
            kept = [x for i, x in enumerate(mine) if sum(y[0] == x[0] for y in mine[i + 1 :]) < cap]
            out[s, day(t)] = [x[1:] for x in kept if x[0] <= t][-n:]
    return out


def got(histories):
    return {(r.subject_id, r.prediction_time): [(t.code, t.numeric_value) for t in r.tokens] for r in histories.collect()}


@pytest.mark.parametrize("few_blocks", [64, 1])
@pytest.mark.parametrize("max_len", [1, 3, 16])
def test_histories_equal_definition(spark, max_len, few_blocks):
    rng = random.Random(max_len)
    rows = [(rng.choice([1, 1, 1, 2]), rng.randint(0, 40) / 2, rng.choice("abc"), float(rng.randint(0, 3))) for _ in range(150)]
    rows += [(3, 1, "a", 1.0), (4, None, "b", 1.0)]
    probes = [(s, t / 4) for s in (1, 2, 3, 4, 5) for t in range(-2, 86)]
    events = log_of(spark, rows)
    log = tokenlog.build(events, code_vocab(events), max_len, few_blocks=few_blocks)
    assert log.has_many == (few_blocks == 1)
    times = spark.createDataFrame([(s, day(t)) for s, t in probes * 2], PROBES)
    assert got(log.histories(times)) == tails(rows, probes, max_len, max_len)
    # A stored log answers again, and shorter histories, too.
    again = tokenlog.open_log(spark, log.path)
    assert again == log
    assert got(again.histories(times, 1)) == tails(rows, probes, 1, max_len)
    with pytest.raises(ValueError, match="at most"):
        log.histories(times, max_len + 1)


def test_an_empty_log_has_no_histories(spark):
    events = log_of(spark, [(1, 0, "a", 1.0)])
    log = tokenlog.build(events.limit(0), code_vocab(events), 4)
    assert log.histories(spark.createDataFrame([(1, day(0))], PROBES)).collect() == []


def test_a_log_that_was_not_finished_cannot_be_opened(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tokenlog.open_log(spark, fresh_path(spark, "nothing"))


def test_reading_histories_shuffles_no_tokens(spark):
    rng = random.Random(1)
    events = log_of(spark, [(s, rng.random() * 90, rng.choice("abc"), 1.0) for s in range(200) for _ in range(20)])
    log = tokenlog.build(events, code_vocab(events), 8, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        times = events.select("subject_id", F.col("time").alias("prediction_time"))
        plan = log.histories(times)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and "tokens" not in " ".join(exchanges)
    below = plan.split("SortMergeJoin")[1].split("Exchange")[0]
    assert "Bucketed: true" in plan and "tokens" in below


@pytest.mark.parametrize("name", ["history_sequence", "model_input", "predict_table"])
def test_initial_plans_are_small(spark, name):
    plan = entry_point.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("FileScan") < 10 and initial.count("Exchange") < 20


def test_model_input_from_a_stored_log(spark):
    events = log_of(spark, [(1, 0, "a", 1.0), (1, 1, "b", 2.0), (1, 2, "c", 3.0)])
    vocab = code_vocab(events)
    schema = "subject_id bigint, prediction_time timestamp_ntz, boolean_value boolean, occurs boolean, query string, duration_days double"
    labels = spark.createDataFrame([(1, day(2), False, True, "c", 30.0)], schema)
    log = tokenlog.build(events, vocab, 8)
    # As text, because a missing value is not equal to itself.
    assert str(model_input(labels, log, vocab, 8).collect()) == str(model_input(labels, events, vocab, 8).collect())


def input_of(spark, max_len, few_blocks, light_rows=tokenlog.LIGHT_ROWS):
    rng = random.Random(9)
    events = log_of(spark, [(rng.randint(1, 3), rng.randint(0, 20) / 2, rng.choice("abc"), float(rng.randint(0, 3))) for _ in range(90)])
    schema = "subject_id bigint, prediction_time timestamp_ntz, boolean_value boolean, occurs boolean, query string, duration_days double"
    asked = [(s, day(t), False, d % 2 == 0, "c", float(d)) for s in (1, 2) for t in (-1, 3, 8) for d in range(70)]
    vocab = code_vocab(events)
    log = tokenlog.build(events, vocab, max_len, few_blocks=few_blocks)
    numbered = tokenlog.numbered_tokens(events, vocab, max_len, light_rows=light_rows)
    return model_input(spark.createDataFrame(asked, schema), log, vocab, max_len), asked, numbered


@pytest.mark.parametrize("few_blocks", [64, 1])
def test_every_question_of_a_time_gets_its_history(spark, few_blocks):
    rows, asked, _ = input_of(spark, 4, few_blocks)
    got = rows.collect()
    assert sorted((r.subject_id, r.prediction_time, r.duration_days) for r in got) == sorted((s, t, d) for s, t, *_, d in asked)
    assert len({(r.subject_id, r.prediction_time, str(r.sequence)) for r in got}) == 6


@pytest.mark.parametrize("max_len", [2, 16])
def test_tokens_of_light_and_heavy_subjects_are_numbered_alike(spark, max_len):
    light, heavy = (input_of(spark, max_len, 64, n)[2] for n in (tokenlog.LIGHT_ROWS, 0))
    assert sorted(light.collect()) == sorted(heavy.select(*light.columns).collect())
    exchanges = [x._jdf.queryExecution().executedPlan().toString().count("Exchange") for x in (light, heavy)]
    assert exchanges[0] < exchanges[1]


@pytest.mark.parametrize("name", ["model_input", "model_input_by_event", "predict_table"])
def test_histories_are_joined_once_and_not_by_time(spark, name):
    plan = entry_point.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    uppermost = next(line for line in plan.split("Initial Plan")[-1].splitlines() if "Join " in line)
    assert "subject_id" in uppermost and "[subject_id" in uppermost and "prediction_time" not in uppermost.split("Inner")[0]
