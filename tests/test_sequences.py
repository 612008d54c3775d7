from __future__ import annotations

import math
import random

import pytest
from calendar_days import day
from pyspark.sql import functions as F

from askahead.operators import quality, sequences
from askahead.plans.model_input import model_input
from askahead.sources.tables import code_vocab


def valued(spark, rows):
    return spark.createDataFrame(
        [(s, day(t), c, v) for s, t, c, v in rows], "subject_id bigint, time timestamp_ntz, code string, numeric_value double"
    )


def times(spark, rows):
    return spark.createDataFrame([(s, day(t)) for s, t in rows], "subject_id bigint, prediction_time timestamp_ntz")


def labels(spark, rows):
    schema = "subject_id bigint, prediction_time timestamp_ntz, boolean_value boolean, occurs boolean, query string, duration_days double"
    return spark.createDataFrame([(s, day(t), *rest) for s, t, *rest in rows], schema)


def histories(spark, log, probes, n):
    out = sequences.history_sequences(times(spark, probes), log, code_vocab(log), n).collect()
    return {(r.subject_id, r.prediction_time): r for r in out}


def test_history_is_the_tail_up_to_the_prediction_time(spark):
    log = valued(spark, [(1, 0, "b", 1.0), (1, 0, "a", 2.0), (1, 2.5, "c", None), (1, 4, "a", 7.0), (2, 1, "a", 0.0)])
    got = histories(spark, log, [(1, -1), (1, 0), (1, 3), (1, 4), (3, 0)], 3)
    codes = {k[1]: [t.code for t in r.history] for k, r in got.items()}
    assert codes == {day(-1): [], day(0): [1, 2], day(3): [1, 2, 3], day(4): [2, 3, 1]}
    last = got[(1, day(4))].history
    assert [t.time_delta_days for t in last] == [0.0, 2.5, 1.5]
    assert math.isnan(last[1].numeric_value) and last[2].numeric_value == 7.0
    assert (3, day(0)) not in got  # no history at all


@pytest.mark.parametrize("n", [1, 4, 7])
def test_history_equals_definition(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([1, 1, 2]), rng.randint(0, 20) / 2, rng.choice("abc"), float(rng.randint(0, 3))) for _ in range(60)]
    log = valued(spark, rows)
    ids = {"a": 1, "b": 2, "c": 3}
    probes = [(s, t / 2 + 0.25 * (t % 2)) for s in (1, 2) for t in range(-1, 22)]
    got = histories(spark, log, probes, n)
    for s, t in probes:
        mine = sorted((t2, ids[c], v) for s2, t2, c, v in rows if s2 == s and t2 <= t)
        assert [(x.code, x.numeric_value) for x in got[(s, day(t))].history] == [(c, v) for _, c, v in mine[-n:]]


def test_query_goes_in_front_and_history_stays(spark):
    log = valued(spark, [(1, 0, "a", 1.0), (1, 1, "b", 2.0), (1, 2, "c", 3.0)])
    vocab = code_vocab(log)
    rows = labels(spark, [(1, 2, False, True, "c", 30.0), (1, 2, True, False, "unknown", 60.0)])
    out = {r["query"]: r for r in model_input(rows, log, vocab, 8).collect()}
    history = histories(spark, log, [(1, 2)], 8)[(1, day(2))].history
    for query, code in (("c", 3), ("unknown", 0)):
        seq = out[query].sequence
        assert seq[0].code == code == out[query].query_id
        assert math.isnan(seq[0].numeric_value) and math.isnan(seq[0].time_delta_days)
        assert seq[1:] == history
        assert len(out[query].attention_mask) == len(seq) + 1
        assert out[query].attention_mask[1] is True
    # A query outside the vocabulary is padding, so it is not attended.
    assert [out["c"].attention_mask[0], out["unknown"].attention_mask[0]] == [True, False]
    assert (out["c"].censor, out["c"].occurs, out["c"].duration_days) == (False, 1, 30.0)
    assert (out["unknown"].censor, out["unknown"].occurs) == (True, 0)
    assert out["unknown"].duration_years == pytest.approx(60 / 365)


def test_nested_layout_flattens_back(spark):
    log = valued(spark, [(1, 0, "a", 1.0), (1, 0, "b", 2.0), (1, 1, "a", 3.0)])
    out = sequences.event_sequences(times(spark, [(1, 5), (1, -1)]), log, code_vocab(log), 8)
    rows = out.withColumn("flat", sequences.flatten_events("events")).orderBy("prediction_time").collect()
    assert rows[0].events == []
    row = rows[1]
    assert [e.codes for e in row.events] == [[1, 2], [1]]
    assert [e.time_delta_days for e in row.events] == [0.0, 1.0]
    assert row.flat == [1, 2, 1]


def test_padding_reaches_the_longest_of_the_batch_only(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, [5])], "b int, codes array<int>")
    out = sorted(sequences.pad_and_mask(df, "codes", ["b"]).collect())
    assert [r.codes for r in out] == [[1, 2, 3], [4, 0, 0], [5]]
    assert [r.attention_mask for r in out] == [[True] * 3, [True, False, False], [True]]


def test_duration_slot_sits_after_the_query(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0],)], "v array<double>")
    out = [r[0] for r in df.select(sequences.insert_duration_slot("v", F.lit(9.0))).collect()]
    assert out == [[1.0, 9.0, 2.0, 3.0], [1.0, 9.0]]


def test_missing_and_empty_lists_explode_to_one_row(spark):
    df = spark.createDataFrame([(1, [day(0), day(1)]), (2, []), (3, None)], "s int, times array<timestamp_ntz>")
    assert sorted((r.s, r.time) for r in sequences.explode_times(df).collect() if r.time) == [(1, day(0)), (1, day(1))]
    assert sorted(r.s for r in sequences.explode_times(df).collect()) == [1, 1, 2, 3]


def test_invalid_sequences_are_found(spark):
    rows = [("good", [1, 2, 3]), ("short", [5]), ("long", [1] * 128), ("oov", [1, 200]), ("pad", [0, 0, 0])]
    df = spark.createDataFrame(rows, "name string, codes array<int>")
    bad = {r["name"]: r for r in quality.validate_sequences(df, 100, 128).collect()}
    assert set(bad) == {"short", "long", "oov", "pad"}
    assert bad["short"].too_short and bad["long"].too_long and bad["oov"].out_of_vocabulary and bad["pad"].all_padding
    without_slot = {r["name"] for r in quality.validate_sequences(df, 100, 128, has_duration=False).collect()}
    assert "long" not in without_slot


def test_annotations_have_one_value_each(spark):
    df = spark.createDataFrame([(1, True), (2, None), (3, True), (3, False)], "id int, censor boolean")
    assert {r.id for r in quality.validate_annotations(df, ["id"], ["censor"]).collect()} == {2, 3}


def test_optional_columns_pass_through(spark, events):
    log = events([(1, 0, "a"), (1, 2, "b")])
    rows = labels(spark, [(1, 1, True, False, "a", 30.0)])
    out = sequences.history_bounds(rows, log).first()
    assert out.asDict() == {
        "subject_id": 1, "prediction_time": day(1), "end_event_index": 1, "boolean_value": True, "occurs": False,
        "query": "a", "duration_days": 30.0,
    }
    assert sequences.history_bounds(rows.drop("query", "occurs"), log).columns == [
        "subject_id", "prediction_time", "end_event_index", "boolean_value", "duration_days",
    ]
