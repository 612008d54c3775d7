from __future__ import annotations

import datetime as dt
import random

import pytest
from calendar_days import day
from pyspark.sql import functions as F

from askahead.operators import context, timeline, zones
from askahead.operators.labels import assemble_wide, label_grid, unpivot_labels
from askahead.operators.quality import null_labels, require_zero
from askahead.plans.evaluation import external_task_tables, external_tasks_from_log
from askahead.plans.labels import duration_counts, label_sampled, label_table, label_times


def labels_of(df):
    return {(r.subject_id, r.prediction_time, r.query, r.duration_days): (r.censored, r.occurs) for r in df.collect()}


def brute(rows, codes, durations, min_context):
    """Labels straight from the definition, over plain Python rows."""
    rows = set(rows)
    out = {}
    for s in {r[0] for r in rows}:
        mine = [(t, c) for s2, t, c in rows if s2 == s and t is not None]
        end = max((t for t, _ in mine), default=None)
        for pt in {t for t, _ in mine}:
            if sum(t <= pt for t, _ in mine) < min_context:
                continue
            for c in codes:
                for d in durations:
                    gone = end - pt < d
                    hit = any(c2 == c and pt < t < pt + d for t, c2 in mine)
                    out[(s, day(pt), c, d)] = (gone, None if gone else hit)
    return out


def test_interval_ends_are_open(events):
    log = events([(1, 0, "a"), (1, 10, "b"), (1, 30, "c")])
    got = labels_of(label_table(log, ["a", "b", "c"], [10], 1))
    assert got[(1, day(0), "a", 10)] == (False, False)  # at the prediction time itself
    assert got[(1, day(0), "b", 10)] == (False, False)  # exactly at its end
    assert labels_of(label_table(log, ["b"], [11], 1))[(1, day(0), "b", 11)] == (False, True)


def test_record_end_exactly_at_the_horizon_is_not_censored(events):
    log = events([(1, 0, "a"), (1, 30, "a")])
    assert labels_of(label_table(log, ["a"], [30], 1))[(1, day(0), "a", 30)] == (False, False)
    assert labels_of(label_table(log, ["a"], [31], 1))[(1, day(0), "a", 31)] == (True, None)


def test_context_counts_distinct_rows_and_ties_together(events):
    log = events([(1, 0, "a"), (1, 0, "a"), (1, 1, "a"), (1, 1, "b"), (1, 1, "c"), (1, None, "d"), (1, 5, "a")])
    times = {r.prediction_time for r in context.candidate_times(log, 3).collect()}
    assert times == {day(1), day(5)}
    counts = {r.time: r.context_count for r in context.context_count(log).collect()}
    assert counts == {day(0): 1, day(1): 4, day(5): 5}
    assert {r.prediction_time for r in context.candidate_times(log, 5).collect()} == {day(5)}
    assert context.candidate_times(log, 6).count() == 0


def test_no_context_needed_makes_every_time_a_candidate(events):
    log = events([(1, 0, "a"), (1, None, "b")])
    assert {r.prediction_time for r in context.candidate_times(log, 0).collect()} == {day(0), None}
    assert labels_of(label_table(log, ["a"], [1], 0)) == {(1, day(0), "a", 1): (True, None)}


@pytest.mark.parametrize("seed", range(4))
def test_grid_equals_definition(events, seed):
    rng = random.Random(seed)
    # Whole and fractional days before and after the epoch-aligned zone borders, one heavy subject.
    rows = [
        (rng.choice([1, 1, 1, 2, 3]), rng.choice([rng.randint(0, 60), rng.randint(0, 240) / 4]), rng.choice("abcd"))
        for _ in range(120)
    ]
    log = events(rows)
    codes, durations = ["a", "b", "never"], [3, 7, 8, 20]
    expected = brute(rows, codes, durations, 4)
    assert labels_of(label_table(log, codes, durations, 4)) == expected
    # The same when the heavy subject, or all of them, are answered from the zone map.
    light_rows = rng.choice([1, 30])
    split = zones.eligible_with_reach(log, codes, durations, 4, light_rows=light_rows)
    hits = {
        (r.subject_id, r.prediction_time, r.query)
        for r in split.where(zones.occurs_within(7) & (F.col("record_end_us") - F.col("at_us") >= 7 * 86_400_000_000)).collect()
    }
    assert hits == {(s, t, c) for (s, t, c, d), (_, hit) in expected.items() if d == 7 and hit}


def test_labels_of_light_subjects_take_one_shuffle(events):
    log = events([(1, 0, "a"), (1, 5, "b"), (2, 3, "a")])
    plan = label_table(log, ["a", "b"], [3], 1)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") == 1 and "Join" not in initial


def test_shuffled_zones_do_not_follow_the_durations(events):
    rng = random.Random(8)
    rows = [(s, rng.randint(0, 3000) / 2, rng.choice("abcd")) for s in range(10) for _ in range(60)]
    log = events(rows)
    codes = ["a", "b", "c", "d"]
    got = labels_of(label_table(log, codes, [1, 365], 1))
    assert got == brute(rows, codes, [1, 365], 1)
    spots = log.select("subject_id", (F.lit(0).cast("bigint")).alias("zone"))
    text = zones._outlooks(log, spots, 1, 365)._jdf.queryExecution().optimizedPlan().toString()
    # Each zone goes to two cells, however many zones the horizon holds.
    assert "sequence(" not in text and "explode(array(" in text


def test_duration_counts_equal_the_label_table(events):
    rng = random.Random(4)
    rows = [(rng.randint(1, 4), rng.randint(0, 160) / 4, rng.choice("abc")) for _ in range(120)]
    log = events(rows)
    durations = range(2, 17, 3)
    grid = label_table(log, ["a", "b", "x"], list(durations), 2)
    want = grid.groupBy("duration_days", "query").agg(
        F.count_if("occurs").alias("n_true"), F.count_if(~F.col("occurs")).alias("n_false"), F.count_if("censored").alias("n_censored")
    )
    got = duration_counts(log, ["a", "b", "x"], durations, 2)
    assert set(got.select(want.columns).collect()) == set(want.collect())


def test_cohorts_can_be_labelled_from_the_log(spark, events):
    log = events([(1, 0, "a"), (1, 5, "b"), (1, 30, "a"), (2, 0, "b"), (2, 40, "a")])
    key = "subject_id bigint, prediction_time timestamp_ntz, boolean_value boolean"
    cohort = spark.createDataFrame([(1, day(30), True), (2, day(0), False)], key)
    whole = external_task_tables(cohort, label_table(log, ["a", "b"], [10], 1), ["a"])
    assert set(external_tasks_from_log(cohort, log, ["a"], 10, 1).collect()) == set(whole.collect())
    with pytest.raises(Exception, match="no label row"):
        external_tasks_from_log(cohort, log, ["a"], 10, 2).collect()


def test_zones_before_the_epoch(spark):
    import datetime as dt

    from askahead.schemas import EVENTS

    at = dt.datetime(1969, 12, 30, 12)
    rows = [(1, at, "a"), (1, at + dt.timedelta(days=2), "b"), (1, at + dt.timedelta(days=9), "c")]
    got = labels_of(label_table(spark.createDataFrame(rows, EVENTS), ["b"], [2, 3], 1))
    assert got[(1, at, "b", 2)] == (False, False)
    assert got[(1, at, "b", 3)] == (False, True)


def test_sampled_and_given_times_get_the_same_labels(events):
    rng = random.Random(11)
    rows = [(rng.randint(1, 3), rng.randint(0, 400) / 4, rng.choice("ab")) for _ in range(80)]
    log = events(rows)
    grid = label_table(log, ["a", "b"], [5, 9], 1)
    asked = grid.select("subject_id", "prediction_time", "query", "duration_days").join(
        context.record_end(log), "subject_id"
    )
    assert labels_of(label_sampled(asked, log, 5)) == labels_of(grid)
    times = grid.select("subject_id", "prediction_time").distinct()
    assert labels_of(label_times(times, log, ["a", "b"], 9)) == labels_of(grid.where("duration_days = 9"))


def test_a_question_shorter_than_the_zone_is_an_error(events):
    log = events([(1, 0, "a"), (1, 9, "b")])
    asked = label_table(log, ["a"], [2], 1).select("subject_id", "prediction_time", "query", "duration_days")
    with pytest.raises(Exception, match="shorter than the zone"):
        label_sampled(asked.join(context.record_end(log), "subject_id"), log, 5).collect()


def test_occurrence_stays_true_for_longer_durations(events):
    rng = random.Random(5)
    log = events([(1, rng.randint(0, 100), rng.choice("abc")) for _ in range(60)])
    cells = labels_of(label_table(log, ["a", "b", "c"], [4, 9, 16], 1))
    for (s, t, c, d), (gone, hit) in cells.items():
        for longer in (9, 16):
            if longer > d and hit and not cells[(s, t, c, longer)][0]:
                assert cells[(s, t, c, longer)][1]


def test_next_event_is_strictly_later_and_history_bound_includes_ties(spark, events):
    log = events([(1, 0, "a"), (1, 0.5, "a"), (1, 3, "a"), (2, 1, "b")])
    probes = log.select("subject_id", F.col("time").alias("prediction_time"))
    got = {
        (r.subject_id, r.prediction_time): r.next_time
        for r in timeline.next_event_time(probes, log, ["subject_id"], "prediction_time").collect()
    }
    assert got == {(1, day(0)): day(0.5), (1, day(0.5)): day(3), (1, day(3)): None, (2, day(1)): None}
    asked = spark.createDataFrame(
        [(1, day(-1)), (1, day(0)), (1, day(2)), (9, day(0))], "subject_id bigint, prediction_time timestamp_ntz"
    )
    bounds = {
        (r.subject_id, r.prediction_time): r.end_event_index
        for r in timeline.history_bound(asked, log, ["subject_id"], "prediction_time").collect()
    }
    assert bounds == {(1, day(-1)): 0, (1, day(0)): 1, (1, day(2)): 2}


@pytest.mark.parametrize("light_rows", [10_000, 1])
def test_next_times_by_gaps_equal_definition(spark, events, monkeypatch, light_rows):
    monkeypatch.setattr(timeline, "_LIGHT_ROWS", light_rows)
    rng = random.Random(light_rows)
    # Gaps from microseconds to decades, before and after the epoch.
    spans = [1e-11, 3e-9, 1e-6, 1e-3, 1, 40, 4000, -9000, -25_000]
    rows = [(rng.choice([1, 1, 2]), round(rng.choice(spans) * rng.randint(0, 9), 11), rng.choice("abc")) for _ in range(120)]
    log = events([*rows, (3, None, "a"), (4, 2, None)])
    held = [(r.subject_id, r.time, r.code) for r in log.collect() if r.time]
    probes = [(s, t + dt.timedelta(microseconds=d)) for s, t, _ in held for d in (-1, 0, 1)] + [(9, day(0))]
    table = spark.createDataFrame(probes, "subject_id bigint, prediction_time timestamp_ntz")
    want = {
        (s, at, c, min(t for s2, t, c2 in held if s2 == s and c2 == c and t > at))
        for s, at in probes
        for c in "abc"
        if any(s2 == s and c2 == c and t > at for s2, t, c2 in held)
    }
    got = timeline.next_times(table, log)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    dense = timeline.with_all_codes(got, table, F.array(F.lit("a"), F.lit("z"))).collect()
    assert len(dense) == 2 * len(set(probes)) and all(r.next_time is None for r in dense if r.code == "z")


@pytest.mark.parametrize("few_rows", [1000, 20, 0])
def test_occurrences_equal_definition(spark, events, few_rows):
    rng = random.Random(few_rows)
    rows = [(rng.choice([1, 1, 1, 2]), rng.randint(0, 160) / 4, rng.choice(["a", "b", "c", None])) for _ in range(80)]
    log = events([*rows, (2, None, "a")])
    times = sorted({(s, t) for s, t, _ in rows} | {(1, -3), (7, 0)})
    table = spark.createDataFrame([(s, day(t)) for s, t in times], "subject_id bigint, prediction_time timestamp_ntz")
    for codes in (None, ["a", "z"]):
        got = [tuple(r) for r in zones.occurrences(table, log, 5, codes, few_rows).collect()]
        want = {(s, day(t), c) for s, t in times for s2, t2, c in rows if s2 == s and t < t2 < t + 5 and c and (not codes or c in codes)}
        assert sorted(got) == sorted(want)


def test_running_equals_plain_window_inside_one_second(spark):
    rng = random.Random(2)
    import datetime as dt

    rows = sorted({(rng.choice([1, 1, 2]), day(0) + dt.timedelta(microseconds=rng.randint(0, 3_000_000))) for _ in range(200)})
    df = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(rows)], "k int, at timestamp_ntz, v bigint")
    run = timeline.running(df, ["k"], "at", [timeline.Running("total", F.col("v"))])
    seen = {}
    for s, t in rows:
        seen[(s, t)] = sum(i for i, (s2, t2) in enumerate(rows) if s2 == s and t2 <= t)
    assert {(r.k, r["at"]): r.total for r in run.collect()} == seen


def test_wide_and_back_keeps_nulls(events):
    log = events([(1, 0, "a"), (1, 5, "b"), (1, 20, "a")])
    grid = label_grid(log, ["a", "b"], [10], 1)
    wide = assemble_wide(grid, ["a", "b"])
    back = unpivot_labels(wide, ["a", "b"])
    key = lambda rows: {(r.prediction_time, r.query): r.occurs for r in rows}
    assert key(back.collect()) == key(grid.collect())
    assert None in key(back.collect()).values()


def test_null_label_check(events, spark):
    log = events([(1, 0, "a"), (1, 50, "b")])
    grid = label_grid(log, ["a"], [10], 1)
    assert require_zero(null_labels(grid), "nulls").first()[0] == 0
    broken = grid.withColumn("occurs", F.lit(None).cast("boolean"))
    with pytest.raises(Exception, match="nulls"):
        require_zero(null_labels(broken), "nulls").collect()


def test_durations_must_be_positive(events):
    with pytest.raises(ValueError):
        label_table(events([(1, 0, "a")]), ["a"], [0, 3], 1)
