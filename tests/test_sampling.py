from __future__ import annotations

from collections import Counter

import pytest
from calendar_days import day
from pyspark.sql import functions as F

from askahead.operators import codesets, sampling
from askahead.operators.context import candidate_times, record_end
from askahead.operators.sequences import assign_batches, pad_and_mask, padding_share


def grid(spark, sizes):
    rows = [(s, day(i)) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "subject_id bigint, prediction_time timestamp_ntz")


KEYS = ["subject_id", "prediction_time"]


def test_per_subject_sample_is_seeded_and_layout_free(spark):
    df = grid(spark, {1: 200, 2: 3, 3: 20})
    a = set(sampling.sample_per_subject(df, KEYS, 5, 1).collect())
    assert Counter(r.subject_id for r in a) == {1: 5, 2: 3, 3: 5}
    assert set(sampling.sample_per_subject(df.repartition(13), KEYS, 5, 1).collect()) == a
    assert set(sampling.sample_per_subject(df, KEYS, 5, 2).collect()) != a


def test_grid_sample_is_distinct_and_complete_on_small_grids(spark):
    df = grid(spark, {1: 400, 2: 1})
    got = sampling.sample_grid(df, ["a", "b", "c"], range(30, 34), 20, 3).collect()
    assert len(set(got)) == len(got)
    counts = Counter(r.subject_id for r in got)
    # Subject 2 has 1 * 3 * 4 cells, fewer than asked for: all of them.
    assert counts == {1: 20, 2: 12}
    assert {(r.query, r.duration_days) for r in got if r.subject_id == 2} == {(c, d) for c in "abc" for d in range(30, 34)}
    assert set(sampling.sample_grid(df.repartition(7), ["a", "b", "c"], range(30, 34), 20, 3).collect()) == set(got)


def test_bounded_draws_follow_the_key_alone(spark):
    rows = spark.range(20_000).withColumn("x", F.col("id") % 7)
    key = F.md5(F.col("id").cast("string"))
    want = {r.id for r in rows.orderBy(key).limit(500).collect()}
    for layout in (rows, rows.repartition(9)):
        got = sampling.at_most(layout, key, 500)
        assert got.columns == ["id", "x"] and {r.id for r in got.collect()} == want
    assert sampling.at_most(rows, key, 50_000).count() == 20_000
    assert sampling.at_most(rows.limit(0), key, 5).count() == 0


def test_grid_sample_takes_any_vocabulary(spark):
    df = grid(spark, {1: 3, 2: 50})
    codes = spark.range(250_000).select(F.format_string("c%06d", "id").alias("code"))
    got = sampling.sample_grid(df, codes, range(30, 366), 20, 3)
    rows = got.collect()
    assert Counter(r.subject_id for r in rows) == {1: 20, 2: 20}
    assert set(sampling.sample_grid(df, codes.repartition(5), range(30, 366), 20, 3).collect()) == set(rows)


def test_numbers_follow_the_order_without_one_task(spark):
    rows = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("code"))
    got = codesets.numbered(rows, ["code"], "n").collect()
    assert [r.code for r in sorted(got, key=lambda r: r.n)] == sorted(r.code for r in got)
    assert sorted(r.n for r in got) == list(range(5000))
    assert codesets.numbered(rows.limit(0), ["code"], "n").count() == 0


def test_grid_sample_is_even(spark):
    df = grid(spark, {s: 10 for s in range(1500)})
    got = sampling.sample_grid(df, ["a", "b", "c", "d"], range(30, 40), 8, 5)
    for column, expected in (("query", 4), ("duration_days", 10), ("prediction_time", 10)):
        counts = [r["count"] for r in got.groupBy(column).count().collect()]
        mean = 1500 * 8 / expected
        assert len(counts) == expected
        assert all(abs(c - mean) < 5 * mean**0.5 for c in counts)


@pytest.mark.parametrize("min_context", [0, 1, 4])
@pytest.mark.parametrize("codes", [None, ["a", "c"]])
def test_log_sample_is_the_grid_sample_of_its_times(events, min_context, codes):
    rows = [(s, (7 * i * s) % 31 / 2, "abc"[i % 3]) for s in range(1, 9) for i in range(3 * s)]
    # Repeated rows, rows without a code, a time or a subject, and a subject without any time.
    rows += rows[:20] + [(3, 1.0, None), (3, 1.0, None), (4, None, "b"), (None, 2.0, "d"), (20, None, "a"), (21, 3.0, "a")]
    log = events(rows)
    universe = codesets.codes_or_all(codes, log)
    times = candidate_times(log, min_context)
    want = sampling.sample_grid(times, universe, range(30, 34), 9, 3).join(record_end(log), "subject_id")
    want = set(want.select(*KEYS, "query", "duration_days", "record_end_time").collect())
    assert want
    for light_rows in (0, 10, 1000):
        got = sampling.sample_log(log, codes, range(30, 34), 9, 3, min_context, light_rows)
        got = got.select(*KEYS, "query", "duration_days", "record_end_time").collect()
        assert len(got) == len(want) and set(got) == want


def test_code_draws(spark):
    codes = spark.createDataFrame([(f"c{i:03d}",) for i in range(50)] + [("X//TIME",), ("lower time",)], "code string")
    assert codesets.exclude_time_codes(codes).count() == 51
    drawn = codesets.sample_codes(codes, 10, 42).collect()
    assert sorted(r.pos for r in drawn) == list(range(10))
    repeated = codesets.sample_codes_repeated(codes, 10, 3, 42).collect()
    assert Counter(r.draw for r in repeated) == {0: 10, 1: 10, 2: 10}
    assert len({frozenset(r.code for r in repeated if r.draw == d) for d in range(3)}) == 3
    inside = codesets.sample_codes(codes, 10, 42)
    assert codesets.ood_complement(codes, inside).count() == 42
    with pytest.raises(Exception, match="cannot draw"):
        codesets.sample_codes(codes, 100, 1).collect()


def test_code_list_forms(spark):
    assert [tuple(r) for r in codesets.code_list(spark, ["b", "a", "b"]).collect()] == [("b", None, 0), ("a", None, 1), ("b", None, 2)]
    both = codesets.code_list(spark, {"ood": ["z"], "id": ["b", "b"]}).collect()
    assert [(r.code, r.bucket) for r in both] == [("b", "id"), ("b", "id"), ("z", "ood")]
    assert codesets.code_list(spark, {"codes": ["q"]}).first().code == "q"
    with pytest.raises(ValueError):
        codesets.code_list(spark, "a")


def test_manual_codes_count_as_in_distribution(spark):
    lists = [codesets.code_list(spark, c) for c in (["a"], ["z"], ["m", "z", None])]
    got = {(r.code, r.list_no): r.bucket for r in codesets.concat_code_lists(*lists).collect()}
    assert got == {("a", 0): "id", ("z", 1): "ood", ("m", 2): "id", ("z", 2): "ood"}


@pytest.mark.parametrize("size", [1, 64, 5000])
def test_batches_are_cut_from_the_order_of_lengths(spark, size):
    df = spark.range(1000).select(
        F.col("id").alias("subject_id"),
        F.lit(day(0)).alias("prediction_time"),
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 11).alias("n"),
    )
    rows = assign_batches(df, KEYS, "n", size, 1).collect()
    assert len(rows) == 1000 and len({r.subject_id for r in rows}) == 1000
    sizes = Counter(r.batch for r in rows)
    assert sorted(sizes) == list(range(-(-1000 // size)))
    assert all(n == size for b, n in sizes.items() if b < max(sizes))
    # No batch starts below the length at which the one before it ends.
    spans = [[r.n for r in rows if r.batch == b] for b in sorted(sizes)]
    assert all(max(a) <= min(b) for a, b in zip(spans, spans[1:], strict=False))
    again = {r.subject_id: r.batch for r in assign_batches(df.repartition(5), KEYS, "n", size, 1).collect()}
    assert again == {r.subject_id: r.batch for r in rows}
    assert assign_batches(df.limit(0), KEYS, "n", size).collect() == []


def test_padding_follows_the_batches(spark):
    df = spark.createDataFrame([(i, day(0), [1] * n) for i, n in enumerate([1, 9, 1, 9])], "subject_id bigint, prediction_time timestamp_ntz, codes array<int>")
    batched = assign_batches(df.withColumn("n", F.size("codes")), KEYS, "n", 2)
    share = padding_share(pad_and_mask(batched, "codes", ["batch"])).first()
    assert (share.n_slots, share.padding_share) == (20, 0.0)
