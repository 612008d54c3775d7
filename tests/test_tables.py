from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest
from calendar_days import day
from pyspark.sql import functions as F

from askahead.functions import code_slug, list_fingerprint
from askahead.operators import evalsets
from askahead.operators.skew import heavy_keys, join_to_unique, large_keys
from askahead.plans.labels import label_table
from askahead.schemas import EVENTS
from askahead.session import fresh_path
from askahead.sources import sinks
from askahead.sources.tables import label_shapes, read_events, read_labels, read_predictions, read_vocab, with_split
from askahead.streaming.incremental import current_rows, process_new_shards


SLUGS = {
    "HR": "HR__f187928fdb",
    "////": "c9b423aa80",
    "": "da39a3ee5e",
    "__a b//c__": "a_b_c__487ba7a5d2",
    "LAB//50912//mg/dLLAB//50912//mg/dLLAB//50912//mg/dL": "LAB_50912_mg_dLLAB_50912__0d862c6b26",
    "é//x": "x__47b11fbf25",
    "a.b-c_d": "a.b-c_d__c3472e213e",
    "日本": "44da6bbcf2",
    "_-_": "-__48ab534db7",
}


def test_slugs(spark):
    got = spark.createDataFrame([(c,) for c in SLUGS], "code string").select("code", code_slug("code").alias("s"))
    assert {r.code: r.s for r in got.collect()} == SLUGS


def test_fingerprint_depends_on_order(spark):
    def of(items):
        df = spark.createDataFrame([(c, i) for i, c in enumerate(items)], "code string, pos int")
        return df.agg(list_fingerprint("code", "pos")).first()[0]

    assert of(["b", "a"]) == hashlib.sha256(b"b\na\n").hexdigest()[:12]
    assert of(["b", "a"]) != of(["a", "b"])
    codes = spark.createDataFrame([("b",), ("a",), ("a",)], "code string")
    assert sinks.codes_fingerprint(codes, [31, 30]).first()[0] == hashlib.md5(b"a|a|b_30|31").hexdigest()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_keys_are_split_without_changing_the_result(spark, how):
    left = spark.range(1000).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(k, k * 10) for k in range(1, 900, 3)], "k bigint, w bigint")
    heavy = heavy_keys(left, ["k"], 20)
    assert [r.n_rows for r in heavy.collect()] == [400]
    got = join_to_unique(left, right, ["k"], heavy, F.col("v"), how, rows_per_task=20)
    assert sorted(got.collect()) == sorted(left.join(right, "k", how).collect())


def test_keys_of_many_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") < 600, "x").alias("b"))
    assert heavy_keys(rows, ["a", "b"], 1000) is None and large_keys(rows, ["a"], 143) is None
    assert {r.a for r in large_keys(rows, ["a"], 142).collect()} == {r.a for r in rows.groupBy("a").count().collect() if r["count"] > 142}
    # A stored table: plans that use it do not hold the counted rows again.
    assert "Range" not in heavy_keys(rows, ["b"], 100)._jdf.queryExecution().optimizedPlan().toString()
    assert heavy_keys(rows.limit(0), ["a"], 1) is None


def test_index_join_drops_missing_labels_and_external_join_keeps_them(spark, events):
    log = events([(1, 0, "a"), (1, 5, "b"), (1, 30, "a"), (2, 0, "b"), (2, 40, "a")])
    labels = label_table(log, ["a", "b"], [10], 1)
    index = labels.select("subject_id", "prediction_time", "censored").distinct()
    tasks = evalsets.index_label_join(index, labels, ["a", "b"])
    assert tasks.where(F.col("boolean_value")).count() == 0
    outside = spark.createDataFrame([(1, day(30), True), (2, day(0), False)], "subject_id bigint, prediction_time timestamp_ntz, boolean_value boolean")
    joined = evalsets.external_label_join(outside, labels, ["a"]).collect()
    assert {(r.subject_id, r.boolean_value, r.occurs, r.task_label) for r in joined} == {(1, True, None, True), (2, False, False, False)}
    stranger = outside.unionByName(spark.createDataFrame([(7, day(0), True)], outside.schema))
    assert evalsets.unmatched_external(stranger, labels).count() == 1
    with pytest.raises(Exception, match="no label row"):
        evalsets.external_label_join(stranger, labels, ["a"]).collect()


def test_label_table_write_skips_finished_partitions(spark, events):
    log = events([(s, t, c) for s in range(20) for t, c in ((0, "a"), (3, "b"), (9, "a"))])
    path = fresh_path(spark, "labels")
    built = []

    def build(durations):
        built.append(durations)
        return with_split(label_table(log, ["a", "b"], durations, 1))

    splits = ["train", "tuning", "held_out"]
    assert len(sinks.write_label_table(spark, build, path, [2], splits)) == 3
    assert sinks.write_label_table(spark, build, path, [2], splits) == []
    assert sorted({d for d, _ in sinks.write_label_table(spark, build, path, [2, 4], splits)}) == [4]
    assert built == [[2], [4]]  # finished durations are not computed again
    rows = build([2, 4])
    stored = spark.read.parquet(path).select(rows.columns)
    assert sorted(map(str, stored.collect())) == sorted(map(str, rows.collect()))


def test_exclusive_writes(spark):
    df = spark.createDataFrame([("a", 0)], "code string, pos int")
    root = fresh_path(spark, "codes")
    sinks.write_code_sample(df, root, "abc", 1)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_code_sample(df, root, "abc", 1)
    path = fresh_path(spark, "m.csv")
    sinks.write_csv(df, path)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_csv(df, path)
    sinks.write_csv(df, path, overwrite=True)
    root = fresh_path(spark, "train")
    rows = df.withColumn("split", F.lit("train"))
    assert sinks.write_collated(rows, root, "f") == sinks.write_collated(rows.limit(0), root, "f")
    assert spark.read.parquet(f"{root}/collated/f").count() == 1


def test_a_folder_left_by_an_interrupted_run_is_written_again(spark):
    root = fresh_path(spark, "train")
    rows = spark.createDataFrame([("a", "train")], "code string, split string")
    (rows.where("false").write.partitionBy("split").parquet(f"{root}/collated/f"))
    assert spark.read.parquet(sinks.write_collated(rows, root, "f")).count() == 1


def test_a_missing_vocabulary_is_empty_with_a_warning(spark):
    with pytest.warns(UserWarning, match="no vocabulary"):
        assert read_vocab(spark, fresh_path(spark, "codes")).count() == 0


def test_events_are_read_once_each(spark, events):
    path = fresh_path(spark, "events")
    log = events([(1, 0, "a"), (1, 0, "a"), (2, None, "b")])
    log.withColumn("other", F.lit(1)).write.parquet(path)
    assert set(read_events(spark, path).collect()) == set(log.collect())


def test_prediction_round_trip(spark):
    rows = [(1, day(0.123456), 0.25, 'a,"b')]
    df = spark.createDataFrame(rows, "subject_id bigint, prediction_time timestamp_ntz, occurs_probs double, code string")
    path = sinks.write_predictions(df, fresh_path(spark, "p.csv"))
    back = read_predictions(spark, path)
    assert back.select(df.columns).collect() == df.collect()


def test_rules_are_checked_while_a_table_is_written(spark):
    def build(session):
        return session.range(100).select("id", F.when(F.col("id") != 7, F.col("id") % 2 == 0).alias("ok"))

    path = fresh_path(spark, "checked")
    counts = sinks.write_checked(spark, build, path, {"negative": F.col("id") < 0}, {"no_value": F.col("ok").isNull()})
    assert counts == {"n_rows": 100, "negative": 0, "no_value": 1}
    assert spark.read.parquet(path).count() == 100
    # One broken row undoes the write; a table that was there before is not touched.
    other = fresh_path(spark, "checked")
    with pytest.raises(sinks.BrokenRule, match="no_value") as error:
        sinks.write_checked(spark, build, other, {"no_value": F.col("ok").isNull(), "negative": F.col("id") < 0})
    assert error.value.counts == {"no_value": 1}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(other)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_checked(spark, build, path, {"no_value": F.col("ok").isNull()})
    assert spark.read.parquet(path).count() == 100


def test_code_reports_are_not_replaced_by_accident(spark):
    rows = [("a", "a__1", "id", 0.5, None), ('b,"c', "b__2", "ood", 1.0, 0.25)]
    report = spark.createDataFrame(rows, "code string, code_slug string, bucket string, occurs_auc double, censor_auc double")
    root, at = fresh_path(spark, "reports"), dt.datetime(2024, 5, 6, 7, 8, 9)
    path = sinks.write_code_report(report, root, "model", at)
    assert path.endswith("/model_20240506_070809.csv")
    assert sorted(spark.read.schema(sinks.REPORT).csv(path, header=True).select(report.columns).collect()) == sorted(report.collect())
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_code_report(report, root, "model", at)
    sinks.write_code_report(report.limit(1), root, "model", at, overwrite=True)
    assert spark.read.csv(path, header=True).count() == 1


def test_footers_of_many_files_are_compared_by_tasks(spark):
    path = fresh_path(spark, "l")
    df = spark.range(300).select(F.col("id").alias("subject_id"), F.lit(day(0)).alias("prediction_time"), F.lit(True).alias("occurs"))
    df.repartition(60, "subject_id").write.parquet(path)
    shapes = label_shapes(spark, [path]).collect()
    assert len(shapes) == 1 and shapes[0].n_files > 40
    assert read_labels(spark, [path]).count() == 300
    df.withColumn("occurs", F.lit("yes")).limit(3).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="other label columns"):
        read_labels(spark, [path])


def test_label_files_must_agree(spark):
    a = spark.createDataFrame([(1, day(0), True)], "subject_id bigint, prediction_time timestamp_ntz, occurs boolean")
    b = a.withColumn("query", F.lit("x")).withColumn("extra", F.lit(1))
    paths = [fresh_path(spark, "l") for _ in range(3)]
    for df, path in zip((a, b, b), paths, strict=True):
        df.write.parquet(path)
    assert read_labels(spark, paths[1:]).columns == ["subject_id", "prediction_time", "occurs", "query"]
    with pytest.raises(ValueError, match="other label columns"):
        read_labels(spark, paths[:2])


@pytest.mark.parametrize("seed", range(3))
def test_deliveries_equal_one_run_over_everything(spark, events, seed):
    rng = random.Random(seed)
    rows = sorted(
        {(rng.choice([1, 1, 2, 3, 4]), rng.randint(0, 120) / 2, rng.choice("ab")) for _ in range(90)}, key=lambda r: r[1]
    )
    rows += [(5, None, "a")]
    source, target, checkpoint = (fresh_path(spark, n) for n in ("src", "out", "ckpt"))

    def build(log, earlier):
        return label_table(log, ["a", "b"], [3, 8], 4, earlier)

    def run():
        process_new_shards(spark, source, EVENTS, target, checkpoint, build, 8)

    cuts = [0, 30, 31, 60, len(rows)]
    for start, end in zip(cuts, cuts[1:], strict=False):
        # One delivery may hold a subject's events in several files, and repeat rows.
        part = rows[start:end] + rows[start:end][:2]
        events(part).repartition(2).write.parquet(source, mode="append")
        run()
        want = label_table(events(rows[:end]), ["a", "b"], [3, 8], 4)
        assert sorted(map(str, current_rows(spark, target).select(want.columns).collect())) == sorted(map(str, want.collect()))
    before = current_rows(spark, target).count()
    run()
    assert current_rows(spark, target).count() == before  # no file is read twice


def test_events_that_would_change_final_labels_are_refused(spark, events):
    source, target, checkpoint = (fresh_path(spark, n) for n in ("src", "out", "ckpt"))

    def run():
        build = lambda log, earlier: label_table(log, ["a"], [5], 1, earlier)
        process_new_shards(spark, source, EVENTS, target, checkpoint, build, 5)

    events([(1, 0, "a"), (1, 20, "a")]).write.parquet(source, mode="append")
    run()
    # Inside the open horizon an event may come late.
    events([(1, 16, "a")]).write.parquet(source, mode="append")
    run()
    got = {r.prediction_time: r.occurs for r in current_rows(spark, target).collect()}
    assert got == {day(0): False, day(16): None, day(20): None}
    events([(1, 3, "a")]).write.parquet(source, mode="append")
    with pytest.raises(Exception, match="open horizon"):
        run()
