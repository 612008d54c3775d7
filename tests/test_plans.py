"""Shapes of physical plans that matter at scale."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from askahead.catalog.base import orders_log, table
from askahead.catalog.sequences import click_inputs
from askahead.operators import sampling
from askahead.operators.context import candidate_times
from askahead.operators.zones import zone_map
from askahead.plans.evaluation import eval_tasks_from_log
from askahead.plans.labels import training_table
from askahead.plans.scoring import LEARNED, _with_tokens, baseline_two_head
from askahead.session import checkpointed

SF = "/root/testdata/sf0.001"
QUERIES = entry_point.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["label_table", "asof_next_event", "collate_sampled", "eval_tasks_from_log", "auroc_per_code", "model_input", "duration_grid"],
)
def test_no_nested_loop_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_only_event_columns_are_read(spark):
    text = plan(zone_map(orders_log(spark, SF), 30))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text
    assert "PushedFilters: [IsNotNull(o_orderdate)]" in text


def test_code_lists_reach_the_scan(spark):
    rows = table(spark, SF, "orders").where(F.col("o_orderpriority").isin(["1-URGENT", "5-LOW"])).select("o_custkey")
    assert "In(o_orderpriority, [1-URGENT,5-LOW])" in plan(rows)


def test_wanted_codes_reach_the_scan_of_labels(spark):
    log = orders_log(spark, SF)
    for df in (
        eval_tasks_from_log(log, ["1-URGENT"], 90, 5),
        training_table(log, ["1-URGENT"], range(30, 366), 20, 1, 5),
    ):
        assert "EqualTo(o_orderpriority,1-URGENT)" in plan(df) or "In(o_orderpriority, [1-URGENT])" in plan(df)


def test_samples_are_cut_before_the_shuffle(spark):
    keys = ["subject_id", "prediction_time"]
    text = plan(sampling.sample_per_subject(candidate_times(orders_log(spark, SF), 5), keys, 1, 43))
    limit = [line for line in text.splitlines() if "WindowGroupLimit" in line]
    assert any("Partial" in line for line in limit) and any("Final" in line for line in limit)


def test_events_are_combined_before_the_shuffle(spark):
    lines = plan(zone_map(orders_log(spark, SF), 30)).splitlines()
    kinds = [k for line in lines for k in ("Exchange", "partial_min") if k in line]
    assert kinds[-2:] == ["Exchange", "partial_min"]


def test_no_local_checkpoint_or_driver_collection_in_operators():
    import pathlib

    root = pathlib.Path(entry_point.__file__).parent / "askahead"
    for folder in ("operators", "functions", "plans"):
        for path in (root / folder).glob("*.py"):
            text = path.read_text()
            assert "localCheckpoint" not in text
            assert ".collect()" not in text and ".toPandas()" not in text


def test_the_baseline_makes_no_text_of_tokens(spark):
    rows = spark.createDataFrame([([2, 7, 7], 2)], "codes array<int>, query_id int")
    assert _with_tokens(rows).first().words == [7, 7, -3]


def test_the_baseline_needs_no_more_than_it_names(spark):
    inputs = checkpointed(click_inputs(spark, SF).select(*LEARNED).limit(300))
    assert baseline_two_head(inputs, n_features=16, max_iter=1).transform(inputs).count() == 300
