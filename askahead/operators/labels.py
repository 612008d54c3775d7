"""Labels: does the code occur inside the open interval after a prediction time?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askahead.functions import cell_start, interval_days, micros
from askahead.functions.columns import DAY_US
from askahead.operators.codesets import CodeSet
from askahead.operators.zones import eligible_with_reach, occurs_within, with_reach

LABEL_COLUMNS = ["subject_id", "prediction_time", "query", "duration_days", "censored", "occurs"]


def inside_open_interval(time: str, start: str, duration) -> F.Column:
    """Strictly after the start and strictly before the start plus the duration."""
    t, s = F.col(time), F.col(start)
    return (t > s) & (t < s + interval_days(duration))


def events_inside(probes: DataFrame, events: DataFrame, duration_days: int) -> DataFrame:
    """The events strictly inside each probe's interval: (subject_id, prediction_time, time, code).

    Joined on (subject, zone of the duration's width): an interval overlaps two zones at most.
    """
    width = duration_days * DAY_US
    first = cell_start(micros("prediction_time"), width)
    near = probes.withColumn("_zone", F.explode(F.array(first, first + F.lit(width))))
    placed = events.select("subject_id", "time", "code", cell_start(micros("time"), width).alias("_zone"))
    inside = near.join(placed, ["subject_id", "_zone"]).where(inside_open_interval("time", "prediction_time", duration_days))
    return inside.drop("_zone")


def null_when_censored(occurs: F.Column) -> F.Column:
    """A censored row has no label; a row with an unknown flag is in neither group."""
    return F.when(~F.col("censored"), occurs)


def label_grid(
    events: DataFrame, codes: CodeSet | None, durations: list[int], min_context: int, earlier: DataFrame | None = None
) -> DataFrame:
    """Labels of every eligible prediction time × code × duration, long."""
    reach = eligible_with_reach(events, codes, durations, min_context, earlier=earlier)
    left_us = F.col("record_end_us") - F.col("at_us")
    cells = reach.withColumn("_left_us", left_us).drop("record_end_us")
    if len(durations) == 1:
        cells = cells.withColumn("duration_days", F.lit(durations[0]))
    else:
        cells = cells.withColumn("duration_days", F.explode(F.lit(sorted(durations))))
    too_short = F.col("_left_us") < F.col("duration_days").cast("bigint") * F.lit(DAY_US)
    return (
        cells.withColumn("censored", too_short)
        .withColumn("occurs", null_when_censored(occurs_within(F.col("duration_days"))))
        .select(*LABEL_COLUMNS)
    )


def dense_labels(
    candidates: DataFrame, events: DataFrame, codes: CodeSet | None, duration_days: int
) -> DataFrame:
    """True/False for every uncensored candidate × code."""
    return (
        with_reach(candidates.where(~F.col("censored")), events, codes, [duration_days])
        .withColumn("occurs", occurs_within(duration_days))
        .select("subject_id", "prediction_time", "query", "occurs")
    )


def union_labels(censored: DataFrame, uncensored: DataFrame) -> DataFrame:
    return censored.unionByName(uncensored)


def split_by_censoring(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Censored and uncensored rows; a null flag falls out of both."""
    return rows.where(F.col("censored")), rows.where(~F.col("censored"))


def unpivot_labels(matrix: DataFrame, codes: list[str]) -> DataFrame:
    """Wide label matrix → one row per code; null labels are kept."""
    ids = [c for c in matrix.columns if c not in set(codes)]
    return matrix.unpivot(ids, codes, "query", "occurs")


def assemble_wide(labels: DataFrame, codes: list[str]) -> DataFrame:
    """One boolean column per code. A bounded view of the long table, for a few hundred codes."""
    keys = ["subject_id", "prediction_time", "censored"]
    return labels.groupBy(*keys).pivot("query", codes).agg(F.bool_or("occurs"))


def to_training_rows(labels: DataFrame) -> DataFrame:
    """Role names of a training table; a missing label counts as no occurrence."""
    return labels.withColumnsRenamed({"censored": "boolean_value"}).withColumn(
        "occurs", F.coalesce(F.col("occurs"), F.lit(False))
    )


def drop_unlabelled(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("occurs").isNotNull())
