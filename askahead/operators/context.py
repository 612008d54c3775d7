"""Prediction times: where enough context has been seen, and whether the follow-up is long enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askahead.functions import from_micros, micros
from askahead.functions.columns import DAY_US
from askahead.operators.skew import ROWS_PER_TASK, heavy_keys, join_to_unique
from askahead.operators.timeline import Running, running


def visits(events: DataFrame) -> DataFrame:
    """One row per subject and time with the number of distinct event rows at that time."""
    return (
        events.where(F.col("time").isNotNull())
        .groupBy("subject_id", "time")
        .agg(F.count_distinct(F.struct("code")).alias("n_events"))
    )


def context_count(events: DataFrame) -> DataFrame:
    """Running number of event rows per subject at each event time; rows of one time share the count."""
    return running(visits(events), ["subject_id"], "time", [Running("context_count", F.col("n_events"))])


def context_start(events: DataFrame, min_context: int, earlier: DataFrame | None = None) -> DataFrame:
    """First time of each subject at which ``min_context`` distinct event rows have been seen.

    ``earlier`` has the number ``n_earlier`` of rows that came before these events, for the subjects that had any.

    That is the time of the subject's ``min_context``-th row in time order, whichever way ties are broken.
    The running count never falls, so the times that qualify are exactly those from this one on. Each task
    passes on the first ``min_context`` rows of a subject only.
    """
    by_time = Window.partitionBy("subject_id").orderBy("time")
    numbered = (
        events.where(F.col("time").isNotNull())
        .select("subject_id", "time", "code")
        .distinct()
        .withColumn("_nth", F.row_number().over(by_time))
    )
    if earlier is None:
        found = numbered.where(F.col("_nth") == min_context)
    else:
        missing = F.greatest(min_context - F.coalesce("n_earlier", F.lit(0)), F.lit(1))
        cut = numbered.where(F.col("_nth") <= min_context)
        found = cut.join(earlier, "subject_id", "left").where(F.col("_nth") == missing)
    return found.select("subject_id", F.col("time").alias("context_start"))


def record_end(events: DataFrame) -> DataFrame:
    return events.groupBy("subject_id").agg(F.max("time").alias("record_end_time"))


def _from_context_start(events: DataFrame, bounds: DataFrame, rows_per_task: int) -> DataFrame:
    """Distinct event times from ``context_start`` on, with the other columns of ``bounds``."""
    times = events.where(F.col("time").isNotNull()).select("subject_id", "time").distinct()
    heavy = heavy_keys(events, ["subject_id"], rows_per_task)
    joined = join_to_unique(times, bounds, ["subject_id"], heavy, F.col("time"), rows_per_task=rows_per_task)
    return (
        joined.where(F.col("time") >= F.col("context_start"))
        .drop("context_start")
        .withColumnRenamed("time", "prediction_time")
    )


def candidate_times(events: DataFrame, min_context: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Distinct (subject_id, prediction_time) with at least ``min_context`` event rows up to then."""
    if min_context < 1:
        return events.select("subject_id", F.col("time").alias("prediction_time")).distinct()
    return _from_context_start(events, context_start(events, min_context), rows_per_task)


def subject_times(events: DataFrame, min_context: int, n_tasks: int) -> DataFrame:
    """Candidate times of each subject that has any, in order, as the array ``times``, with the end of its record.

    One shuffle by subject serves the distinct rows, the context and the record's end. A subject's rows meet in one task, so
    it is for subjects with few; ``min_context`` is at least 1.
    """
    rows = events.where(F.col("time").isNotNull()).select("subject_id", micros("time").alias("_us"), "code")
    every = (
        rows.repartition(n_tasks, "subject_id")
        .distinct()
        .groupBy("subject_id")
        .agg(F.sort_array(F.collect_list("_us")).alias("_every"))
        .where(F.size("_every") >= min_context)
    )
    start = F.array_position("_every", F.get("_every", F.lit(min_context - 1)))
    times = F.array_distinct(F.slice("_every", start.cast("int"), F.size("_every")))
    return every.select("subject_id", times.alias("times"), from_micros(F.element_at("_every", -1)).alias("record_end_time"))


def numbered_times(events: DataFrame, min_context: int, n_tasks: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Candidate times with their place ``_nth`` among all times of the subject, for subjects of any length.

    Rows are dealt by subject and time, so that a task's share does not depend on how well they compress. Only where one
    time owns more than ``rows_per_task`` rows, they are combined before the shuffle instead.
    """
    timed = events.where(F.col("time").isNotNull()).select("subject_id", "time", "code")
    key = ["subject_id", "time"]
    dealt = timed.repartition(n_tasks, *key) if heavy_keys(timed, key, rows_per_task) is None else timed
    measures = [Running("_count", F.col("n_events")), Running("_nth", F.lit(1))]
    counted = running(visits(dealt), ["subject_id"], "time", measures)
    return counted.where(F.col("_count") >= min_context).select("subject_id", F.col("time").alias("prediction_time"), "_nth")


def candidates_with_record_end(
    events: DataFrame, min_context: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Candidate times with the end of the subject's record: one join for both per-subject bounds."""
    if min_context < 1:
        # Every time counts, those without a value included.
        heavy = heavy_keys(events, ["subject_id"], rows_per_task)
        every = candidate_times(events, min_context)
        return join_to_unique(
            every, record_end(events), ["subject_id"], heavy, F.col("prediction_time"), rows_per_task=rows_per_task
        )
    bounds = context_start(events, min_context).join(record_end(events), "subject_id")
    return _from_context_start(events, bounds, rows_per_task)


def censor_flag(duration: Column | str | int) -> Column:
    """Less than the duration is left on record after the prediction time (strictly)."""
    days = F.lit(duration) if isinstance(duration, int) else F.col(duration) if isinstance(duration, str) else duration
    return (micros("record_end_time") - micros("prediction_time")) < days.cast("bigint") * F.lit(DAY_US)


def censored_candidates(events: DataFrame, min_context: int, duration_days: int) -> DataFrame:
    return candidates_with_record_end(events, min_context).select(
        "subject_id", "prediction_time", censor_flag(duration_days).alias("censored")
    )


def row_index(candidates: DataFrame) -> DataFrame:
    """Dense zero-based number of each distinct prediction time within its subject, in time order."""
    numbered = running(candidates.select("subject_id", "prediction_time"), ["subject_id"], "prediction_time", [Running("_nth", F.lit(1))])
    return numbered.withColumn("row_index", F.col("_nth") - 1).drop("_nth")
