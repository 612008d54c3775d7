"""Label table and training table as single plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askahead.functions.columns import DAY_US
from askahead.operators.codesets import CodeSet, only_codes
from askahead.operators.context import censor_flag, record_end
from askahead.operators.labels import LABEL_COLUMNS, label_grid, null_when_censored, to_training_rows
from askahead.operators.sampling import sample_log, sample_per_subject
from askahead.operators.zones import eligible_with_reach, label_questions, occurs_within, with_reach

TRAINING_COLUMNS = ["subject_id", "prediction_time", "boolean_value", "occurs", "query", "duration_days"]


def label_table(
    events: DataFrame,
    codes: CodeSet | None,
    durations: list[int],
    min_context: int = 50,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Every eligible prediction time × code × duration with its censoring flag and label.

    Repeated event rows make no difference. ``earlier`` counts event rows per subject that came before these events, where
    a log is labelled in parts. Use it for bounded code lists; for training sets over a large vocabulary see ``training_table``.
    """
    return label_grid(events, codes, durations, min_context, earlier)


def duration_counts(events: DataFrame, codes: CodeSet | None, durations: range, min_context: int = 50) -> DataFrame:
    """Per code and duration the number of true, false and censored cells of the label table, without its rows.

    Along the durations a cell is false, then true from the first one that reaches the code, then censored
    from the first one that outlasts the record. So each cell counts at two durations only, and running sums
    over the durations give the rest.
    """
    reach = eligible_with_reach(events, codes, [durations.start, durations[-1]], min_context)
    at = F.col("at_us")
    # First duration that is longer than the record, and first that ends after the code's next time.
    ends = F.floor((F.col("record_end_us") - at) / DAY_US) + 1
    hits = F.coalesce(F.floor((F.col("reach_us") - at) / DAY_US) + 1, ends)

    def bounded(day: F.Column) -> F.Column:
        return F.least(F.greatest(day, F.lit(durations.start)), F.lit(durations.stop)).cast("int")

    cells = reach.select("query", bounded(ends).alias("_ends"), bounded(F.least(hits, ends)).alias("_hits"))
    steps = (
        cells.groupBy("query", "_ends", "_hits")
        .agg(F.count("*").alias("n"))
        .select("query", "n", F.inline(F.array(
            F.struct(F.col("_hits").alias("_day"), F.lit(1).alias("_hit"), F.lit(0).alias("_end")),
            F.struct(F.col("_ends").alias("_day"), F.lit(0).alias("_hit"), F.lit(1).alias("_end")),
        )))
    )
    days = F.explode(F.sequence(F.lit(durations.start), F.lit(durations.stop - 1))).alias("_day")
    every = steps.select("query").distinct().select("query", F.lit(0).cast("bigint").alias("n"), days)
    every = every.select("query", "n", "_day", F.lit(0).alias("_hit"), F.lit(0).alias("_end"))
    per_day = (
        steps.unionByName(every)
        .groupBy("query", "_day")
        .agg(F.sum(F.col("n") * F.col("_hit")).alias("_hit"), F.sum(F.col("n") * F.col("_end")).alias("_end"))
    )
    so_far = Window.partitionBy("query").orderBy("_day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_end").over(Window.partitionBy("query"))
    counted = per_day.select(
        F.col("_day").alias("duration_days"),
        "query",
        (F.sum("_hit").over(so_far) - F.sum("_end").over(so_far)).alias("n_true"),
        (total - F.sum("_hit").over(so_far)).alias("n_false"),
        F.sum("_end").over(so_far).alias("n_censored"),
    )
    return counted.where(F.col("duration_days").isin(list(durations)))


def label_times(times: DataFrame, events: DataFrame, codes: CodeSet | None, duration_days: int) -> DataFrame:
    """Label rows of given prediction times, such as a sample or a cohort, for all codes.

    Work follows the given times: nothing is labelled that is not asked for.
    """
    # A few times per subject, so neither join has a large key.
    known = times.select("subject_id", "prediction_time").distinct().join(record_end(events), "subject_id")
    reach = with_reach(known, events, codes, [duration_days])
    return (
        reach.withColumn("duration_days", F.lit(duration_days))
        .withColumn("censored", censor_flag(duration_days))
        .where(F.col("censored").isNotNull())
        .withColumn("occurs", null_when_censored(occurs_within(duration_days)))
        .select(*LABEL_COLUMNS)
    )


def label_sampled(questions: DataFrame, events: DataFrame, min_duration: int) -> DataFrame:
    """Labels of chosen (time, code, duration) questions that carry ``record_end_time``."""
    asked = (
        questions.withColumn("censored", censor_flag("duration_days"))
        .where(F.col("censored").isNotNull())
        .select("subject_id", "prediction_time", "query", "duration_days", "censored")
    )
    return label_questions(asked, events, min_duration).select(
        *LABEL_COLUMNS[:-1], null_when_censored(F.col("occurs")).alias("occurs")
    )


def training_table(
    events: DataFrame, codes: CodeSet | None, durations: range, k: int = 20, seed: int = 1, min_context: int = 50
) -> DataFrame:
    """``k`` random questions per subject with labels: samples first, then labels only the sample."""
    questions = sample_log(events, codes, durations, k, seed, min_context)
    asked = events if codes is None else only_codes(events, codes)
    return to_training_rows(label_sampled(questions, asked, durations.start)).select(*TRAINING_COLUMNS)


def collate_labels(labels: DataFrame, k: int = 20, seed: int = 1) -> DataFrame:
    """Training table from an existing long label table: ``k`` seeded rows per subject over everything."""
    keys = ["subject_id", "prediction_time", "query", "duration_days"]
    return sample_per_subject(to_training_rows(labels), keys, k, seed).select(*TRAINING_COLUMNS)
