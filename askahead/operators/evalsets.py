"""Evaluation tables: index times or external cohorts joined to labels, all codes in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askahead.functions import code_slug
from askahead.operators.codesets import CodeSet, only_codes

_TIME_KEY = ["subject_id", "prediction_time"]


def index_label_join(index_times: DataFrame, labels: DataFrame, codes: CodeSet) -> DataFrame:
    """Labels of the wanted codes at the index times; rows without a label are dropped."""
    wanted = only_codes(labels.where(F.col("occurs").isNotNull()), codes, "query")
    index = index_times.select(*_TIME_KEY, F.col("censored").alias("boolean_value"))
    return index.join(wanted.select(*_TIME_KEY, "query", "occurs"), _TIME_KEY).select(
        *_TIME_KEY, "boolean_value", "query", "occurs", code_slug("query").alias("code_slug")
    )


def unmatched_external(external: DataFrame, labels: DataFrame) -> DataFrame:
    """External rows whose prediction time the label table does not know."""
    known = labels.where(F.col("censored").isNotNull()).select(*_TIME_KEY).distinct()
    return external.join(known, _TIME_KEY, "left_anti")


def external_labels_unchecked(external: DataFrame, labels: DataFrame, codes: CodeSet) -> DataFrame:
    """External cohort × codes with our labels; an unmatched row has no ``boolean_value``.

    To be written with ``boolean_value`` checked on the way, see ``sinks.write_checked``.
    """
    outcome = external.select(*_TIME_KEY, F.col("boolean_value").alias("task_label"))
    wanted = only_codes(labels, codes, "query").select(*_TIME_KEY, "query", F.col("censored").alias("boolean_value"), "occurs")
    return outcome.join(wanted, _TIME_KEY, "left").select(
        *_TIME_KEY, "query", "boolean_value", "occurs", "task_label", code_slug("query").alias("code_slug")
    )


def external_label_join(external: DataFrame, labels: DataFrame, codes: CodeSet) -> DataFrame:
    """External cohort × codes with our labels. Censored rows stay; an unmatched row is an error."""
    joined = external_labels_unchecked(external, labels, codes)
    checked = F.when(
        F.col("boolean_value").isNull(),
        F.raise_error(F.lit("an external row has no label row at its prediction time")).cast("boolean"),
    ).otherwise(F.col("boolean_value"))
    return joined.withColumn("boolean_value", checked)


def prediction_label_join(predictions: DataFrame, eval_task: DataFrame) -> DataFrame:
    """Each prediction with the label of its code, or null; all codes at once."""
    labels = eval_task.select(*_TIME_KEY, F.col("query").alias("code"), "occurs")
    return predictions.join(labels, [*_TIME_KEY, "code"], "left")


def slug_filter(predictions: DataFrame, slugs: DataFrame) -> DataFrame:
    """Predictions whose code has a dataset with the same slug."""
    return predictions.withColumn("code_slug", code_slug("code")).join(
        slugs.select("code_slug").distinct(), "code_slug", "left_semi"
    )


def shard_alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys only on the left, only on the right. Both must be 0 before inputs are paired."""
    sides = (
        left.select(key).distinct().withColumn("_side", F.lit(1))
        .unionByName(right.select(key).distinct().withColumn("_side", F.lit(2)))
        .groupBy(key)
        .agg(F.sum("_side").alias("_sides"))
    )
    return sides.agg(
        F.count_if(F.col("_sides") == 1).alias("only_left"), F.count_if(F.col("_sides") == 2).alias("only_right")
    )
