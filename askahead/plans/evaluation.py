"""Evaluation: per-code tables, external cohorts, and reports over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askahead.functions import code_slug
from askahead.operators.codesets import CodeSet, bucket_codes
from askahead.operators.composite import composite_auroc, composite_with_labels
from askahead.operators.context import candidate_times
from askahead.operators.evalsets import external_label_join, index_label_join, prediction_label_join
from askahead.operators.metrics import auroc, auroc_two_head, nan_when_undefined
from askahead.operators.sampling import sample_index_times, sample_per_subject
from askahead.plans.labels import label_times


def eval_task_tables(labels: DataFrame, codes: CodeSet, k: int = 1, seed: int = 43) -> DataFrame:
    """Labels of all evaluation codes at ``k`` sampled index times per subject.

    ``labels`` is a long label table of one duration. Index times come from its distinct times.
    """
    times = labels.select("subject_id", "prediction_time", "censored").distinct()
    return index_label_join(sample_index_times(times, k, seed), labels, codes)


def eval_tasks_from_log(
    events: DataFrame,
    codes: CodeSet | None,
    duration_days: int,
    min_context: int = 50,
    k: int = 1,
    seed: int = 43,
    subjects: Column | None = None,
) -> DataFrame:
    """The same tables straight from the event log: samples the index times first, then labels only those.

    ``subjects`` is a condition on ``subject_id``, such as the held-out split.
    """
    if subjects is not None:
        events = events.where(subjects)
    index = sample_per_subject(candidate_times(events, min_context), ["subject_id", "prediction_time"], k, seed)
    labels = label_times(index, events, codes, duration_days).where(F.col("occurs").isNotNull())
    return labels.select(
        "subject_id",
        "prediction_time",
        F.col("censored").alias("boolean_value"),
        "query",
        "occurs",
        code_slug("query").alias("code_slug"),
    )


def external_task_tables(external: DataFrame, labels: DataFrame, codes: CodeSet) -> DataFrame:
    return external_label_join(external, labels, codes)


def external_tasks_from_log(
    external: DataFrame, events: DataFrame, codes: CodeSet, duration_days: int, min_context: int = 50
) -> DataFrame:
    """The same straight from the event log: only the cohort's own times are labelled.

    A time at which its subject has not seen enough context is unknown, as it is to a label table: an error.
    """
    key = ["subject_id", "prediction_time"]
    known = candidate_times(events, min_context).join(external.select(*key).distinct(), key, "left_semi")
    return external_label_join(external, label_times(known, events, codes, duration_days), codes)


def auroc_per_code(predictions: DataFrame, eval_task: DataFrame) -> DataFrame:
    """AUROC of each code's predictions against that code's labels, NaN where a class is missing.

    Codes without an evaluation table are left out; predictions without a label are counted in
    ``n_dropped``.
    """
    evaluated = eval_task.select(F.col("query").alias("code")).distinct()
    joined = prediction_label_join(predictions.join(evaluated, "code", "left_semi"), eval_task)
    return auroc(joined, "occurs_probs", "occurs", ["code"]).withColumn("auroc", nan_when_undefined())


def bucket_metrics(scored: DataFrame, ood_codes: DataFrame) -> DataFrame:
    """Both head AUROCs per code with its slug and in-/out-of-distribution bucket."""
    per_code = auroc_two_head(scored.withColumnRenamed("query", "code"), ["code"])
    return bucket_codes(per_code, ood_codes).withColumn("code_slug", code_slug("code"))


def composite_report(
    predictions: DataFrame, external: DataFrame, eval_task: DataFrame, ood_codes: DataFrame, kinds: list[str]
) -> DataFrame:
    """Long report: composite AUROCs against the external label and per-code AUROCs with buckets."""
    composite = composite_auroc(composite_with_labels(predictions, external, kinds)).select(
        F.lit("composite").alias("part"), F.col("measure").alias("name"), F.lit(None).cast("string").alias("bucket"), "auroc"
    )
    per_code = bucket_codes(auroc_per_code(predictions, eval_task), ood_codes).select(
        F.lit("code").alias("part"), F.col("code").alias("name"), "bucket", "auroc"
    )
    return composite.unionByName(per_code)
