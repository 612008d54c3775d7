"""Composite risk: several code probabilities of one prediction time combined into one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askahead.functions import exact_sum
from askahead.operators.metrics import auroc, nan_when_undefined

def _any_of(p: Column) -> Column:
    """At least one of several independent events: one minus the product of the counter-probabilities.

    The product is the exponential of a sum, zero where a probability is 1, and negative where an odd number is above 1.
    """
    logs = F.coalesce(exact_sum(F.when(p < 1, -F.log1p(-p)).when(p > 1, -F.log(p - 1)).when(F.isnan(p), p)), F.lit(0.0))
    sign = F.when(F.count_if(p > 1) % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    certain = F.coalesce(F.bool_or(p == 1), F.lit(False))
    return F.when(certain & ~F.isnan(logs), F.lit(1.0)).otherwise(F.lit(1.0) - sign * F.exp(-logs))


def _ascending(p: Column) -> Column:
    """The sum in ascending order: what a plain fold over sorted values gives, to the last bit.

    Ranks of sums depend on these bits where sums are equal but for rounding, so this one gathers its values.
    """
    return F.aggregate(F.array_sort(F.collect_list(p)), F.lit(0.0), lambda acc, x: acc + x)


# Aggregates that do not depend on how rows arrive; the first two combine before the shuffle.
_FOLDS: dict[str, Callable[[Column], Column]] = {
    "max": F.max,
    # No probabilities at all mean no risk.
    "or": _any_of,
    "sum": _ascending,
}


def folds(kinds: list[str]) -> dict[str, Callable[[Column], Column]]:
    """The folds asked for, by any spelling of their names."""
    names = {k.lower(): k for k in kinds}
    if strange := names.keys() - _FOLDS.keys():
        raise ValueError(f"unknown composite {sorted(strange)}; choose from {sorted(_FOLDS)}")
    return {k: fold for k, fold in _FOLDS.items() if k in names}


def composite_probs(predictions: DataFrame, kinds: list[str], prob: str = "occurs_probs") -> DataFrame:
    """``prob_max`` / ``prob_or`` / ``prob_sum`` per subject and prediction time."""
    p = F.col(prob).cast("double")
    wanted = [fold(p).alias(f"prob_{k}") for k, fold in folds(kinds).items()]
    return predictions.groupBy("subject_id", "prediction_time").agg(*wanted)


def composite_with_labels(
    predictions: DataFrame, labels: DataFrame, kinds: list[str], label: str = "boolean_value"
) -> DataFrame:
    wanted = labels.select("subject_id", "prediction_time", label)
    return composite_probs(predictions, kinds).join(wanted, ["subject_id", "prediction_time"])


def composite_auroc(joined: DataFrame, label: str = "boolean_value") -> DataFrame:
    """AUROC of every ``prob_`` column against the label; NaN where a class is missing."""
    probs = [c for c in joined.columns if c.startswith("prob_")]
    long = joined.unpivot([label], probs, "measure", "score")
    return auroc(long, "score", label, ["measure"]).withColumn("auroc", nan_when_undefined())
