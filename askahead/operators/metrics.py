"""Exact AUROC and loss aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askahead.functions import bce_with_logits

# Score cells for probabilities; powers of two, so that cutting a score into cells is exact.
PROBABILITY_CELLS = (2.0**-16, 2.0**-32)

_EXACT = "decimal(19,0)"


def auroc(
    rows: DataFrame,
    score: str,
    target: str,
    by: list[str] | None = None,
    cells: tuple[float, ...] = PROBABILITY_CELLS,
) -> DataFrame:
    """Area under the ROC curve per group, ties counted one half; null where a class is missing.

    Counts ordered (negative, positive) pairs. Rows are first reduced to counts per distinct score, and a
    pair is then counted where its two scores first part: as different scores of one fine cell, in
    different fine cells, or in different coarse cells. Each level is a window inside the enclosing cell
    over the totals of the level below, so no group, and not even the whole table, is ever ranked in one
    task. Rows without a target or a score are left out; ``n_dropped`` reports how many. Any cells give
    the same result; they only balance the work.
    """
    by = by or []
    number = F.col(score).cast("double")
    usable = F.col(target).isNotNull() & number.isNotNull() & ~F.isnan(number)
    hit = F.col(target).cast("int")
    cell_names = [f"_cell{i}" for i in range(len(cells))]
    level = (
        rows.groupBy(*by, F.when(usable, number).alias("_score"))
        .agg(
            F.sum(F.when(usable, hit)).alias("pos"),
            F.sum(F.when(usable, 1 - hit)).alias("neg"),
            F.count_if(~usable).alias("dropped"),
        )
        .withColumns({n: F.floor(F.col("_score") / F.lit(w)) for n, w in zip(cell_names, cells, strict=True)})
        # Inside one score every pair is a tie: one half each.
        .withColumn("_credit", F.col("pos").cast(_EXACT) * F.col("neg").cast(_EXACT))
    )
    order = [*cell_names, "_score"]
    for depth in range(len(order) - 1, -1, -1):
        enclosing = [*by, *order[:depth]]
        below = (
            Window.partitionBy(*(enclosing or [F.lit(0)]))
            .orderBy(order[depth])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        lower = F.coalesce(F.sum("neg").over(below), F.lit(0))
        level = (
            level.withColumn("_credit", F.col("_credit") + F.col("pos").cast(_EXACT) * (2 * lower).cast(_EXACT))
            .groupBy(*enclosing)
            .agg(*[F.sum(c).alias(c) for c in ("_credit", "pos", "neg", "dropped")])
        )
    zero = F.lit(0).cast("bigint")
    pairs = F.lit(2.0) * F.col("pos").cast("double") * F.col("neg").cast("double")
    return level.select(
        *by,
        F.try_divide(F.col("_credit").cast("double"), pairs).alias("auroc"),
        F.coalesce("pos", zero).alias("n_pos"),
        F.coalesce("neg", zero).alias("n_neg"),
        F.coalesce("dropped", zero).alias("n_dropped"),
    )


def nan_when_undefined(value: Column | str = "auroc") -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(float("nan")))


def two_head_rows(scored: DataFrame, by: list[str]) -> DataFrame:
    """One row per head: censor over all rows, occurs over the uncensored ones."""
    heads = F.array(
        F.struct(
            F.lit("censor").alias("head"),
            F.col("censor_probs").alias("score"),
            F.col("boolean_value").alias("target"),
        ),
        F.struct(
            F.lit("occurs").alias("head"), F.col("occurs_probs").alias("score"), F.col("occurs").alias("target")
        ),
    )
    return scored.select(*by, "boolean_value", F.inline(heads)).where((F.col("head") == "censor") | ~F.col("boolean_value"))


def auroc_two_head(scored: DataFrame, by: list[str]) -> DataFrame:
    """``occurs_auc`` and ``censor_auc`` per group, null where a class is missing."""
    per_head = auroc(two_head_rows(scored, by), "score", "target", [*by, "head"])
    return per_head.groupBy(*by).agg(
        F.max(F.when(F.col("head") == "occurs", F.col("auroc"))).alias("occurs_auc"),
        F.max(F.when(F.col("head") == "censor", F.col("auroc"))).alias("censor_auc"),
    )


def auroc_batch_gated(rows: DataFrame, score: str, target: str, batch: list[str]) -> DataFrame:
    """AUROC over the batches whose targets have both classes; the other batches do not count."""
    in_batch = Window.partitionBy(*batch)
    hit = F.col(target).cast("int")
    mixed = (
        rows.withColumn("_low", F.min(hit).over(in_batch))
        .withColumn("_high", F.max(hit).over(in_batch))
        .where(F.col("_low") < F.col("_high"))
    )
    return auroc(mixed, score, target)


def log_loss(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean loss of both heads and their sum; the occurs head only counts uncensored rows."""
    censor = bce_with_logits("censor_logit", F.col("boolean_value").cast("int"))
    occurs = bce_with_logits("occurs_logit", F.col("occurs").cast("int"))
    return (
        rows.groupBy(*(by or []))
        .agg(
            F.avg(censor).alias("censor_loss"),
            F.avg(F.when(~F.col("boolean_value"), occurs)).alias("occurs_loss"),
            F.count("*").alias("n_rows"),
        )
        .withColumn("loss", F.col("censor_loss") + F.col("occurs_loss"))
    )


def epoch_mean_loss(batch_losses: DataFrame, split: str = "split") -> DataFrame:
    """Loss per split, batches weighted by their size; a batch without a loss has no weight."""
    weight = F.when(F.col("loss").isNotNull(), F.col("n_rows"))
    return batch_losses.groupBy(split).agg(
        F.try_divide(F.sum(F.col("loss") * weight), F.sum(weight)).alias("mean_loss"), F.sum(weight).alias("n_rows")
    )


def wide_metrics(metrics: DataFrame, name: str, value: str, names: list[str]) -> DataFrame:
    """One row with a column per named metric, for reports over a bounded list of names."""
    return metrics.groupBy().pivot(name, names).agg(F.first(value))
