from __future__ import annotations

import math
import random

import pytest
from calendar_days import day
from pyspark.sql import functions as F

from askahead.operators import composite, metrics


def pairs_auroc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("cells", [metrics.PROBABILITY_CELLS, (0.25,), (1024.0, 1.0), ()])
def test_auroc_equals_pair_count(spark, cells):
    rng = random.Random(3)
    rows = [(g, rng.choice([0.0, 1.0, -2.5, rng.random(), rng.random() * 1e-7]), rng.random() < 0.4) for g in "ab" for _ in range(150)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    got = {r.g: r.auroc for r in metrics.auroc(df, "s", "y", ["g"], cells).collect()}
    for g in "ab":
        assert got[g] == pytest.approx(pairs_auroc([(s, y) for g2, s, y in rows if g2 == g]), abs=1e-12)
    whole = metrics.auroc(df, "s", "y", cells=cells).first().auroc
    assert whole == pytest.approx(pairs_auroc([(s, y) for _, s, y in rows]), abs=1e-12)


def test_auroc_edges(spark):
    same = spark.createDataFrame([(0.3, True), (0.3, False), (0.3, False)], "s double, y boolean")
    assert metrics.auroc(same, "s", "y").first().auroc == 0.5
    one = spark.createDataFrame([(0.3, True), (0.4, True)], "s double, y boolean")
    assert metrics.auroc(one, "s", "y").first().auroc is None
    assert math.isnan(metrics.auroc(one, "s", "y").select(metrics.nan_when_undefined()).first()[0])
    gaps = spark.createDataFrame(
        [(0.9, True), (0.1, False), (None, True), (0.5, None), (float("nan"), False)], "s double, y boolean"
    )
    got = metrics.auroc(gaps, "s", "y").first()
    assert (got.auroc, got.n_pos, got.n_neg, got.n_dropped) == (1.0, 1, 1, 3)


def test_auroc_counts_do_not_overflow(spark):
    # Pair counts of two groups of four billion rows exceed a 64-bit integer.
    n = 4_000_000_000
    level = spark.createDataFrame([(n,)], "n bigint").select(
        (F.col("n").cast("decimal(19,0)") * (2 * F.col("n")).cast("decimal(19,0)")).alias("c")
    )
    assert int(level.first().c) == 2 * n * n


def scored(spark, rows):
    schema = "code string, boolean_value boolean, occurs boolean, occurs_probs double, censor_probs double, occurs_logit double, censor_logit double"
    return spark.createDataFrame(rows, schema)


def test_censored_rows_do_not_count_for_the_occurs_head(spark):
    base = [("a", False, True, 0.9, 0.2, 1.0, -1.0), ("a", False, False, 0.1, 0.3, -1.0, -1.0), ("a", True, False, 0.95, 0.8, 3.0, 2.0)]
    moved = [*base[:2], ("a", True, True, 0.01, 0.8, -9.0, 2.0)]
    a, b = (metrics.auroc_two_head(scored(spark, r), ["code"]).first() for r in (base, moved))
    assert a == b
    assert (a.occurs_auc, a.censor_auc) == (1.0, 1.0)
    x, y = (metrics.log_loss(scored(spark, r)).first() for r in (base, moved))
    assert x == y
    changed = [("a", False, False, 0.9, 0.2, 1.0, -1.0), *base[1:]]
    assert metrics.log_loss(scored(spark, changed)).first().occurs_loss != x.occurs_loss


def test_log_loss_known_values(spark):
    rows = [("a", True, False, 0.5, 0.5, 0.0, 0.0), ("a", False, True, 0.5, 0.5, 0.0, 0.0)]
    got = metrics.log_loss(scored(spark, rows)).first()
    assert round(got.censor_loss, 4) == round(got.occurs_loss, 4) == 0.6931
    assert got.loss == got.censor_loss + got.occurs_loss
    extreme = [("a", True, False, 0.5, 0.5, 0.0, 1000.0), ("a", False, True, 0.5, 0.5, -1000.0, -1000.0)]
    huge = metrics.log_loss(scored(spark, extreme)).first()
    assert (huge.censor_loss, huge.occurs_loss) == (0.0, 1000.0)


def test_single_class_batches_are_gated(spark):
    rows = [(1, 0.9, True), (1, 0.1, False), (2, 0.0, True), (2, 0.05, True)]
    df = spark.createDataFrame(rows, "b int, s double, y boolean")
    assert metrics.auroc_batch_gated(df, "s", "y", ["b"]).first().auroc == 1.0
    assert metrics.auroc(df, "s", "y").first().auroc < 1.0


def test_epoch_loss_weights_batches(spark):
    df = spark.createDataFrame([("t", 1.0, 3), ("t", 5.0, 1), ("t", None, 7)], "split string, loss double, n_rows bigint")
    assert metrics.epoch_mean_loss(df).first().mean_loss == 2.0


def preds(spark, probs):
    rows = [(1, day(0), p, f"c{i}") for i, p in enumerate(probs)]
    return spark.createDataFrame(rows, "subject_id bigint, prediction_time timestamp_ntz, occurs_probs double, code string")


def test_composites(spark):
    got = composite.composite_probs(preds(spark, [0.5, 0.25]), ["MAX", "or", "Sum"]).first()
    assert (got.prob_max, got.prob_or, got.prob_sum) == (0.5, 0.625, 0.75)
    certain = composite.composite_probs(preds(spark, [1.0, 0.25]), ["or", "sum"]).first()
    assert (certain.prob_or, certain.prob_sum) == (1.0, 1.25)
    empty = composite.composite_probs(preds(spark, [None, None]), ["max", "or", "sum"]).first()
    assert (empty.prob_max, empty.prob_or, empty.prob_sum) == (None, 0.0, 0.0)
    with pytest.raises(ValueError, match="mean"):
        composite.folds(["max", "mean"])


def test_tiny_risks_keep_their_order(spark):
    rows = [(1, day(0), True, 3e-13), (2, day(0), False, 1e-13), (3, day(0), False, 2e-13)]
    joined = spark.createDataFrame(rows, "subject_id bigint, prediction_time timestamp_ntz, boolean_value boolean, prob_max double")
    assert composite.composite_auroc(joined).first().auroc == 1.0


def test_equal_risks_tie_in_whatever_order_their_parts_arrive(spark):
    values = [0.1, 0.7, 0.3, 1e-9, 0.2]
    one, other = (composite.composite_probs(preds(spark, v), ["or", "sum"]).first() for v in (values, values[::-1]))
    assert (one.prob_or, one.prob_sum) == (other.prob_or, other.prob_sum)


def test_composite_auroc_is_nan_with_one_class(spark):
    rows = [(1, day(0), True, 0.2), (2, day(0), True, 0.3)]
    joined = spark.createDataFrame(rows, "subject_id bigint, prediction_time timestamp_ntz, boolean_value boolean, prob_max double")
    assert math.isnan(composite.composite_auroc(joined).first().auroc)
