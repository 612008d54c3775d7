"""The fitted baseline learns from every row."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from askahead.catalog import QUERIES
from askahead.plans.scoring import baseline_two_head

KINDS = ["click", "error", "purchase", "signup", "view"]


def test_both_heads_learn_the_shares_of_all_rows(spark):
    # All rows look alike, so a head can learn nothing but the share of its positive rows.
    n, censored, occurring = 120_001, 30_007, 11_003
    rows = spark.range(n).select(
        F.col("id").alias("subject_id"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("prediction_time"),
        F.lit("A").alias("query"),
        F.lit(1).alias("query_id"),
        F.lit(30.0).cast("float").alias("duration_days"),
        F.lit(30 / 365).cast("float").alias("duration_years"),
        (F.col("id") < censored).alias("censor"),
        (F.col("id") >= n - occurring).cast("int").alias("occurs"),
        F.array(F.lit(1), F.lit(2), F.lit(3)).alias("codes"),
    )
    found = baseline_two_head(rows, n_features=16, max_iter=5).transform(rows.limit(1)).first()
    assert found.censor_probs == pytest.approx(censored / n, abs=1e-9)
    assert found.occurs_probs == pytest.approx(occurring / (n - censored), abs=1e-9)


def test_the_query_learns_from_every_label_row(spark, tmp_path, monkeypatch):
    # 50 users with 110 events each: 91 times of each have 20 events of context, and 5 codes are asked about.
    start = dt.datetime(2024, 1, 1)
    events = [
        (u * 110 + i, start + dt.timedelta(hours=2 * i, seconds=u), u, KINDS[(i * i + i * u) % 5], float(i), "{}")
        for u in range(50)
        for i in range(110)
    ]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(events, schema).write.parquet(f"{tmp_path}/events.parquet")
    learned = {}

    def fit(self, rows, params=None, fit=LogisticRegression.fit):
        learned[self.getLabelCol()] = rows.count()
        return fit(self, rows, params)

    monkeypatch.setattr(LogisticRegression, "fit", fit)
    out = QUERIES["baseline_two_head"](spark, str(tmp_path)).collect()
    scored, censored = sum(r.n_scored for r in out), sum(r.n_censored for r in out)
    assert (scored, len(out)) == (50 * 91 * 5, 5)
    assert 0 < censored < scored
    assert learned == {"censor_y": scored, "occurs_y": scored - censored}
