"""Queries that write, read back, score or stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from askahead.catalog.base import (
    CLICK_LABELS,
    DAYS_ORDERS,
    E,
    INDEX,
    INDEX_SEED,
    MIN_ORDERS,
    ORDER_LABELS,
    ORDERS,
    PARTS,
    PREDICTIONS,
    SCORED,
    TIME_KEY,
    V,
    VE,
    clicks,
    log_sql,
    order_candidates,
    order_labels,
    orders_log,
    part_codes,
    predictions,
    query,
    sample,
    table,
)
from askahead.catalog.codes import KEPT, N, SEED, TRAIN
from askahead.catalog.evaluation import EVAL_TASK, _PER_CODE, eval_task, per_code
from askahead.catalog.labelling import _DURATIONS, _SAMPLE_KEY, _THREE, _TRAIN
from askahead.catalog.sequences import _CLICK_IDX, _TOKENS, MAX_LEN, click_inputs
from askahead.functions import list_fingerprint, micros
from askahead.operators.codesets import exclude_time_codes, sample_codes
from askahead.operators.metrics import auroc_two_head
from askahead.operators.sampling import sample_index_times
from askahead.plans.labels import collate_labels, label_table
from askahead.plans.scoring import LEARNED, baseline_two_head, predict_table
from askahead.schemas import EVENTS, SPLITS
from askahead.session import checkpointed, fresh_path
from askahead.sources import sinks
from askahead.sources.tables import code_vocab, event_view, in_split, read_labels, read_predictions, read_vocab, with_split
from askahead.streaming.incremental import current_rows, process_new_shards

KEY = "subject_id, prediction_time"
_SPLIT = "CASE WHEN subject_id % 10 < 8 THEN 'train' WHEN subject_id % 10 = 8 THEN 'tuning' ELSE 'held_out' END AS split"


@query("write_label_table", log_sql(_DURATIONS, select=f"SELECT *, {_SPLIT} FROM labels"))
def _write_labels(spark, sf):
    path = fresh_path(spark, "labels")

    def build(durations):
        return with_split(order_labels(spark, sf, durations))

    sinks.write_label_table(spark, build, path, _THREE[:1], list(SPLITS))
    # The second call finds the first duration complete and computes the others only.
    sinks.write_label_table(spark, build, path, _THREE, list(SPLITS))
    return spark.read.parquet(path)


@query(
    "write_collated",
    log_sql(_DURATIONS, select=f"SELECT *, {_SPLIT} FROM (SELECT * FROM {sample('labels', _SAMPLE_KEY, 20, 1, _TRAIN)}) WHERE subject_id % 10 < 9"),
)
def _write_collated(spark, sf):
    rows = with_split(collate_labels(order_labels(spark, sf, _THREE), 20, 1)).where(F.col("split") != "held_out")
    codes = orders_log(spark, sf).select("code").distinct()
    fingerprint = sinks.codes_fingerprint(codes, _THREE).first()["fingerprint"]
    return spark.read.parquet(sinks.write_collated(rows, fresh_path(spark, "training"), fingerprint))


@query("write_per_code", log_sql(ORDER_LABELS, INDEX, EVAL_TASK, select="SELECT * FROM task"))
def _write_per_code(spark, sf):
    return spark.read.parquet(sinks.write_per_code(eval_task(spark, sf), fresh_path(spark, "eval")))


@query("write_index_times", log_sql(ORDERS, INDEX, select=f"SELECT *, 1 AS sample_times_per_subject, {INDEX_SEED} AS seed FROM idx WHERE subject_id % 10 = 9"))
def _write_index(spark, sf):
    index = sample_index_times(order_candidates(spark, sf), 1, INDEX_SEED, in_split("held_out"))
    path = sinks.write_index_times(index, fresh_path(spark, "eval"), "orders", 1, INDEX_SEED)
    meta = spark.read.schema("sample_times_per_subject int, seed int").json(f"{path}/meta").first()
    return spark.read.parquet(f"{path}/held_out").withColumns({name: F.lit(meta[name]) for name in meta.asDict()})


@query("write_csv_metrics", _PER_CODE)
def _write_csv(spark, sf):
    rows = per_code(spark, sf).select("code", F.round("auroc", 9).alias("auroc"), "n_pos", "n_neg")
    path = sinks.write_csv(rows, fresh_path(spark, "metrics.csv"))
    return spark.read.schema("code string, auroc double, n_pos bigint, n_neg bigint").csv(path, header=True)


@query(
    "write_embeddings",
    "SELECT vec_id, label, len(embedding)::INTEGER AS n, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last, "
    "list_max(embedding)::DOUBLE AS largest FROM embeddings",
)
def _write_embeddings(spark, sf):
    stored = spark.read.parquet(sinks.write_embeddings(table(spark, sf, "embeddings"), fresh_path(spark, "embeddings")))
    return stored.select(
        "vec_id",
        "label",
        F.size("embedding").alias("n"),
        F.element_at("embedding", 1).cast("double").alias("first"),
        F.element_at("embedding", -1).cast("double").alias("last"),
        F.array_max("embedding").cast("double").alias("largest"),
    )


@query("write_code_sample", log_sql(PARTS, KEPT, TRAIN, select="SELECT code, pos FROM train"))
def _write_sample(spark, sf):
    drawn = sample_codes(exclude_time_codes(part_codes(spark, sf)), N, SEED)
    # The fingerprint names the folder: one short string for the driver.
    fingerprint = drawn.agg(list_fingerprint("code", "pos").alias("f")).first()["f"]
    path = sinks.write_code_sample(drawn, fresh_path(spark, "codes"), fingerprint, N)
    return spark.read.schema("code string, pos int").json(path)


@query("read_vocab", log_sql(E, "codes AS (SELECT DISTINCT code FROM e)", select="SELECT code, row_number() OVER (ORDER BY code)::INTEGER AS vocab_index FROM codes"))
def _read_vocab(spark, sf):
    path = fresh_path(spark, "codes")
    code_vocab(orders_log(spark, sf)).withColumnRenamed("vocab_index", "code/vocab_index").write.parquet(path)
    return read_vocab(spark, path)


@query(
    "read_predictions",
    log_sql(ORDER_LABELS, SCORED, PREDICTIONS, select="SELECT * FROM preds"),
)
def _read_predictions(spark, sf):
    path = sinks.write_predictions(predictions(spark, sf), fresh_path(spark, "preds.csv"))
    return read_predictions(spark, path)


@query(
    "read_labels_optional",
    log_sql(ORDER_LABELS, select=f"SELECT {KEY}, occurs, query FROM labels"),
)
def _read_labels(spark, sf):
    path = fresh_path(spark, "labels")
    rows = with_split(order_labels(spark, sf)).drop("duration_days")
    rows.write.partitionBy("split").parquet(path)
    return read_labels(spark, [f"{path}/split={name}" for name in SPLITS])


# --- Scoring ------------------------------------------------------------------------------------------


def simple_scorer():
    """A stand-in for a trained model: scores from length, last value, time covered, query and duration."""

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        # All arrays of a column end to end; none is empty, as the query stands in front.
        values, deltas, mask = (np.concatenate(batch[c].to_list()) for c in ("numeric_values", "time_deltas", "attention_mask"))
        length = batch["codes"].map(len).to_numpy()
        ends, mask_ends = length.cumsum(), (length + 1).cumsum()
        covered = np.add.reduceat(np.nan_to_num(deltas.astype(float)), ends - length)
        attended = np.add.reduceat(mask.astype(float), mask_ends - length - 1)
        last, length = values[ends - 1].astype(float), length.astype(float)
        query_id = batch["query_id"].to_numpy(dtype=float)
        occurs = (length - 20) / 8 + batch["duration_years"].to_numpy(dtype=float) - query_id / 4 + last / 100
        return pd.DataFrame(
            {
                "occurs_probs": 1 / (1 + np.exp(-occurs)),
                "censor_probs": 1 / (1 + np.exp(-(covered - 16) / 4)),
                "embedding": list(np.stack([length, query_id, attended], axis=1).astype("float32")),
            }
        )

    return score


@query(
    "predict_table",
    log_sql(
        CLICK_LABELS, _CLICK_IDX, _TOKENS,
        f"""tail AS (SELECT subject_id, prediction_time, sum(delta::DOUBLE) AS covered, max(CASE WHEN back = 1 THEN value::DOUBLE END) AS last
            FROM hist WHERE back <= {MAX_LEN} GROUP BY ALL)""",
        select=f"""SELECT {KEY}, query AS code,
        round(1 / (1 + exp(-((n - 19) / 8.0 + (3 / 365.0)::FLOAT - vocab.id / 4.0 + last / 100))), 6) AS occurs_probs,
        round(1 / (1 + exp(-(covered - 16) / 4.0)), 6) AS censor_probs, (n + 1)::DOUBLE AS length, vocab.id::DOUBLE AS query_id,
        (n + 2)::DOUBLE AS attended
        FROM labels JOIN seq USING (subject_id, prediction_time) JOIN tail USING (subject_id, prediction_time)
        JOIN vocab ON vocab.code = query""",
    ),
)
def _predict(spark, sf):
    out = predict_table(click_inputs(spark, sf), simple_scorer)
    return out.select(
        "subject_id",
        "prediction_time",
        "code",
        F.round("occurs_probs", 6).alias("occurs_probs"),
        F.round("censor_probs", 6).alias("censor_probs"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("length", "query_id", "attended"))],
    )


@query(
    "baseline_two_head",
    log_sql(
        CLICK_LABELS,
        select="SELECT query AS code, count(*) AS n_scored, count(*) FILTER (WHERE censored) AS n_censored, "
        "count(*) FILTER (WHERE occurs) AS n_occurs, true AS in_range, true AS beats_chance FROM labels GROUP BY query",
    ),
)
def _baseline(spark, sf):
    """What the oracle can know: every row is scored once, with probabilities, and the censor head has learned."""
    inputs = checkpointed(click_inputs(spark, sf).select(*LEARNED))
    scored = checkpointed(baseline_two_head(inputs, n_features=256).transform(inputs))
    counts = scored.groupBy("code").agg(
        F.count("*").alias("n_scored"),
        F.count_if("boolean_value").alias("n_censored"),
        F.count_if("occurs").alias("n_occurs"),
        F.bool_and(F.col("occurs_probs").between(0, 1) & F.col("censor_probs").between(0, 1)).alias("in_range"),
    )
    learned = auroc_two_head(scored, ["code"]).select("code", (F.col("censor_auc") > 0.5).alias("beats_chance"))
    return counts.join(learned, "code")


# --- Incremental --------------------------------------------------------------------------------------


@query("incremental_shards", log_sql(ORDER_LABELS, select="SELECT * FROM labels"))
def _incremental(spark, sf):
    source, target = fresh_path(spark, "events"), fresh_path(spark, "labels")
    checkpoint = fresh_path(spark, "stream")
    log = event_view(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderpriority")
    codes = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("code")).distinct()
    # Deliveries follow the calendar, so that most subjects come back in later ones.
    year = F.year("time")

    def build(events, earlier):
        return label_table(events, codes, [DAYS_ORDERS], MIN_ORDERS, earlier)

    for first, last in ((0, 1994), (1995, 1996), (1997, 9999)):
        log.where(year.between(first, last)).write.mode("append").parquet(source)
        process_new_shards(spark, source, EVENTS, target, checkpoint, build, DAYS_ORDERS)
    return current_rows(spark, target)
