"""Queries: evaluation tables, metrics and composites."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askahead.catalog.base import (
    CLICK_LABELS,
    DAYS_ORDERS,
    EXTERNAL,
    ID_CODES,
    INDEX,
    INDEX_SEED,
    MANUAL_CODES,
    MIN_ORDERS,
    OOD_CODES,
    ORDER_LABELS,
    PREDICTIONS,
    SCORED,
    TIME_KEY,
    click_labels,
    external_cohort,
    log_sql,
    order_index,
    order_labels,
    orders_log,
    predictions,
    query,
    rank_auroc,
    sample,
    scored_labels,
    slug_sql,
    table,
)
from askahead.functions import sigmoid
from askahead.operators import composite, evalsets, metrics
from askahead.operators.codesets import code_list, numbered
from askahead.plans import evaluation
from askahead.session import fresh_path
from askahead.sources import sinks
from askahead.sources.tables import with_split

KEY = "subject_id, prediction_time"
EVAL_CODES = ["1-URGENT", "3-MEDIUM", "4-NOT SPECIFIED"]
_IN_EVAL = "query IN ('1-URGENT', '3-MEDIUM', '4-NOT SPECIFIED')"
_SLUG = slug_sql("query")
EVAL_TASK = f"""task AS (SELECT idx.subject_id, idx.prediction_time, idx.censored AS boolean_value, query, occurs,
    {_SLUG} AS code_slug FROM idx JOIN labels USING (subject_id, prediction_time)
    WHERE {_IN_EVAL} AND occurs IS NOT NULL)"""
EXT_TASK = f"""ext_task AS (SELECT subject_id, prediction_time, query, censored AS boolean_value, occurs,
    ext.boolean_value AS task_label, {_SLUG} AS code_slug FROM ext LEFT JOIN labels USING (subject_id, prediction_time)
    WHERE {_IN_EVAL})"""


def eval_task(spark, sf):
    return evaluation.eval_tasks_from_log(orders_log(spark, sf), EVAL_CODES, DAYS_ORDERS, MIN_ORDERS, 1, INDEX_SEED)


@query("index_label_join", log_sql(ORDER_LABELS, INDEX, EVAL_TASK, select="SELECT * FROM task"))
def _index_join(spark, sf):
    return evalsets.index_label_join(order_index(spark, sf), order_labels(spark, sf), EVAL_CODES)


@query("eval_tasks_from_log", log_sql(ORDER_LABELS, INDEX, EVAL_TASK, select="SELECT * FROM task"))
def _eval_from_log(spark, sf):
    return eval_task(spark, sf)


@query("eval_task_tables", log_sql(ORDER_LABELS, INDEX, EVAL_TASK, select="SELECT * FROM task"))
def _eval_task(spark, sf):
    return evaluation.eval_task_tables(order_labels(spark, sf), EVAL_CODES, 1, INDEX_SEED)


_CLICK_IDX = f"idx AS {sample('(SELECT DISTINCT subject_id, prediction_time, censored FROM labels)', TIME_KEY, 2, 11, '* EXCLUDE (nth)')}"


@query(
    "eval_task_tables_clicks",
    log_sql(CLICK_LABELS, _CLICK_IDX, select=f"""SELECT {KEY}, idx.censored AS boolean_value, query, occurs, {_SLUG} AS code_slug
        FROM idx JOIN labels USING (subject_id, prediction_time) WHERE query IN ('click', 'purchase') AND occurs IS NOT NULL"""),
)
def _eval_clicks(spark, sf):
    return evaluation.eval_task_tables(click_labels(spark, sf), ["click", "purchase"], 2, 11)


@query("external_label_join", log_sql(ORDER_LABELS, EXTERNAL, EXT_TASK, select="SELECT * FROM ext_task"))
def _external_join(spark, sf):
    return evalsets.external_label_join(external_cohort(spark, sf), order_labels(spark, sf), EVAL_CODES)


@query(
    "external_task_tables",
    log_sql(ORDER_LABELS, EXTERNAL, EXT_TASK, select="SELECT code_slug, query, task_label, boolean_value, occurs, "
            "count(*) AS n_rows FROM ext_task GROUP BY ALL"),
)
def _external_tables(spark, sf):
    rows = evaluation.external_tasks_from_log(
        external_cohort(spark, sf), orders_log(spark, sf), EVAL_CODES, DAYS_ORDERS, MIN_ORDERS
    )
    return rows.groupBy("code_slug", "query", "task_label", "boolean_value", "occurs").agg(F.count("*").alias("n_rows"))


@query(
    "assert_join_complete",
    log_sql(ORDER_LABELS, EXTERNAL, select="SELECT count(*) AS n_unmatched FROM ext LEFT JOIN labels USING (subject_id, prediction_time) "
            "WHERE censored IS NULL"),
)
def _complete(spark, sf):
    """Counted while the joined table is written, which a single unmatched row would undo."""

    def build(session):
        return evalsets.external_labels_unchecked(external_cohort(session, sf), order_labels(session, sf), EVAL_CODES)

    found = sinks.write_checked(spark, build, fresh_path(spark, "external"), {"n_unmatched": F.col("boolean_value").isNull()})
    return spark.createDataFrame([(found["n_unmatched"],)], "n_unmatched bigint")


_ORDER_SHARD = "subject_id % 64"


@query(
    "shard_alignment",
    log_sql(ORDER_LABELS, INDEX, select=f"""SELECT (SELECT count(DISTINCT {_ORDER_SHARD}) FROM idx WHERE {_ORDER_SHARD} NOT IN
        (SELECT {_ORDER_SHARD} FROM labels WHERE occurs)) AS only_left, (SELECT count(DISTINCT {_ORDER_SHARD}) FROM labels
        WHERE occurs AND {_ORDER_SHARD} NOT IN (SELECT {_ORDER_SHARD} FROM idx)) AS only_right"""),
)
def _shards(spark, sf):
    shard = F.pmod("subject_id", F.lit(64)).alias("shard")
    return evalsets.shard_alignment(
        order_index(spark, sf).select(shard), order_labels(spark, sf).where("occurs").select(shard), "shard"
    )


_SCORED = [ORDER_LABELS, SCORED]
_PREDS = [*_SCORED, PREDICTIONS]


@query(
    "prediction_label_join",
    log_sql(*_PREDS, INDEX, EVAL_TASK,
            select="SELECT p.subject_id, p.prediction_time, p.code, occurs_probs, task.occurs FROM preds p LEFT JOIN task "
            "ON p.subject_id = task.subject_id AND p.prediction_time = task.prediction_time AND p.code = task.query"),
)
def _prediction_join(spark, sf):
    return evalsets.prediction_label_join(predictions(spark, sf), eval_task(spark, sf))


@query(
    "slug_filter",
    log_sql(*_PREDS, INDEX, EVAL_TASK, f"p AS (SELECT *, {slug_sql('code')} AS code_slug FROM preds)",
            select=f"SELECT {KEY}, code, code_slug, occurs_probs FROM p WHERE code_slug IN (SELECT code_slug FROM task)"),
)
def _slug_filter(spark, sf):
    return evalsets.slug_filter(predictions(spark, sf), eval_task(spark, sf))


# --- Metrics ------------------------------------------------------------------------------------------


@query(
    "auroc",
    "SELECT round(auroc, 9) AS auroc, n_pos, n_neg FROM "
    + rank_auroc("(SELECT n_chars, quality = 1 AS good FROM labels JOIN documents USING (doc_id))", "n_chars", "good"),
)
def _auroc(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    # Lengths are whole numbers far above one, so wider score cells.
    out = metrics.auroc(rows, "n_chars", "quality", cells=(4096.0, 16.0))
    return out.select(F.round("auroc", 9).alias("auroc"), "n_pos", "n_neg")


_PER_CODE = log_sql(
    *_PREDS, INDEX, EVAL_TASK,
    "j AS (SELECT p.code, occurs_probs, task.occurs FROM preds p JOIN task ON p.subject_id = task.subject_id "
    "AND p.prediction_time = task.prediction_time AND p.code = task.query)",
    select="SELECT code, round(auroc, 9) AS auroc, n_pos, n_neg FROM " + rank_auroc("j", "occurs_probs", "occurs", "code"),
)


def per_code(spark, sf):
    return evaluation.auroc_per_code(predictions(spark, sf), eval_task(spark, sf))


@query("auroc_per_code", _PER_CODE)
def _auroc_per_code(spark, sf):
    return per_code(spark, sf).select("code", F.round("auroc", 9).alias("auroc"), "n_pos", "n_neg")


@query(
    "wide_metrics",
    log_sql(
        *_PREDS, INDEX, EVAL_TASK,
        "j AS (SELECT p.code, occurs_probs, task.occurs FROM preds p JOIN task ON p.subject_id = task.subject_id "
        "AND p.prediction_time = task.prediction_time AND p.code = task.query)",
        "m AS (SELECT * FROM " + rank_auroc("j", "occurs_probs", "occurs", "code") + ")",
        select="SELECT " + ", ".join(f"round(max(CASE WHEN code = '{c}' THEN auroc END), 9) AS \"{c}\"" for c in EVAL_CODES) + " FROM m",
    ),
)
def _wide(spark, sf):
    rounded = per_code(spark, sf).withColumn("auroc", F.round("auroc", 9))
    return metrics.wide_metrics(rounded, "code", "auroc", EVAL_CODES)


_TWO_HEAD = [
    *_SCORED,
    "oa AS (SELECT * FROM " + rank_auroc("(SELECT * FROM scored WHERE NOT boolean_value)", "occurs_probs", "occurs", "query") + ")",
    "ca AS (SELECT * FROM " + rank_auroc("scored", "censor_probs", "boolean_value", "query") + ")",
    "heads AS (SELECT ca.query AS code, round(oa.auroc, 9) AS occurs_auc, round(ca.auroc, 9) AS censor_auc "
    "FROM ca LEFT JOIN oa USING (query))",
]


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query("auroc_two_head", log_sql(*_TWO_HEAD, select="SELECT * FROM heads"))
def _two_head(spark, sf):
    rows = scored_labels(spark, sf).withColumnRenamed("query", "code")
    return _rounded(metrics.auroc_two_head(rows, ["code"]), "occurs_auc", "censor_auc")


@query(
    "bucket_metrics",
    log_sql(*_TWO_HEAD, select=f"SELECT *, CASE WHEN code = '4-NOT SPECIFIED' THEN 'ood' ELSE 'id' END AS bucket, {slug_sql('code')} AS code_slug FROM heads"),
)
def _bucket(spark, sf):
    out = evaluation.bucket_metrics(scored_labels(spark, sf), code_list(spark, OOD_CODES))
    return _rounded(out, "occurs_auc", "censor_auc")


@query(
    "write_code_report",
    log_sql(*_TWO_HEAD, select=f"SELECT *, CASE WHEN code = '4-NOT SPECIFIED' THEN 'ood' ELSE 'id' END AS bucket, {slug_sql('code')} AS code_slug FROM heads"),
)
def _code_report(spark, sf):
    report = evaluation.bucket_metrics(scored_labels(spark, sf), code_list(spark, OOD_CODES))
    path = sinks.write_code_report(report, fresh_path(spark, "reports"), "per_code", dt.datetime(2020, 1, 1))
    return _rounded(spark.read.schema(sinks.REPORT).csv(path, header=True), "occurs_auc", "censor_auc")


@query("uncensored_mask", log_sql(*_SCORED, select=f"SELECT {KEY}, query, occurs FROM scored WHERE NOT boolean_value"))
def _mask(spark, sf):
    heads = metrics.two_head_rows(scored_labels(spark, sf), ["subject_id", "prediction_time", "query"])
    return heads.where("head = 'occurs'").select("subject_id", "prediction_time", "query", F.col("target").alias("occurs"))


_BATCH = "subject_id % 499"


@query(
    "auroc_batch_gated",
    log_sql(
        *_SCORED,
        f"mixed AS (SELECT *, {_BATCH} AS batch FROM scored WHERE NOT boolean_value)",
        "kept AS (SELECT * FROM mixed WHERE batch IN (SELECT batch FROM mixed GROUP BY batch HAVING count(DISTINCT occurs) = 2))",
        select="SELECT round(auroc, 9) AS auroc, n_pos, n_neg FROM " + rank_auroc("kept", "occurs_probs", "occurs"),
    ),
)
def _gated(spark, sf):
    rows = scored_labels(spark, sf).where("NOT boolean_value").withColumn("batch", F.pmod("subject_id", F.lit(499)))
    out = metrics.auroc_batch_gated(rows, "occurs_probs", "occurs", ["batch"])
    return out.select(F.round("auroc", 9).alias("auroc"), "n_pos", "n_neg")


def _bce(x: str, y: str) -> str:
    return f"(greatest({x}, 0) - {x} * {y}::INTEGER + ln(1 + exp(-abs({x}))))"


_LOSS = (
    f"avg({_bce('censor_logit', 'boolean_value')}) AS censor_loss, "
    f"avg({_bce('occurs_logit', 'occurs')}) FILTER (WHERE NOT boolean_value) AS occurs_loss, count(*) AS n_rows"
)


@query(
    "log_loss",
    log_sql(*_SCORED, f"l AS (SELECT query, {_LOSS} FROM scored GROUP BY query)",
            select="SELECT query, round(censor_loss, 9) AS censor_loss, round(occurs_loss, 9) AS occurs_loss, n_rows, "
            "round(censor_loss + occurs_loss, 9) AS loss FROM l"),
)
def _log_loss(spark, sf):
    return _rounded(metrics.log_loss(scored_labels(spark, sf), ["query"]), "censor_loss", "occurs_loss", "loss")


@query(
    "epoch_mean_loss",
    log_sql(*_SCORED, "s AS (SELECT *, CASE WHEN subject_id % 10 < 8 THEN 'train' WHEN subject_id % 10 = 8 THEN 'tuning' ELSE 'held_out' "
            f"END AS split, {_BATCH} AS batch FROM scored)", f"l AS (SELECT split, batch, {_LOSS} FROM s GROUP BY split, batch)",
            select="SELECT split, round(sum((censor_loss + occurs_loss) * n_rows) / sum(n_rows) FILTER (WHERE occurs_loss IS NOT NULL), 9) AS mean_loss, "
            "(sum(n_rows) FILTER (WHERE occurs_loss IS NOT NULL))::BIGINT AS n_rows FROM l GROUP BY split"),
)
def _epoch(spark, sf):
    rows = with_split(scored_labels(spark, sf)).withColumn("batch", F.pmod("subject_id", F.lit(499)))
    batches = metrics.log_loss(rows, ["split", "batch"])
    return _rounded(metrics.epoch_mean_loss(batches), "mean_loss")


@query("sigmoid", log_sql(*_SCORED, select=f"SELECT {KEY}, query, round(1 / (1 + exp(-occurs_logit)), 9) AS p FROM scored"))
def _sigmoid(spark, sf):
    return scored_labels(spark, sf).select("subject_id", "prediction_time", "query", F.round(sigmoid("occurs_logit"), 9).alias("p"))


# --- Composites ---------------------------------------------------------------------------------------

_COMPOSITE = [
    *_PREDS,
    "risks AS (SELECT subject_id, prediction_time, list_sort(list(occurs_probs)) AS p FROM preds GROUP BY ALL)",
    "comp AS (SELECT subject_id, prediction_time, list_max(p) AS prob_max, "
    "1 - list_reduce(list_prepend(1::DOUBLE, [1 - x FOR x IN p]), lambda a, b: a * b) AS prob_or, "
    "list_reduce(list_prepend(0::DOUBLE, p), lambda a, b: a + b) AS prob_sum FROM risks)",
]


def _one(kind: str):
    def run(spark, sf):
        return _rounded(composite.composite_probs(predictions(spark, sf), [kind]), f"prob_{kind}")

    query(f"composite_{kind}", log_sql(*_COMPOSITE, select=f"SELECT {KEY}, round(prob_{kind}, 9) AS prob_{kind} FROM comp"))(run)


_KINDS = ("max", "or", "sum")
for _kind in _KINDS:
    _one(_kind)


@query(
    "sort_composite",
    log_sql(*_COMPOSITE, select=f"SELECT {KEY}, prob_max, row_number() OVER (ORDER BY subject_id, prediction_time) - 1 AS row_no FROM comp"),
)
def _sort_composite(spark, sf):
    rows = composite.composite_probs(predictions(spark, sf), ["max"])
    return numbered(rows, ["subject_id", "prediction_time"], "row_no").orderBy("row_no")


_JOINED = "joined AS (SELECT comp.*, ext.boolean_value FROM comp JOIN ext USING (subject_id, prediction_time))"
_ALL = ["max", "OR", "Sum"]


@query(
    "composite_label_join",
    log_sql(*_COMPOSITE, EXTERNAL, _JOINED, select=f"SELECT {KEY}, boolean_value, prob_max, round(prob_or, 9) AS prob_or, "
            "round(prob_sum, 9) AS prob_sum FROM joined"),
)
def _composite_join(spark, sf):
    out = composite.composite_with_labels(predictions(spark, sf), external_cohort(spark, sf), _ALL)
    return _rounded(out, "prob_or", "prob_sum")


def _composite_auc(columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {columns.format(k=k)} FROM " + rank_auroc(f"(SELECT boolean_value, prob_{k} AS s FROM joined)", "s", "boolean_value")
        for k in _KINDS
    )


@query("composite_agg", log_sql(*_COMPOSITE, EXTERNAL, _JOINED, select=_composite_auc("'prob_{k}' AS measure, round(auroc, 9) AS auroc, n_pos, n_neg")))
def _composite_agg(spark, sf):
    joined = composite.composite_with_labels(predictions(spark, sf), external_cohort(spark, sf), _ALL)
    out = composite.composite_auroc(joined)
    return out.select("measure", F.round("auroc", 9).alias("auroc"), "n_pos", "n_neg")


@query(
    "union_codes",
    log_sql(*_PREDS, select=f"SELECT {KEY}, occurs_probs, code FROM preds"),
)
def _union_codes(spark, sf):
    # Stored once, as a model would leave them; a union of one plan several times over would hold all of it in each task.
    path = fresh_path(spark, "predictions")
    predictions(spark, sf).write.parquet(path)
    rows = spark.read.parquet(path)
    per_code = [rows.where(F.col("code") == c) for c in ID_CODES + OOD_CODES + MANUAL_CODES]
    return reduce(DataFrame.unionByName, per_code)


@query(
    "composite_report",
    log_sql(
        *_COMPOSITE, EXTERNAL, _JOINED, INDEX, EVAL_TASK,
        "j AS (SELECT p.code, occurs_probs, task.occurs FROM preds p JOIN task ON p.subject_id = task.subject_id "
        "AND p.prediction_time = task.prediction_time AND p.code = task.query)",
        "parts AS (" + _composite_auc("'composite' AS part, 'prob_{k}' AS name, NULL::VARCHAR AS bucket, auroc")
        + " UNION ALL SELECT 'code', code, CASE WHEN code = '4-NOT SPECIFIED' THEN 'ood' ELSE 'id' END, auroc FROM "
        + rank_auroc("j", "occurs_probs", "occurs", "code") + ")",
        select="SELECT part, name, bucket, round(auroc, 6) AS auroc FROM parts",
    ),
)
def _report(spark, sf):
    report = evaluation.composite_report(
        predictions(spark, sf), external_cohort(spark, sf), eval_task(spark, sf), code_list(spark, OOD_CODES), _ALL
    )
    return report.withColumn("auroc", F.round("auroc", 6))


__all__ = ["EVAL_TASK", "eval_task", "per_code"]
