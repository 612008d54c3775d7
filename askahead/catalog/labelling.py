"""Queries: scanning, context, labels, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from askahead.catalog.base import (
    CLICK_LABELS,
    CODES,
    DAYS_CLICKS,
    DAYS_ORDERS,
    E,
    INDEX,
    INDEX_SEED,
    L,
    MIN_CLICKS,
    MIN_ORDERS,
    ORDER_LABELS,
    ORDERS,
    TIME_KEY,
    V,
    VE,
    cand,
    clicks,
    exists_within,
    grid,
    log_sql,
    order_candidates,
    order_index,
    order_labels,
    orders_log,
    query,
    sample,
    shipments,
)
from askahead.functions import interval_days
from askahead.operators import context, labels, sampling, timeline, zones
from askahead.operators.codesets import codes_array, numbered
from askahead.operators.quality import null_flags, unlabelled
from askahead.plans.labels import collate_labels, duration_counts, label_table, training_table
from askahead.session import fresh_path
from askahead.sources.sinks import write_checked
from askahead.sources.tables import in_split, pruned_labels, scan_events

KEY = "subject_id, prediction_time"


@query("scan_events", log_sql(V, VE, select="SELECT * FROM e"))
def _scan(spark, sf):
    return scan_events(clicks(spark, sf))


@query(
    "sort_events",
    log_sql(V, VE, select="SELECT *, row_number() OVER (ORDER BY subject_id, time, code) - 1 AS row_no FROM e"),
)
def _sort(spark, sf):
    return numbered(scan_events(clicks(spark, sf)), ["subject_id", "time", "code"], "row_no").orderBy("row_no")


@query("distinct_rows", log_sql(E, select="SELECT DISTINCT subject_id, code FROM e"))
def _distinct(spark, sf):
    return orders_log(spark, sf).select("subject_id", "code").distinct()


@query("code_filter", log_sql(E, select="SELECT subject_id, time FROM e WHERE code = '2-HIGH'"))
def _code_filter(spark, sf):
    return scan_events(orders_log(spark, sf)).where(F.col("code") == "2-HIGH").drop("code")


_CONTEXT = cand(MIN_ORDERS, DAYS_ORDERS)


@query("context_count", log_sql(E, _CONTEXT, select="SELECT DISTINCT subject_id, time, context_count FROM ctx"))
def _context(spark, sf):
    return context.context_count(orders_log(spark, sf)).drop("n_events")


@query(
    "min_context_filter",
    log_sql(E, _CONTEXT, select="SELECT subject_id, time, code FROM e JOIN (SELECT DISTINCT subject_id, time FROM ctx "
            f"WHERE context_count >= {MIN_ORDERS}) USING (subject_id, time)"),
)
def _min_context(spark, sf):
    log = orders_log(spark, sf)
    kept = context.candidate_times(log, MIN_ORDERS).withColumnRenamed("prediction_time", "time")
    return scan_events(log).join(kept, ["subject_id", "time"], "left_semi")


@query("candidate_times", log_sql(ORDERS, select=f"SELECT {KEY} FROM cand"))
def _candidates(spark, sf):
    return context.candidate_times(orders_log(spark, sf), MIN_ORDERS)


@query("record_end", log_sql(ORDERS, select="SELECT * FROM rec"))
def _record_end(spark, sf):
    return context.record_end(orders_log(spark, sf))


@query("record_end_join", log_sql(ORDERS, select=f"SELECT {KEY}, record_end_time FROM cand"))
def _record_end_join(spark, sf):
    return context.candidates_with_record_end(orders_log(spark, sf), MIN_ORDERS)


@query("censor_flag", log_sql(ORDERS, select=f"SELECT {KEY}, censored FROM cand"))
def _censor(spark, sf):
    return context.censored_candidates(orders_log(spark, sf), MIN_ORDERS, DAYS_ORDERS)


@query(
    "censor_split",
    log_sql(ORDERS, select=f"SELECT {KEY}, 'censored' AS part FROM cand WHERE censored UNION ALL "
            f"SELECT {KEY}, 'uncensored' FROM cand WHERE NOT censored"),
)
def _split(spark, sf):
    yes, no = labels.split_by_censoring(order_candidates(spark, sf).select("subject_id", "prediction_time", "censored"))
    return yes.withColumn("part", F.lit("censored")).unionByName(no.withColumn("part", F.lit("uncensored"))).drop("censored")


@query(
    "row_index",
    log_sql(ORDERS, select=f"SELECT {KEY}, row_number() OVER (PARTITION BY subject_id ORDER BY prediction_time) - 1 "
            "AS row_index FROM cand"),
)
def _row_index(spark, sf):
    return context.row_index(context.candidate_times(orders_log(spark, sf), MIN_ORDERS))


@query(
    "ts_arith",
    log_sql(ORDERS, select=f"SELECT {KEY}, prediction_time + INTERVAL 90 DAY AS window_end, "
            "epoch_us(record_end_time) - epoch_us(prediction_time) AS future_us FROM cand"),
)
def _ts_arith(spark, sf):
    rows = order_candidates(spark, sf)
    return rows.select(
        "subject_id",
        "prediction_time",
        (F.col("prediction_time") + interval_days(90)).alias("window_end"),
        F.timestamp_diff("MICROSECOND", F.col("prediction_time"), F.col("record_end_time")).alias("future_us"),
    )


@query(
    "open_interval_predicate",
    log_sql(ORDERS, INDEX, select="SELECT subject_id, prediction_time, time, code FROM idx JOIN e USING (subject_id) "
            "WHERE time > prediction_time AND time < prediction_time + INTERVAL 90 DAY"),
)
def _open_interval(spark, sf):
    return labels.events_inside(order_index(spark, sf).drop("censored"), scan_events(orders_log(spark, sf)), DAYS_ORDERS)


def _uncensored(spark, sf):
    return order_candidates(spark, sf).where(~F.col("censored")).drop("censored", "record_end_time")


_HITS = log_sql(ORDER_LABELS, select=f"SELECT {KEY}, query FROM labels WHERE occurs")


@query("occurrence_range_join", _HITS)
def _range_join(spark, sf):
    log = orders_log(spark, sf)
    return zones.occurrences(_uncensored(spark, sf), log, DAYS_ORDERS, None)


@query(
    "any_occurrence",
    log_sql(ORDER_LABELS, select=f"SELECT {KEY}, bool_or(occurs) AS any_code FROM labels WHERE NOT censored GROUP BY ALL"),
)
def _any(spark, sf):
    rows = order_labels(spark, sf).where(~F.col("censored"))
    return rows.groupBy("subject_id", "prediction_time").agg(F.bool_or("occurs").alias("any_code"))


@query("dense_label_join", log_sql(ORDER_LABELS, select=f"SELECT {KEY}, query, occurs FROM labels WHERE NOT censored"))
def _dense(spark, sf):
    log = orders_log(spark, sf)
    return labels.dense_labels(order_candidates(spark, sf), log, None, DAYS_ORDERS)


@query(
    "asof_next_event",
    log_sql(
        V, VE, CODES, cand(MIN_CLICKS, DAYS_CLICKS),
        select=f"""SELECT {KEY}, c.code, (SELECT min(e.time) FROM e WHERE e.subject_id = cand.subject_id
        AND e.code = c.code AND e.time > cand.prediction_time) AS next_time FROM cand CROSS JOIN codes c""",
    ),
)
def _next(spark, sf):
    log = scan_events(clicks(spark, sf))
    probes = context.candidate_times(log, MIN_CLICKS)
    return timeline.with_all_codes(timeline.next_times(probes, log), probes, codes_array(log.select("code")))


@query("null_labels_for_censored", log_sql(ORDER_LABELS, select=f"SELECT {KEY}, query, occurs FROM labels WHERE censored"))
def _null_labels(spark, sf):
    return order_labels(spark, sf).where("censored").select("subject_id", "prediction_time", "query", "occurs")


@query("union_labels", log_sql(ORDER_LABELS, select=f"SELECT {KEY}, query, occurs FROM labels"))
def _union_labels(spark, sf):
    log = orders_log(spark, sf)
    rows = order_candidates(spark, sf)
    gone = (
        rows.where("censored")
        .withColumn("query", F.explode(codes_array(log.select("code"))))
        .select("subject_id", "prediction_time", "query", F.lit(None).cast("boolean").alias("occurs"))
    )
    return labels.union_labels(gone, labels.dense_labels(rows, log, None, DAYS_ORDERS))


@query("label_table", log_sql(ORDER_LABELS, select="SELECT * FROM labels"))
def _label_table(spark, sf):
    return order_labels(spark, sf)


@query("label_table_clicks", log_sql(CLICK_LABELS, select="SELECT * FROM labels"))
def _label_table_clicks(spark, sf):
    return label_table(clicks(spark, sf), None, [DAYS_CLICKS], MIN_CLICKS)


@query(
    "duration_grid",
    log_sql(
        E, CODES, _CONTEXT,
        "nxt AS (SELECT cand.subject_id, prediction_time, record_end_time, c.code AS query, (SELECT min(e.time) FROM e WHERE "
        "e.subject_id = cand.subject_id AND e.code = c.code AND e.time > cand.prediction_time) AS next_time "
        "FROM cand CROSS JOIN codes c)",
        "cells AS (SELECT *, record_end_time - prediction_time < to_days(d::INTEGER) AS censored, "
        "coalesce(next_time < prediction_time + to_days(d::INTEGER), false) AS hit FROM nxt CROSS JOIN range(30, 366) t(d))",
        select="SELECT d::INTEGER AS duration_days, query, count(*) FILTER (WHERE NOT censored AND hit) AS n_true, "
        "count(*) FILTER (WHERE NOT censored AND NOT hit) AS n_false, count(*) FILTER (WHERE censored) AS n_censored "
        "FROM cells GROUP BY d, query",
    ),
)
def _duration_grid(spark, sf):
    return duration_counts(orders_log(spark, sf), None, range(30, 366), MIN_ORDERS)


_THREE = [30, 60, 90]
_DURATIONS = ", ".join(
    [ORDERS]
    + [
        f"""l{d} AS (SELECT subject_id, prediction_time, query, {d} AS duration_days,
        record_end_time - prediction_time < INTERVAL {d} DAY AS censored, {exists_within(str(d))} AS hit
        FROM (SELECT cand.*, code AS query FROM cand CROSS JOIN codes) g)"""
        for d in _THREE
    ]
    + [
        "labels AS (SELECT subject_id, prediction_time, query, duration_days, censored, "
        "CASE WHEN NOT censored THEN hit END AS occurs FROM ("
        + " UNION ALL ".join(f"SELECT * FROM l{d}" for d in _THREE)
        + "))"
    ]
)


@query("union_durations", log_sql(_DURATIONS, select="SELECT * FROM labels"))
def _union_durations(spark, sf):
    # One table per duration; a grid of all durations gives the same rows from one zone map.
    return reduce(labels.union_labels, [order_labels(spark, sf, [d]) for d in _THREE])


_PIVOT = ", ".join(f"bool_or(occurs) FILTER (WHERE query = '{c}') AS \"{c}\"" for c in ("1-URGENT", "3-MEDIUM", "5-LOW"))


@query("assemble_wide", log_sql(ORDER_LABELS, select=f"SELECT {KEY}, censored, {_PIVOT} FROM labels GROUP BY ALL"))
def _wide(spark, sf):
    return labels.assemble_wide(order_labels(spark, sf), ["1-URGENT", "3-MEDIUM", "5-LOW"])


@query(
    "unpivot_labels",
    log_sql(ORDER_LABELS, select=f"SELECT {KEY}, censored, query, occurs FROM labels WHERE query IN ('1-URGENT', '3-MEDIUM', '5-LOW')"),
)
def _unpivot(spark, sf):
    codes = ["1-URGENT", "3-MEDIUM", "5-LOW"]
    return labels.unpivot_labels(labels.assemble_wide(order_labels(spark, sf), codes), codes)


@query(
    "pruned_matrix_read",
    log_sql(ORDER_LABELS, select=f"SELECT {KEY}, query, censored, occurs FROM labels WHERE query IN ('1-URGENT', '5-LOW')"),
)
def _pruned(spark, sf):
    path = fresh_path(spark, "labels")
    order_labels(spark, sf).write.parquet(path)
    return pruned_labels(spark.read.parquet(path), ["1-URGENT", "5-LOW"])


@query(
    "fill_occurs_false",
    log_sql(ORDER_LABELS, select=f"SELECT {KEY}, query, censored AS boolean_value, coalesce(occurs, false) AS occurs FROM labels"),
)
def _fill(spark, sf):
    return labels.to_training_rows(order_labels(spark, sf)).drop("duration_days")


@query("drop_unlabelled", log_sql(ORDER_LABELS, select=f"SELECT {KEY}, query, occurs FROM labels WHERE occurs IS NOT NULL"))
def _drop(spark, sf):
    return labels.drop_unlabelled(order_labels(spark, sf)).select("subject_id", "prediction_time", "query", "occurs")


@query("drop_columns", log_sql(ORDERS, select=f"SELECT {KEY} FROM cand WHERE NOT censored"))
def _drop_columns(spark, sf):
    return _uncensored(spark, sf)


@query(
    "rename_roles",
    log_sql(ORDER_LABELS, select=f"SELECT {KEY}, censored AS boolean_value, occurs AS task_label FROM labels WHERE query = '1-URGENT'"),
)
def _rename(spark, sf):
    rows = order_labels(spark, sf).where(F.col("query") == "1-URGENT").select("subject_id", "prediction_time", "censored", "occurs")
    return rows.withColumnsRenamed({"censored": "boolean_value", "occurs": "task_label"})


@query(
    "lit_tags",
    log_sql(ORDERS, select=f"SELECT {KEY}, censored, '1-URGENT' AS query, 90 AS duration_days FROM cand"),
)
def _lit(spark, sf):
    rows = order_candidates(spark, sf).drop("record_end_time")
    return rows.withColumns({"query": F.lit("1-URGENT"), "duration_days": F.lit(DAYS_ORDERS)})


@query(
    "null_counts",
    log_sql(ORDER_LABELS, select="SELECT count(*) FILTER (WHERE censored IS NULL) AS censored, "
            "count(*) FILTER (WHERE occurs IS NULL) AS occurs FROM labels"),
)
def _nulls(spark, sf):
    """Counted while the table is written."""
    found = write_checked(spark, lambda s: order_labels(s, sf), fresh_path(spark, "labels"), {}, null_flags(["censored", "occurs"]))
    return spark.createDataFrame([(found["censored"], found["occurs"])], "censored bigint, occurs bigint")


@query(
    "assert_no_null_labels",
    log_sql(ORDER_LABELS, select="SELECT count(*) AS n_null_labels FROM labels WHERE NOT censored AND occurs IS NULL"),
)
def _assert_labels(spark, sf):
    """Counted while the table is written, which a single such row would undo."""
    found = write_checked(spark, lambda s: order_labels(s, sf), fresh_path(spark, "labels"), {"n_null_labels": unlabelled()})
    return spark.createDataFrame([(found["n_null_labels"],)], "n_null_labels bigint")


_SAMPLE_KEY = "subject_id, epoch_us(prediction_time), query, duration_days"
_TRAIN = ("subject_id, prediction_time, censored AS boolean_value, coalesce(occurs, false) AS occurs, query, duration_days")


@query(
    "sample_k_per_subject",
    log_sql(ORDER_LABELS, select=f"SELECT * FROM {sample('labels', _SAMPLE_KEY, 20, 1, '* EXCLUDE (nth)')}"),
)
def _sample_k(spark, sf):
    keys = ["subject_id", "prediction_time", "query", "duration_days"]
    return sampling.sample_per_subject(order_labels(spark, sf), keys, 20, 1)


@query("collate", log_sql(_DURATIONS, select=f"SELECT * FROM {sample('labels', _SAMPLE_KEY, 20, 1, _TRAIN)}"))
def _collate(spark, sf):
    return collate_labels(order_labels(spark, sf, _THREE), 20, 1)


@query("sample_index_times", log_sql(ORDERS, INDEX, select="SELECT * FROM idx WHERE subject_id % 10 = 9"))
def _index_times(spark, sf):
    return sampling.sample_index_times(order_candidates(spark, sf), 1, INDEX_SEED, in_split("held_out"))


@query(
    "seeded_shuffle",
    log_sql(ORDERS, f"s AS (SELECT {KEY}, md5(concat_ws('|', {TIME_KEY}, 5)) AS shuffle_key FROM cand)",
            select="SELECT *, row_number() OVER (ORDER BY shuffle_key, subject_id, prediction_time) - 1 AS row_no FROM s"),
)
def _shuffle(spark, sf):
    rows = context.candidate_times(orders_log(spark, sf), MIN_ORDERS)
    keys = ["subject_id", "prediction_time"]
    return numbered(sampling.seeded_shuffle(rows, keys, 5), ["shuffle_key", *keys], "row_no").orderBy("row_no")


def _floyd(log: str, min_context: int, k: int, seed: int) -> str:
    """Questions drawn per subject, one draw per recursion step."""
    return f"""WITH RECURSIVE {log}, {CODES}, {cand(min_context, 1)},
    numbered AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY prediction_time) - 1 AS row_index FROM cand),
    vocab AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS ci FROM codes),
    sizes AS (SELECT subject_id, (count(*) * (SELECT count(*) FROM codes) * 336)::BIGINT AS pop FROM cand GROUP BY subject_id),
    floyd AS (
        SELECT subject_id, pop, least({k}, pop)::BIGINT AS size, 0::BIGINT AS i, []::BIGINT[] AS taken FROM sizes
        UNION ALL
        SELECT subject_id, pop, size, i + 1, list_append(taken, CASE WHEN list_contains(taken, pick) THEN top ELSE pick END)
        FROM (SELECT *, pop - size + i AS top,
              ('0x' || substr(md5(concat_ws('|', subject_id, i, {seed})), 1, 15))::BIGINT % (pop - size + i + 1) AS pick
              FROM floyd WHERE i < size)),
    cells AS (SELECT subject_id, unnest(taken) AS cell FROM floyd WHERE i = size),
    g AS (SELECT n.subject_id, n.prediction_time, vocab.code AS query, (cell % 336 + 30)::INTEGER AS duration_days, n.record_end_time
        FROM cells JOIN numbered n ON n.subject_id = cells.subject_id
            AND n.row_index = (cell // 336) // (SELECT count(*) FROM codes)
        JOIN vocab ON vocab.ci = (cell // 336) % (SELECT count(*) FROM codes))"""


_GRID_SAMPLE = """ SELECT subject_id, prediction_time, query, duration_days FROM g"""
_GRID_TRAIN = """, nxt AS (SELECT g.*, (SELECT min(e.time) FROM e WHERE e.subject_id = g.subject_id AND e.code = g.query
    AND e.time > g.prediction_time) AS next_time FROM g)
    SELECT subject_id, prediction_time, query, duration_days,
    record_end_time - prediction_time < to_days(duration_days) AS boolean_value,
    coalesce(next_time < prediction_time + to_days(duration_days), false)
        AND NOT (record_end_time - prediction_time < to_days(duration_days)) AS occurs FROM nxt"""


@query("sample_grid_at_scale", _floyd(E, MIN_ORDERS, 20, 9) + _GRID_SAMPLE)
def _sample_grid(spark, sf):
    return sampling.sample_log(orders_log(spark, sf), None, range(30, 366), 20, 9, MIN_ORDERS).drop("record_end_time")


@query("collate_sampled", _floyd(E, MIN_ORDERS, 20, 1) + _GRID_TRAIN)
def _training(spark, sf):
    log = orders_log(spark, sf)
    return training_table(log, None, range(30, 366), 20, 1, MIN_ORDERS)


@query("collate_sampled_parts", _floyd(L, 50, 20, 1) + _GRID_TRAIN)
def _training_parts(spark, sf):
    log = shipments(spark, sf)
    return training_table(log, None, range(30, 366), 20, 1, 50)
