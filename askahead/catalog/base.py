"""Registry of queries over the given tables, and the views and SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askahead.operators.codesets import codes_array
from askahead.operators.context import candidate_times, candidates_with_record_end, censor_flag
from askahead.operators.sampling import sample_per_subject
from askahead.plans.labels import label_table
from askahead.session import configure
from askahead.sources.tables import code_vocab, event_view

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Prediction times of the orders log need 5 events of context, those of the click log 20.
MIN_ORDERS, DAYS_ORDERS = 5, 90
MIN_CLICKS, DAYS_CLICKS = 20, 3
INDEX_SEED = 43
ID_CODES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
OOD_CODES = ["4-NOT SPECIFIED"]
MANUAL_CODES = ["5-LOW"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where there is one, the SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as subjects, order priorities as codes."""
    return event_view(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderpriority")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as subjects, event types as codes, with values."""
    return event_view(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "value")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as subjects, parts as codes: long records and a large vocabulary."""
    rows = table(spark, sf_dir, "lineitem").withColumn("code", F.concat(F.lit("PART//"), F.col("l_partkey").cast("string")))
    return event_view(rows, "l_suppkey", "l_shipdate", "code")


def part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A universe of a few thousand codes with spaces, slashes and some TIME codes."""
    marker = F.when(F.col("p_size") % 9 == 0, F.lit(" //TIME")).otherwise(F.lit(""))
    return table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" // "), "p_brand", marker).alias("code"))


def order_labels(spark: SparkSession, sf_dir: str, durations: list[int] | None = None) -> DataFrame:
    return label_table(orders_log(spark, sf_dir), None, durations or [DAYS_ORDERS], MIN_ORDERS)


def order_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with record end and censoring flag."""
    return candidates_with_record_end(orders_log(spark, sf_dir), MIN_ORDERS).withColumn(
        "censored", censor_flag(DAYS_ORDERS)
    )


def order_index(spark: SparkSession, sf_dir: str, seed: int = INDEX_SEED) -> DataFrame:
    """One sampled prediction time per customer with its flag."""
    times = order_candidates(spark, sf_dir).select("subject_id", "prediction_time", "censored")
    return sample_per_subject(times, ["subject_id", "prediction_time"], 1, seed)


def external_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cohort defined elsewhere: its own times and an outcome of its own."""
    return order_index(spark, sf_dir, 7).select(
        "subject_id", "prediction_time", (F.col("subject_id") % 3 == 0).alias("boolean_value")
    )


def click_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_vocab(clicks(spark, sf_dir))


def click_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_table(clicks(spark, sf_dir), None, [DAYS_CLICKS], MIN_CLICKS)


def _score(*weights: int) -> F.Column:
    day = F.datediff(F.col("prediction_time").cast("date"), F.lit("1970-01-01").cast("date"))
    w = [F.lit(x).cast("bigint") for x in weights]
    return F.pmod(F.col("subject_id") * w[0] + day * w[1] + F.ascii("query") * w[2], F.lit(1000))


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows with deterministic stand-ins for the outputs of a two-head model."""
    return order_labels(spark, sf_dir).select(
        "subject_id",
        "prediction_time",
        "query",
        "duration_days",
        F.col("censored").alias("boolean_value"),
        F.coalesce("occurs", F.lit(False)).alias("occurs"),
        (_score(7919, 104729, 15485863) / 1000).alias("occurs_probs"),
        (_score(31, 7, 13) / 1000).alias("censor_probs"),
        ((_score(7919, 104729, 15485863) - 500) / 100).alias("occurs_logit"),
        ((_score(31, 7, 13) - 500) / 125).alias("censor_logit"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for every candidate and code, as a model would leave them."""
    log = orders_log(spark, sf_dir)
    asked = candidate_times(log, MIN_ORDERS).withColumn("query", F.explode(codes_array(log.select("code"))))
    return asked.select(
        "subject_id",
        "prediction_time",
        (_score(7919, 104729, 15485863) / 1000).alias("occurs_probs"),
        F.col("query").alias("code"),
    )


# --- The same things in SQL. Occurrence is an EXISTS over the events here, not a zone map. -------------

E = "e AS (SELECT DISTINCT o_custkey AS subject_id, o_orderdate AS time, o_orderpriority AS code FROM orders)"
V = "v AS (SELECT user_id AS subject_id, ts AS time, event_type AS code, value AS numeric_value FROM events)"
VE = "e AS (SELECT DISTINCT subject_id, time, code FROM v)"
L = "e AS (SELECT DISTINCT l_suppkey AS subject_id, l_shipdate AS time, 'PART//' || l_partkey AS code FROM lineitem)"
CODES = "codes AS (SELECT DISTINCT code FROM e)"
PARTS = (
    "u AS (SELECT DISTINCT p_name || ' // ' || p_brand || CASE WHEN p_size % 9 = 0 THEN ' //TIME' ELSE '' END AS code "
    "FROM part)"
)


def cand(min_context: int, days: int) -> str:
    return f"""ctx AS (SELECT subject_id, time,
        count(time) OVER (PARTITION BY subject_id ORDER BY time RANGE UNBOUNDED PRECEDING) AS context_count FROM e),
    rec AS (SELECT subject_id, max(time) AS record_end_time FROM e GROUP BY subject_id),
    cand AS (SELECT DISTINCT ctx.subject_id, ctx.time AS prediction_time, rec.record_end_time,
        rec.record_end_time - ctx.time < INTERVAL {days} DAY AS censored
        FROM ctx JOIN rec USING (subject_id) WHERE context_count >= {min_context})"""


def exists_within(days: str) -> str:
    return f"""EXISTS (SELECT 1 FROM e WHERE e.subject_id = g.subject_id AND e.code = g.query
        AND e.time > g.prediction_time AND e.time < g.prediction_time + INTERVAL ({days}) DAY)"""


def grid(days: int) -> str:
    return f"""labels AS (SELECT subject_id, prediction_time, query, {days} AS duration_days, censored,
        CASE WHEN NOT censored THEN {exists_within(str(days))} END AS occurs
        FROM (SELECT cand.*, code AS query FROM cand CROSS JOIN codes) g)"""


def sample(source: str, key: str, k: int, seed: int, columns: str) -> str:
    return f"""(SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY subject_id
        ORDER BY md5(concat_ws('|', {key}, {seed}))) AS nth FROM {source}) WHERE nth <= {k})"""


TIME_KEY = "subject_id, epoch_us(prediction_time)"
ORDERS = ", ".join([E, CODES, cand(MIN_ORDERS, DAYS_ORDERS)])
ORDER_LABELS = ", ".join([ORDERS, grid(DAYS_ORDERS)])
CLICK_LABELS = ", ".join([V, VE, CODES, cand(MIN_CLICKS, DAYS_CLICKS), grid(DAYS_CLICKS)])
INDEX = f"idx AS {sample('cand', TIME_KEY, 1, INDEX_SEED, 'subject_id, prediction_time, censored')}"
EXTERNAL = (
    "ext AS (SELECT subject_id, prediction_time, subject_id % 3 = 0 AS boolean_value FROM "
    + sample("cand", TIME_KEY, 1, 7, "subject_id, prediction_time")
    + ")"
)


def _score_sql(a: int, b: int, c: int) -> str:
    return (
        f"((subject_id * {a} + date_diff('day', DATE '1970-01-01', prediction_time::DATE) * {b}"
        f" + ascii(query) * {c}) % 1000)"
    )


_P, _Q = _score_sql(7919, 104729, 15485863), _score_sql(31, 7, 13)
SCORED = f"""scored AS (SELECT subject_id, prediction_time, query, censored AS boolean_value,
    coalesce(occurs, false) AS occurs, {_P} / 1000.0 AS occurs_probs, {_Q} / 1000.0 AS censor_probs,
    ({_P} - 500) / 100.0 AS occurs_logit, ({_Q} - 500) / 125.0 AS censor_logit FROM labels)"""
PREDICTIONS = "preds AS (SELECT subject_id, prediction_time, query AS code, occurs_probs FROM scored)"


def slug_sql(code: str) -> str:
    safe = f"regexp_replace({code}, '[^A-Za-z0-9._-]+', '_', 'g')"
    return (
        f"CASE WHEN substr(trim({safe}, '_'), 1, 24) = '' THEN substr(sha1({code}), 1, 10) "
        f"ELSE substr(trim({safe}, '_'), 1, 24) || '__' || substr(sha1({code}), 1, 10) END"
    )


def rank_auroc(source: str, score: str, target: str, by: str = "") -> str:
    """AUROC from average ranks, the textbook way."""
    part, group, pick = (f"PARTITION BY {by}", f"GROUP BY {by}", f"{by},") if by else ("", "", "")
    return f"""(SELECT {pick} CASE WHEN p > 0 AND n > 0 THEN (r - p * (p + 1) / 2.0) / (p * n) END AS auroc, p AS n_pos, n AS n_neg
        FROM (SELECT {pick} count(*) FILTER (WHERE {target}) AS p, count(*) FILTER (WHERE NOT {target}) AS n,
              sum(CASE WHEN {target} THEN avg_rank END) AS r
              FROM (SELECT *, rank() OVER ({part} ORDER BY {score})
                    + (count(*) OVER (PARTITION BY {pick} {score}) - 1) / 2.0 AS avg_rank
                    FROM (SELECT * FROM {source} WHERE {target} IS NOT NULL AND {score} IS NOT NULL)) {group}))"""


def log_sql(*parts: str, select: str) -> str:
    return f"WITH {', '.join(parts)} {select}"
