"""Queries: code universes, vocabularies and code samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from askahead.catalog.base import (
    E,
    ID_CODES,
    MANUAL_CODES,
    OOD_CODES,
    ORDER_LABELS,
    PARTS,
    log_sql,
    order_labels,
    orders_log,
    part_codes,
    query,
    slug_sql,
)
from askahead.functions import code_slug, list_fingerprint
from askahead.operators import codesets
from askahead.operators.sequences import encode_codes
from askahead.sources.sinks import codes_fingerprint
from askahead.sources.tables import code_vocab, scan_events

N, SEED, REPEATS = 500, 42, 5


def _draw(source: str, n: int, seed: int) -> str:
    return (
        f"(SELECT code, pos FROM (SELECT code, (row_number() OVER (ORDER BY md5(concat_ws('|', code, {seed}))) - 1)::INTEGER AS pos "
        f"FROM {source}) WHERE pos < {n})"
    )


KEPT = "kept AS (SELECT code FROM u WHERE code NOT LIKE '%TIME%')"
TRAIN = f"train AS {_draw('kept', N, SEED)}"


def _train(spark, sf):
    return codesets.sample_codes(codesets.exclude_time_codes(part_codes(spark, sf)), N, SEED)


@query("code_universe", log_sql(PARTS, select="SELECT code FROM u"))
def _universe(spark, sf):
    return codesets.code_universe(part_codes(spark, sf))


@query("sorted_codes", log_sql(PARTS, select="SELECT code, row_number() OVER (ORDER BY code) - 1 AS row_no FROM u"))
def _sorted(spark, sf):
    return codesets.numbered(codesets.code_universe(part_codes(spark, sf)), ["code"], "row_no").orderBy("row_no")


@query("code_vocab", log_sql(PARTS, select="SELECT code, row_number() OVER (ORDER BY code)::INTEGER AS vocab_index FROM u"))
def _vocab(spark, sf):
    return code_vocab(part_codes(spark, sf))


@query("exclude_time_codes", log_sql(PARTS, KEPT, select="SELECT code FROM kept"))
def _exclude(spark, sf):
    return codesets.exclude_time_codes(part_codes(spark, sf))


@query("removed_time_codes", log_sql(PARTS, select="SELECT code FROM u WHERE contains(code, 'TIME')"))
def _removed(spark, sf):
    return codesets.removed_time_codes(part_codes(spark, sf))


@query(
    "code_counts",
    log_sql(PARTS, select="SELECT count(*) AS n_codes, count(*) FILTER (WHERE contains(code, 'TIME')) AS n_time_codes, "
            "count(*) FILTER (WHERE NOT contains(code, 'TIME')) AS n_kept FROM u"),
)
def _counts(spark, sf):
    return codesets.code_counts(part_codes(spark, sf))


@query(
    "code_list",
    log_sql(E, "spec(code, bucket, pos) AS (VALUES ('1-URGENT', 'id', 0), ('2-HIGH', 'id', 1), ('1-URGENT', 'id', 2), "
            "('5-LOW', 'ood', 3))",
            select="SELECT spec.code, bucket, pos, count(*) AS n_events FROM spec JOIN e USING (code) GROUP BY ALL"),
)
def _code_list(spark, sf):
    spec = codesets.code_list(spark, {"id": ["1-URGENT", "2-HIGH", "1-URGENT"], "ood": ["5-LOW"]})
    seen = scan_events(orders_log(spark, sf)).groupBy("code").agg(F.count("*").alias("n_events"))
    return spec.join(seen, "code")


@query("sample_codes", log_sql(PARTS, KEPT, TRAIN, select="SELECT * FROM train"))
def _sample(spark, sf):
    return _train(spark, sf)


@query(
    "sample_codes_repeated",
    log_sql(PARTS, KEPT, select=f"""SELECT * FROM (SELECT draw::INTEGER AS draw, code, (row_number() OVER (PARTITION BY draw
        ORDER BY md5(concat_ws('|', code, draw, {SEED}))) - 1)::INTEGER AS pos FROM kept CROSS JOIN range({REPEATS}) t(draw))
        WHERE pos < {N}"""),
)
def _repeated(spark, sf):
    return codesets.sample_codes_repeated(codesets.exclude_time_codes(part_codes(spark, sf)), N, REPEATS, SEED)


@query("ood_complement", log_sql(PARTS, KEPT, TRAIN, select="SELECT code FROM kept EXCEPT SELECT code FROM train"))
def _complement(spark, sf):
    return codesets.ood_complement(codesets.exclude_time_codes(part_codes(spark, sf)), _train(spark, sf))


@query(
    "eval_code_sets",
    log_sql(PARTS, KEPT, TRAIN, "rest AS (SELECT code FROM u EXCEPT SELECT code FROM train)",
            select=f"SELECT code, pos, 'id' AS bucket FROM {_draw('train', 200, 7)} UNION ALL "
            f"SELECT code, pos, 'ood' FROM {_draw('rest', 50, 7)}"),
)
def _eval_sets(spark, sf):
    return codesets.eval_code_sets(part_codes(spark, sf), _train(spark, sf), 200, 50, 7)


@query(
    "list_fingerprint",
    log_sql(PARTS, KEPT, TRAIN,
            select="SELECT substr(sha256(string_agg(code || chr(10), '' ORDER BY pos)), 1, 12) AS fingerprint FROM train"),
)
def _fingerprint(spark, sf):
    return _train(spark, sf).agg(list_fingerprint("code", "pos").alias("fingerprint"))


@query(
    "config_fingerprint",
    log_sql(PARTS, KEPT, TRAIN, select="SELECT md5(string_agg(code, '|' ORDER BY code) || '_30|31|32') AS fingerprint FROM train"),
)
def _config(spark, sf):
    return codes_fingerprint(_train(spark, sf), [32, 30, 31])


@query("code_slug", log_sql(PARTS, select=f"SELECT code, {slug_sql('code')} AS code_slug FROM u"))
def _slug(spark, sf):
    return codesets.code_universe(part_codes(spark, sf)).withColumn("code_slug", code_slug("code"))


def _values(name: str, codes: list[str]) -> str:
    return f"{name}(code, pos) AS (VALUES {', '.join(f'({c!r}, {i})' for i, c in enumerate(codes))})"


_LISTS = [_values("idc", ID_CODES), _values("oodc", OOD_CODES), _values("manc", MANUAL_CODES + OOD_CODES)]


@query(
    "concat_code_lists",
    log_sql(E, *_LISTS, select="""SELECT l.code, pos, list_no, CASE WHEN l.code IN (SELECT code FROM oodc) THEN 'ood' ELSE 'id' END AS bucket,
        n_events FROM (SELECT code, pos, 0 AS list_no FROM idc UNION ALL SELECT code, pos, 1 FROM oodc UNION ALL
        SELECT code, pos, 2 FROM manc) l JOIN (SELECT code, count(*) AS n_events FROM e GROUP BY code) n USING (code)"""),
)
def _concat(spark, sf):
    lists = [codesets.code_list(spark, c) for c in (ID_CODES, OOD_CODES, MANUAL_CODES + OOD_CODES)]
    seen = scan_events(orders_log(spark, sf)).groupBy("code").agg(F.count("*").alias("n_events"))
    return codesets.concat_code_lists(*lists).join(seen, "code")


@query(
    "available_codes",
    log_sql(E, _values("want", ID_CODES + ["NO SUCH CODE"]), select="SELECT code, pos, code IN (SELECT code FROM e) AS available FROM want"),
)
def _available(spark, sf):
    wanted = codesets.code_list(spark, [*ID_CODES, "NO SUCH CODE"]).drop("bucket")
    return codesets.available_codes(wanted, orders_log(spark, sf), "code")


@query(
    "encode_query",
    log_sql(ORDER_LABELS, "vocab AS (SELECT code, row_number() OVER (ORDER BY code)::INTEGER AS id FROM codes WHERE code <> '5-LOW')",
            select="SELECT subject_id, prediction_time, query, coalesce(id, 0) AS query_id FROM labels LEFT JOIN vocab ON code = query"),
)
def _encode(spark, sf):
    vocab = code_vocab(orders_log(spark, sf).where(F.col("code") != "5-LOW"))
    rows = order_labels(spark, sf).select("subject_id", "prediction_time", "query")
    return encode_codes(rows, vocab, "query", "query_id")
