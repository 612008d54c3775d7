"""Compares a query with its SQL on the same tables, as sorted rows with rounded floats."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0
    if isinstance(v, dt.timedelta):
        return v.total_seconds()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, decimal.Decimal):
        return "decimal"
    return type(v).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [tuple(row[i] for i in order) for row in rows]


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    names = spark_df.columns
    got = rows_of(names, spark_df.collect())
    cursor = con.execute(sql)
    want_names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} != {sorted(want_names)}"
    want = rows_of(want_names, cursor.fetchall())
    kinds = [
        {c: {kind(r[i]) for r in rows} - {"null"} for i, c in enumerate(sorted(names))} for rows in (got, want)
    ]
    if got and want and kinds[0] != kinds[1]:
        return f"types differ: {[(c, kinds[0][c], kinds[1][c]) for c in kinds[0] if kinds[0][c] != kinds[1][c]]}"
    a, b = (Counter(tuple(plain(v) for v in r) for r in rows) for rows in (got, want))
    if a != b:
        return f"{len(got)} against {len(want)} rows; only here {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"
    return None
