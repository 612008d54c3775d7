"""Scalar expressions. All of them are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
SECOND_US = 1_000_000


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def micros(ts: Column | str) -> Column:
    """Epoch microseconds of a naive timestamp (the session runs in UTC)."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def from_micros(us: Column | str) -> Column:
    return F.timestamp_micros(_col(us)).cast("timestamp_ntz")


def interval_days(days: Column | str | int) -> Column:
    return F.make_dt_interval(F.lit(days) if isinstance(days, int) else _col(days))


def cell_start(us: Column | str, width_us: int) -> Column:
    """Start of the fixed-width time cell that contains ``us``."""
    return _col(us) - F.pmod(_col(us), F.lit(width_us))


def code_slug(code: Column | str, n_hash: int = 10, prefix_len: int = 24) -> Column:
    """File-name-safe form of a code: readable prefix, two underscores, start of its SHA-1."""
    code = _col(code)
    digest = F.substring(F.sha1(F.encode(code, "UTF-8")), 1, n_hash)
    safe = F.regexp_replace(code, "[^A-Za-z0-9._-]+", "_")
    prefix = F.substring(F.trim(safe, F.lit("_")), 1, prefix_len)
    # The prefix never starts with an underscore, so leading ones mean that it is empty.
    return F.regexp_replace(F.concat(prefix, F.lit("__"), digest), "^__", "")


def draw_key(seed: int, *cols: Column | str) -> Column:
    """Pseudo-random ordering key of a row: depends only on its own values and the seed."""
    parts = [_col(c).cast("string") for c in cols]
    return F.md5(F.encode(F.concat_ws("|", *parts, F.lit(str(seed))), "UTF-8"))


def draw_number(key: Column) -> Column:
    """The first 60 bits of a hexadecimal key as a non-negative integer."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")


def sigmoid(logit: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(logit)))


def years(duration_days: Column | str) -> Column:
    return _col(duration_days) / F.lit(365.0)


def bce_with_logits(logit: Column | str, target: Column | str) -> Column:
    """Binary cross-entropy of a logit, in the form that does not overflow."""
    x, y = _col(logit), _col(target).cast("double")
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def list_fingerprint(item: Column | str, position: Column | str, length: int = 12) -> Column:
    """Aggregate: order-sensitive SHA-256 of a code list, one line per code.

    Only for code lists: the whole list has to fit one row.
    """
    rows = F.sort_array(F.collect_list(F.struct(_col(position).alias("pos"), _col(item).alias("item"))))
    lines = F.concat_ws("", F.transform(rows, lambda r: F.concat(r["item"], F.lit("\n"))))
    return F.substring(F.sha2(F.encode(lines, "UTF-8"), 256), 1, length)
