"""Equality joins to a table with one row per key, where one key may own much of the left side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askahead.session import checkpointed

# Left rows of one key that a single task should handle.
ROWS_PER_TASK = 2_000_000
# Keys that a sketch follows. One that it misses owns less than about 1 / 12,000 of all rows, less than a task's share.
_TRACKED = 1 << 14


def heavy_keys(rows: DataFrame, keys: list[str], limit: int = ROWS_PER_TASK) -> DataFrame | None:
    """Keys with more than ``limit`` rows, as (_key, n_rows) with the hash of the key; None where there is none.

    One pass: each task keeps a sketch of its most frequent keys, and the sketches are merged. The table is stored and has
    at most ``_TRACKED`` rows, so it is small enough to broadcast, and plans that use it do not repeat what it was counted
    from. Take it from the source log and use it for every join on those keys.
    """
    top = rows.select(F.expr(f"approx_top_k(xxhash64({', '.join(f'`{k}`' for k in keys)}), {_TRACKED // 2}, {_TRACKED})").alias("top"))
    found = top.select(F.inline("top")).toDF("_key", "n_rows").where(F.col("n_rows") > limit)
    found = checkpointed(found)
    return None if found.isEmpty() else found


def large_keys(rows: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Exactly the keys with more than ``limit`` rows, stored; None where there is none.

    Rows are counted in each task before the counts are shuffled. The table can be long where the limit is small, so it is
    not for broadcasting.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > limit)
    found = checkpointed(counts.select(*keys))
    return None if found.isEmpty() else found


def join_to_unique(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    heavy: DataFrame | None,
    spread: Column,
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join ``left`` to ``right`` (unique on ``keys``), splitting keys that own many left rows.

    ``heavy`` comes from ``heavy_keys``. Its keys get a salt per ``rows_per_task`` rows: their right row is copied once per
    salt, and ``spread`` deals their left rows over the salts. Without heavy keys this is a plain join.
    """
    if heavy is None:
        return left.join(right, keys, how)
    salts = heavy.select("_key", F.greatest(F.ceil(F.col("n_rows") / rows_per_task), F.lit(1)).cast("int").alias("_salts"))

    def salted(rows: DataFrame) -> DataFrame:
        # At most _TRACKED rows are broadcast.
        keyed = rows.withColumn("_key", F.xxhash64(*keys)).join(F.broadcast(salts), "_key", "left").drop("_key")
        return keyed.withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    dealt = salted(left).withColumn("_salt", F.pmod(F.xxhash64(spread), "_salts").cast("int"))
    copied = salted(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return dealt.drop("_salts").join(copied.drop("_salts"), [*keys, "_salt"], how).drop("_salt")
