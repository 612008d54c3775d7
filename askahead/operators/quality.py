"""Data checks. Each returns a table of counts or violations; ``require_zero`` turns one into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askahead.schemas import PAD_INDEX


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def null_flags(columns: list[str]) -> dict[str, Column]:
    """Conditions that hold where a column is null, to be counted while a table is written."""
    return {c: F.col(c).isNull() for c in columns}


def unlabelled() -> Column:
    """Holds for an uncensored row without a label."""
    return ~F.col("censored") & F.col("occurs").isNull()


def null_labels(labels: DataFrame) -> DataFrame:
    """Number of uncensored rows without a label (has to be 0)."""
    return labels.agg(F.count_if(unlabelled()).alias("n_null_labels"))


def require_zero(counts: DataFrame, message: str) -> DataFrame:
    """Pass a one-row table of counts through, failing when any of them is not zero."""
    total = sum((F.col(c) for c in counts.columns[1:]), F.col(counts.columns[0]))
    return counts.where(F.when(total != 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def validate_sequences(sequences: DataFrame, vocab_size: int, max_len: int, has_duration: bool = True) -> DataFrame:
    """Rows that break an input rule, with one flag per rule. ``codes`` is the array of code ids."""
    length = F.size("codes")
    flags = {
        "too_long": length + (1 if has_duration else 0) > max_len,
        "too_short": length <= 1,
        "out_of_vocabulary": F.exists("codes", lambda c: c >= vocab_size),
        "all_padding": F.forall("codes", lambda c: c == PAD_INDEX),
        "not_finite": F.exists("codes", lambda c: c.isNull() | F.isnan(c.cast("double"))),
    }
    flagged = sequences.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    anything = F.greatest(*[F.col(k) for k in flags])
    return flagged.where(anything)


def validate_annotations(rows: DataFrame, key: list[str], annotations: list[str]) -> DataFrame:
    """Samples that do not have exactly one value per annotation."""
    counted = rows.groupBy(*key).agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col(a).isNull()).alias(f"null_{a}") for a in annotations]
    )
    bad = F.col("n_rows") != 1
    for a in annotations:
        bad = bad | (F.col(f"null_{a}") > 0)
    return counted.where(bad)


def finite_outputs(rows: DataFrame, vector: str, scalars: list[str]) -> DataFrame:
    """Counts of NaN and infinite values in a vector column and in scalar outputs."""
    inf = F.lit(float("inf"))
    out = [
        F.sum(F.size(F.filter(vector, lambda x: F.isnan(x)))).alias(f"{vector}_nan"),
        F.sum(F.size(F.filter(vector, lambda x: F.abs(x) == inf))).alias(f"{vector}_inf"),
        F.sum(F.size(vector)).alias(f"{vector}_values"),
    ]
    for s in scalars:
        out.append(F.count_if(F.isnan(s)).alias(f"{s}_nan"))
        out.append(F.count_if(F.abs(F.col(s)) == inf).alias(f"{s}_inf"))
    return rows.agg(*out)
