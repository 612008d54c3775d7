"""Model input rows: labels, history up to the prediction time, the question in front."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askahead.operators.sequences import (
    event_sequences,
    history_sequences,
    insert_duration_slot,
    label_roles,
    prepend_query,
    prepend_query_event,
)
from askahead.operators.tokenlog import TokenFields, TokenLog

_KEY = ["subject_id", "prediction_time"]


# Questions of one prediction time that are carried in one row.
_QUESTIONS = 64


def _asked(labels: DataFrame, vocab: DataFrame) -> DataFrame:
    """(subject_id, prediction_time, questions): label roles, gathered by prediction time, a bounded number in a row.

    Histories are read for these rows and dealt out to the questions as the last step, so that they are neither shuffled
    nor sorted.
    """
    roles = label_roles(labels, vocab)
    in_time = Window.partitionBy(*_KEY).orderBy("query", "duration_days")
    part = F.expr(f"(_nth - 1) div {_QUESTIONS}")
    entry = F.struct(*(c for c in roles.columns if c not in _KEY))
    numbered = roles.withColumn("_nth", F.row_number().over(in_time)).withColumn("_part", part)
    return numbered.groupBy(*_KEY, "_part").agg(F.collect_list(entry).alias("questions")).drop("_part")


def _dealt(histories: DataFrame) -> DataFrame:
    """One row per question, its roles first."""
    rest = [c for c in histories.columns if c not in (*_KEY, "questions")]
    return histories.select(*_KEY, F.inline("questions"), *rest)


def model_input(
    labels: DataFrame,
    events: DataFrame | TokenLog,
    vocab: DataFrame,
    max_len: int = 256,
    derive: Callable[[DataFrame], DataFrame] | None = None,
    more: TokenFields | None = None,
) -> DataFrame:
    """One row per label row: roles, ``sequence`` with the query at position 0, and its parts as arrays.

    ``codes``, ``numeric_values`` and ``time_deltas`` (days) are those of the sequence; ``attention_mask`` has
    one more slot: position 1 stands for the duration and is always attended. Histories come from a stored token log; from
    plain events one is stored first. What follows from the history alone is computed once per prediction time, not per
    label row; ``derive`` adds columns of the caller's own to it, for which ``more`` gives tokens further fields.
    """
    histories = history_sequences(_asked(labels, vocab), events, vocab, max_len, more, ["questions"]).drop("times")
    histories = histories.withColumns(
        {
            "_codes": F.col("history")["code"],
            "_values": F.col("history")["numeric_value"],
            "_deltas": F.col("history")["time_delta_days"],
            "_mask": F.transform(F.col("history")["code"], lambda c: c != 0),
        }
    )
    histories = histories if derive is None else derive(histories)
    if more is not None:
        token = lambda t: F.struct(*(t[n].alias(n) for n in ("code", "numeric_value", "time_delta_days")))
        histories = histories.withColumn("history", F.transform("history", token))
    nan, query = F.array(F.lit(float("nan")).cast("float")), F.col("query_id").cast("int")
    return _dealt(histories).withColumns(
        {
            "sequence": prepend_query("history", "query_id"),
            "codes": F.concat(F.array(query), "_codes"),
            "numeric_values": F.concat(nan, "_values"),
            "time_deltas": F.concat(nan, "_deltas"),
            "attention_mask": insert_duration_slot(F.concat(F.array(query != 0), "_mask"), F.lit(True)),
        }
    ).drop("history", "_codes", "_values", "_deltas", "_mask")


def model_input_by_event(
    labels: DataFrame,
    events: DataFrame | TokenLog,
    vocab: DataFrame,
    max_len: int = 256,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The same rows in the nested layout: ``events`` with the query as the first event."""
    nested = event_sequences(_asked(labels, vocab), events, vocab, max_len, ["questions"])
    nested = nested if derive is None else derive(nested)
    return _dealt(nested).withColumn("events", prepend_query_event("events", "query_id"))
