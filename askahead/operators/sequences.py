"""History sequences: the last tokens up to a prediction time, with the question in front.

Tokens are read from a stored log, where they are numbered along their subject's timeline (see ``tokenlog``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askahead.functions import draw_key, draw_number, micros, years
from askahead.functions.columns import from_micros
from askahead.operators import tokenlog
from askahead.operators.skew import join_to_unique
from askahead.operators.timeline import Running, history_bound, running
from askahead.operators.tokenlog import TokenFields, TokenLog
from askahead.schemas import PAD_INDEX
from askahead.session import checkpointed

_TIME_KEY = ["subject_id", "prediction_time"]
OPTIONAL_LABELS = ["boolean_value", "occurs", "query", "duration_days"]


def encode_codes(rows: DataFrame, vocab: DataFrame, on: str = "code", to: str = "code_id") -> DataFrame:
    """Vocabulary index of each code; a code outside the vocabulary becomes the padding index.

    A vocabulary too large to broadcast is joined by code; adaptive execution splits the partitions of frequent codes.
    """
    return tokenlog.encode(rows, vocab, None, on, to)


def label_history_join(labels: DataFrame, events: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Labels of subjects that have a history; the others drop out. ``heavy`` subjects are those of the label table."""
    subjects = events.select("subject_id").distinct()
    return join_to_unique(labels, subjects, ["subject_id"], heavy, F.xxhash64(*labels.columns), "left_semi")


def passthrough_columns(labels: DataFrame) -> list[str]:
    return [c for c in OPTIONAL_LABELS if c in labels.columns]


def history_bounds(labels: DataFrame, events: DataFrame) -> DataFrame:
    """Each label row with ``end_event_index`` and whichever optional label columns are there."""
    bounds = history_bound(labels, events, ["subject_id"], "prediction_time")
    return labels.join(bounds, _TIME_KEY).select(*_TIME_KEY, "end_event_index", *passthrough_columns(labels))


def history_blocks(events: DataFrame, size: int = 256) -> DataFrame:
    """The event times of each subject as arrays of at most ``size``, in time order."""
    times = events.where(F.col("time").isNotNull()).select("subject_id", "time").distinct()
    placed = running(times, ["subject_id"], "time", [Running("_nth", F.lit(1))])
    return (
        placed.withColumn("block", F.expr(f"(_nth - 1) div {size}"))
        .groupBy("subject_id", "block")
        .agg(F.sort_array(F.collect_list("time")).alias("times"))
    )


def explode_times(rows: DataFrame, times: str = "times") -> DataFrame:
    """One row per list element; a missing or empty list gives one row without a time."""
    return rows.withColumn("time", F.explode_outer(times)).drop(times)


def history_sequences(
    probes: DataFrame,
    events: DataFrame | TokenLog,
    vocab: DataFrame | None = None,
    max_len: int = 256,
    more: TokenFields | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Last ``max_len`` tokens up to each distinct (subject, prediction time), oldest first.

    ``history`` holds structs (code, numeric_value, time_delta_days). The first token of an event carries
    the days since the subject's previous event (0 at the first one), its other tokens carry 0. Prediction
    times of subjects without history drop out; one before the first event gets an empty array.

    Pass a stored log where there is one; from plain events and a vocabulary a log is stored first. ``more`` gives the
    structs further fields, made once per stored token. With ``keep`` there is a row per row of ``probes``, with these
    columns of it.
    """
    log = events if isinstance(events, TokenLog) else tokenlog.build(events, vocab, max_len)
    found = log.histories(probes, max_len, more, keep)
    names = [n for n in found.schema["tokens"].dataType.elementType.names if n != "us"]
    token = F.transform("tokens", lambda t: F.struct(*(t[n].alias(n) for n in names)))
    times = F.transform("tokens", lambda t: from_micros(t["us"]))
    return found.select(*_TIME_KEY, *(keep or []), token.alias("history"), times.alias("times"))


def event_sequences(
    probes: DataFrame,
    events: DataFrame | TokenLog,
    vocab: DataFrame | None = None,
    max_len: int = 256,
    keep: list[str] | None = None,
) -> DataFrame:
    """The same tokens in the nested layout: ``events`` has an entry (time_delta_days, codes, numeric_values) per
    event time, oldest first."""
    log = events if isinstance(events, TokenLog) else tokenlog.build(events, vocab, max_len)

    def event(start: Column, nth: Column) -> Column:
        # Up to where the next event starts.
        stop = F.coalesce(F.get("starts", nth + 1), F.size("tokens") + 1)
        return F.slice("tokens", start, stop - start)

    def entry(own: Column) -> Column:
        return F.struct(
            own[0]["time_delta_days"].alias("time_delta_days"),
            own["code"].alias("codes"),
            own["numeric_value"].alias("numeric_values"),
        )

    us = F.col("tokens")["us"]
    first = F.transform(us, lambda t, i: F.when((i == 0) | (t != F.get(us, i - 1)), i + 1))
    rows = log.histories(probes, max_len, keep=keep).withColumn("starts", F.filter(first, lambda i: i.isNotNull()))
    return rows.select(*_TIME_KEY, *(keep or []), F.transform(F.transform("starts", event), entry).alias("events"))


def prepend_query_event(events: Column | str, query_id: Column | str) -> Column:
    """The encoded query as an event of its own before the others, without value and time."""
    events = F.col(events) if isinstance(events, str) else events
    query_id = F.col(query_id) if isinstance(query_id, str) else query_id
    nan = F.lit(float("nan")).cast("float")
    first = F.struct(
        nan.alias("time_delta_days"), F.array(query_id.cast("int")).alias("codes"), F.array(nan).alias("numeric_values")
    )
    return F.concat(F.array(first), events)


def prepend_query(history: Column | str, query_id: Column | str) -> Column:
    """The encoded query as token 0, without value and time; the history follows unchanged."""
    history = F.col(history) if isinstance(history, str) else history
    query_id = F.col(query_id) if isinstance(query_id, str) else query_id
    nan = F.lit(float("nan")).cast("float")
    first = F.struct(query_id.cast("int").alias("code"), nan.alias("numeric_value"), nan.alias("time_delta_days"))
    return F.concat(F.array(first), history)


def flatten_events(nested: Column | str) -> Column:
    """Flat code list of a nested sequence."""
    return F.flatten(F.transform(nested, lambda e: e["codes"]))


def assign_batches(rows: DataFrame, keys: list[str], length: str, batch_size: int, seed: int = 0) -> DataFrame:
    """Batches of ``batch_size`` rows of like length: rows in the order of (length, seeded draw), cut in turn.

    No task orders all rows: rows are counted per length and share of the draw, sums over these counts give each cell the
    number of its first row, and only the rows of one cell are ordered. There are so many shares that a cell holds about
    one batch. Lengths are few: no more than the longest sequence allows.
    """
    parts = [micros(k) if rows.schema[k].dataType.typeName().startswith("timestamp") else F.col(k) for k in keys]
    keyed = rows.withColumn("_key", draw_key(seed, *parts)).withColumn("_length", F.col(length))
    lengths = checkpointed(keyed.groupBy("_length").agg(F.count("*").alias("_n")))
    shares = F.greatest(F.ceil(F.col("_n") / batch_size), F.lit(1)).cast("bigint")
    shared = lengths.select("_length", shares.alias("_shares"))
    # The draw is uniform below 2 ** 60: its share keeps the order of the draw.
    at = F.least(F.floor(draw_number(F.col("_key")) / F.lit(float(1 << 60)) * F.col("_shares")), F.col("_shares") - 1)
    placed = keyed.join(shared, "_length").withColumn("_share", at.cast("bigint")).drop("_shares")
    cells = checkpointed(placed.groupBy("_length", "_share").agg(F.count("*").alias("_n")))
    # Lengths are few; the cells of one length are summed by themselves.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = lengths.select("_length", before.alias("_start"))
    within = Window.partitionBy("_length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("_length", "_share", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_before"))
    offsets = offsets.join(starts, "_length").select("_length", "_share", (F.col("_start") + F.col("_before")).alias("_offset"))
    nth = F.row_number().over(Window.partitionBy("_length", "_share").orderBy("_key", *keys))
    numbered = placed.withColumn("_nth", nth).join(offsets, ["_length", "_share"])
    batched = numbered.withColumn("batch", F.expr(f"(_offset + _nth - 1) div {batch_size}"))
    return batched.drop("_key", "_length", "_share", "_nth", "_offset")


def pad_and_mask(rows: DataFrame, codes: str, batch: list[str]) -> DataFrame:
    """Pad code arrays to the longest of their batch; ``attention_mask`` is false on padding."""
    longest = F.max(F.size(codes)).over(Window.partitionBy(*batch))
    fill = F.array_repeat(F.lit(PAD_INDEX), F.col("_longest") - F.size(codes))
    padded = rows.withColumn("_longest", longest).withColumn(codes, F.concat(F.col(codes), fill)).drop("_longest")
    return padded.withColumn("attention_mask", F.transform(codes, lambda c: c != PAD_INDEX))


def padding_share(padded: DataFrame, codes: str = "codes") -> DataFrame:
    """Share of all slots that are padding, as a one-row table."""
    slots = F.sum(F.size(codes))
    filled = F.sum(F.size(F.filter("attention_mask", lambda m: m)))
    return padded.agg(slots.alias("n_slots"), (F.lit(1.0) - filled / slots).alias("padding_share"))


def insert_duration_slot(values: Column | str, slot: Column) -> Column:
    """One more element at position 1, directly after the query."""
    values = F.col(values) if isinstance(values, str) else values
    return F.concat(F.slice(values, 1, 1), F.array(slot), F.slice(values, 2, F.greatest(F.size(values), F.lit(1))))


def label_roles(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Batch fields from label columns: censor, occurs as 0/1, query id, duration as float."""
    coded = encode_codes(rows, vocab, "query", "query_id")
    return coded.select(
        *_TIME_KEY,
        F.col("boolean_value").alias("censor"),
        F.col("occurs").cast("int").alias("occurs"),
        F.col("query"),
        "query_id",
        F.col("duration_days").cast("float").alias("duration_days"),
        years(F.col("duration_days").cast("float")).cast("float").alias("duration_years"),
    )
