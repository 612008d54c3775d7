"""Does a code occur in an open interval? Answered from a min/max map instead of a range join.

The zone map holds the first and last event time of a code per subject and time zone of fixed width.
An event lies strictly inside ``(t, t + d)`` exactly when some zone that overlaps the interval has
``last > t`` and ``first < t + d``, provided a zone is no wider than ``d``: the zone of ``t`` then ends
before ``t + d``, a later zone starts after ``t``, and the zones in between lie inside. So every label
needs only equality joins on (subject, zone); the number of events behind a zone does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askahead.functions import cell_start, from_micros, interval_days, micros
from askahead.functions.columns import DAY_US
from askahead.operators.codesets import CodeSet, codes_array, codes_or_all, only_codes
from askahead.operators.context import context_start, record_end
from askahead.operators.skew import large_keys
from askahead.session import checkpointed

# Rows of one subject that are ordered in one task; subjects with more are answered from the zone map.
LIGHT_ROWS = 10_000
# Cells (rows, and their questions per code and duration) that one task orders; a larger log gets more tasks.
CELLS_PER_TASK = 400_000
# Rows of one subject whose pairs with its prediction times are compared one by one.
FEW_ROWS = 1_000


def zone_map(events: DataFrame, width_days: int) -> DataFrame:
    """First and last time of each code per subject and zone; combined before the shuffle."""
    # Never null, so that joins on it add no filter below the shuffle.
    zone = F.coalesce(cell_start("_us", width_days * DAY_US), F.lit(0).cast("bigint"))
    return (
        events.where(F.col("time").isNotNull())
        .withColumn("_us", micros("time"))
        .withColumn("zone", zone)
        .groupBy("subject_id", "code", "zone")
        .agg(F.min("_us").alias("first_us"), F.max("_us").alias("last_us"), F.count("*").alias("n_rows"))
    )


def _outlooks(events: DataFrame, spots: DataFrame, width_days: int, horizon_days: int) -> DataFrame:
    """What can be seen from each spot (subject, zone), as one row with ``outlook``.

    It has an entry per code: the last time inside the zone, and the first time in the zones after it, at least
    as far as the horizon. Zones are gathered in cells as long as the horizon, and each zone is sent to its own
    cell and to the one before, so what is shuffled is the zone map twice, whatever the durations. Within a cell
    no more than (its zones x codes) rows meet, however many events lie behind them.
    """
    cell_us = -(-horizon_days // width_days) * width_days * DAY_US
    cell = cell_start("zone", cell_us)
    key = ["subject_id", "_cell"]
    near = (
        zone_map(events, width_days)
        .where(F.col("code").isNotNull())
        .withColumn("_cell", F.explode(F.array(cell, cell - F.lit(cell_us))))
        .select(*key, "code", "zone", "first_us", "last_us", F.lit(False).alias("_asked"))
        .repartition(*key)
    )
    places = spots.select("subject_id", "zone").distinct().withColumn("_cell", cell).repartition(*key)
    none = F.lit(None).cast("bigint")
    asked = places.join(near.select(*key, "code").distinct(), key).select(
        *key, "code", "zone", none.alias("first_us"), none.alias("last_us"), F.lit(True).alias("_asked")
    )
    # Growing frames only: looking ahead runs through the zones backwards.
    later = Window.partitionBy(*key, "code").orderBy(-F.col("zone")).rangeBetween(Window.unboundedPreceding, -1)
    seen = (
        near.unionByName(asked)
        .groupBy(*key, "code", "zone")
        .agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.bool_or("_asked").alias("_asked"))
        .withColumn("next_us", F.min("first_us").over(later))
        .where(F.col("_asked") & (F.col("last_us").isNotNull() | F.col("next_us").isNotNull()))
    )
    return seen.groupBy(*key, "zone").agg(F.collect_list(F.struct("code", "last_us", "next_us")).alias("outlook")).drop("_cell")


def _check(durations: list[int]) -> tuple[int, int]:
    if not durations or min(durations) < 1:
        raise ValueError("durations must be whole days, at least 1")
    return min(durations), max(durations)


def _sparse(rows: DataFrame, entries: str = "outlook") -> DataFrame:
    """One row per entry of the outlook."""
    reach = F.when(F.col("last_us") > F.col("at_us"), F.col("at_us")).otherwise(F.col("next_us"))
    return (
        rows.select("*", F.inline(entries))
        .withColumn("reach_us", reach)
        .withColumnRenamed("code", "query")
        .drop(entries, "last_us", "next_us")
    )


def _grid(rows: DataFrame, codes: CodeSet) -> DataFrame:
    """One row per code: ``outlook`` entries, and an empty entry for each code it does not have.

    Made by a generator after the join, so what is shuffled is the prediction times, not the grid.
    """
    entry = rows.schema["outlook"].dataType
    known = F.coalesce(F.col("outlook"), F.array().cast(entry))
    never = F.lit(None).cast("bigint")
    absent = F.transform(
        F.array_except(F.col("_codes"), known["code"]),
        lambda c: F.struct(c.alias("code"), never.alias("last_us"), never.alias("next_us")),
    )
    filled = rows.withColumn("_codes", codes_array(codes)).withColumn("_cells", F.concat(known, absent))
    return _sparse(filled.drop("outlook", "_codes"), "_cells")


def with_reach(
    candidates: DataFrame,
    events: DataFrame,
    codes: CodeSet | None,
    durations: list[int],
    dense: bool = True,
) -> DataFrame:
    """Any prediction times × codes with ``reach_us``: the code occurs within d exactly when reach < t + d.

    Valid for every d in ``durations``. Without ``codes``, all codes of the log are asked about; a code list
    reaches the scan of the events. Unless ``dense``, codes that surely do not occur have no row. Where one zone owns much
    of the candidates, adaptive execution splits the join.
    """
    width, horizon = _check(durations)
    placed = candidates.withColumn("at_us", micros("prediction_time")).withColumn(
        "zone", cell_start("at_us", width * DAY_US)
    )
    wanted = events if codes is None else only_codes(events, codes)
    profiles = _outlooks(wanted, placed, width, horizon)
    key, how = ["subject_id", "zone"], "left" if dense else "inner"
    joined = placed.join(profiles, key, how).drop("zone")
    return _grid(joined, codes_or_all(codes, events)) if dense else _sparse(joined)


def tasks_for(spark: SparkSession, cells: int) -> int:
    """How many tasks share this many cells. A given number is not coalesced by bytes, which say little about cells."""
    return max(spark.sparkContext.defaultParallelism, -(-cells // CELLS_PER_TASK))


def _grid_cells(timed: DataFrame, codes: CodeSet | None, n_durations: int) -> int:
    """About how many cells the log's grid has: three numbers for the driver, which only size tasks."""
    n_rows, n_codes = timed.agg(F.count("*"), F.approx_count_distinct("code")).first()
    if isinstance(codes, list):
        n_codes = len(set(codes))
    elif codes is not None:
        n_codes = codes.agg(F.approx_count_distinct("code")).first()[0]
    return n_rows * (1 + n_codes * n_durations)


def _ordered_reach(
    timed: DataFrame,
    codes: CodeSet | None,
    all_codes: CodeSet,
    min_context: int,
    earlier: DataFrame | None,
    n_tasks: int,
) -> DataFrame:
    """Eligible times × codes with ``reach_us`` and ``record_end_us``, by ordering each subject's rows.

    One shuffle by subject serves everything: distinct rows, the running count, the record's end, and the next time of
    every code, found backwards over the subject's events and its questions together.
    """
    # Never null, so that all windows start from the one shuffle.
    rows = timed.select("subject_id", micros("time").alias("at_us"), "code")
    if earlier is None:
        rows, missing = rows.repartition(n_tasks, "subject_id").distinct(), F.lit(min_context)
    else:
        rows = rows.join(earlier.select("subject_id", "n_earlier"), "subject_id", "left")
        rows = rows.repartition(n_tasks, "subject_id").distinct()
        missing = F.greatest(min_context - F.coalesce("n_earlier", F.lit(0)), F.lit(1))
    subject = Window.partitionBy("subject_id")
    in_order = subject.orderBy("at_us", "code")
    counted = rows.withColumns(
        {
            "_nth": F.row_number().over(in_order),
            "_before": F.lag("at_us").over(in_order),
            "record_end_us": F.max("at_us").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    # The count reaches the context within this time or before it, once all rows of the time are counted.
    at_context = F.max(F.when(F.col("_nth") == missing, F.col("at_us"))).over(
        in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    counted = counted.withColumn("_start", at_context if min_context > 0 else F.lit(-(1 << 63)))
    asks = F.col("_before").isNull() | (F.col("_before") < F.col("at_us"))
    asks = asks & (F.col("at_us") >= F.col("_start"))
    wanted = F.col("code").isNotNull()
    if codes is not None:
        wanted = wanted & F.array_contains("_codes", F.col("code"))
    event = F.when(wanted, F.array(F.struct(F.col("code").alias("query"), F.lit(False).alias("_asked"))))
    none = F.array().cast("array<struct<query:string,_asked:boolean>>")
    questions = F.transform("_codes", lambda c: F.struct(c.alias("query"), F.lit(True).alias("_asked")))
    entries = F.concat(F.coalesce(event, none), F.when(asks, questions).otherwise(none))
    cells = counted.withColumn("_codes", codes_array(all_codes)).select("subject_id", "at_us", "record_end_us", F.inline(entries))
    # Growing frames only: looking ahead runs backwards through time.
    later = Window.partitionBy("subject_id", "query").orderBy(-F.col("at_us")).rangeBetween(Window.unboundedPreceding, -1)
    reach = F.min(F.when(~F.col("_asked"), F.col("at_us"))).over(later)
    return cells.withColumn("reach_us", reach).where("_asked").drop("_asked")


def eligible_with_reach(
    events: DataFrame,
    codes: CodeSet | None,
    durations: list[int],
    min_context: int,
    light_rows: int = LIGHT_ROWS,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """All eligible prediction times of the log × codes, with ``reach_us`` and ``record_end_us``.

    Subjects with at most ``light_rows`` rows are ordered, each in one task. The others, if there are any, are answered
    from the zone map, whatever their number of rows. ``earlier`` has the number ``n_earlier`` of event rows that came
    before those of the log, which count as context.
    """
    _check(durations)
    timed = events.where(F.col("time").isNotNull() & F.col("subject_id").isNotNull())
    all_codes = codes_or_all(codes, events)
    large = large_keys(timed, ["subject_id"], light_rows)
    n_tasks = tasks_for(timed.sparkSession, _grid_cells(timed, codes, len(durations)))
    if large is None:
        reach = _ordered_reach(timed, codes, all_codes, min_context, earlier, n_tasks)
    else:
        light = _ordered_reach(timed.join(large, "subject_id", "left_anti"), codes, all_codes, min_context, earlier, n_tasks)
        heavy = _zoned_reach(timed.join(large, "subject_id", "left_semi"), codes, all_codes, durations, min_context, earlier)
        reach = light.unionByName(heavy.select(*light.columns))
    return reach.withColumn("prediction_time", from_micros("at_us"))


def _zoned_reach(
    timed: DataFrame,
    codes: CodeSet | None,
    all_codes: CodeSet,
    durations: list[int],
    min_context: int,
    earlier: DataFrame | None,
) -> DataFrame:
    """The same from the zone map, without one task per subject.

    Context start and record end are attached to the zones, which are few per subject, so the event times
    are joined only once, on (subject, zone).
    """
    width, horizon = _check(durations)
    width_us = width * DAY_US
    zone = cell_start("at_us", width_us)
    times = timed.select("subject_id", micros("time").alias("at_us")).distinct().withColumn("zone", zone)
    bounds = record_end(timed).select("subject_id", micros("record_end_time").alias("record_end_us"))
    if min_context > 0:
        start = context_start(timed, min_context, earlier).select("subject_id", micros("context_start").alias("start_us"))
        bounds = bounds.join(start, "subject_id")
    else:
        bounds = bounds.withColumn("start_us", F.lit(None).cast("bigint"))
    # A subject has at most as many zones as the calendar, so this join has no large key.
    spots = times.select("subject_id", "zone").distinct().join(bounds, "subject_id").where(
        F.col("start_us").isNull() | (F.col("start_us") < F.col("zone") + F.lit(width_us))
    )
    wanted = timed if codes is None else only_codes(timed, codes)
    outlooks = _outlooks(wanted, spots, width, horizon)
    # Stored, so that adaptive execution can split the join where one zone owns much of the times.
    profiles = checkpointed(spots.join(outlooks, ["subject_id", "zone"], "left"))
    joined = times.join(profiles, ["subject_id", "zone"])
    eligible = joined.where(F.col("start_us").isNull() | (F.col("at_us") >= F.col("start_us"))).drop("zone", "start_us")
    return _grid(eligible, all_codes)


def occurs_within(duration: Column | int) -> Column:
    """Label of a row with ``reach_us`` for one duration."""
    duration = F.lit(duration) if isinstance(duration, int) else duration
    end_us = F.col("at_us") + duration.cast("bigint") * F.lit(DAY_US)
    return F.coalesce(F.col("reach_us") < end_us, F.lit(False))


def occurrences(
    candidates: DataFrame, events: DataFrame, duration_days: int, codes: CodeSet | None, few_rows: int = FEW_ROWS
) -> DataFrame:
    """The (candidate, code) pairs for which the code occurs: the matches of the interval join.

    Subjects with at most ``few_rows`` rows are joined by the interval itself, which compares few pairs and combines equal
    matches before they are shuffled. Others are answered from the zone map, whatever their number of rows.
    """
    large = large_keys(events, ["subject_id"], few_rows)
    light = events if large is None else events.join(large, "subject_id", "left_anti")
    wanted = light.where(F.col("code").isNotNull() & F.col("time").isNotNull())
    wanted = wanted if codes is None else only_codes(wanted, codes)
    inside = (F.col("time") > F.col("prediction_time")) & (F.col("time") < F.col("prediction_time") + interval_days(duration_days))
    near = candidates.join(wanted.select("subject_id", "time", F.col("code").alias("query")), "subject_id").where(inside)
    found = near.select(*candidates.columns, "query").distinct()
    if large is None:
        return found
    heavy = with_reach(
        candidates.join(large, "subject_id", "left_semi"),
        events.join(large, "subject_id", "left_semi"),
        codes,
        [duration_days],
        dense=False,
    )
    return found.unionByName(heavy.where(occurs_within(duration_days)).select(*candidates.columns, "query"))


def label_questions(questions: DataFrame, events: DataFrame, width_days: int, light_rows: int = LIGHT_ROWS) -> DataFrame:
    """Add ``occurs`` to sparse rows that each ask about one code and duration.

    ``questions`` needs distinct (subject_id, prediction_time, query, duration_days) rows with durations of at
    least ``width_days``. Subjects with at most ``light_rows`` events are ordered, so each question and each event is
    shuffled once. Questions about others visit the few zones they overlap, whatever the number of events.
    """
    too_short = F.raise_error(F.lit("duration shorter than the zone width")).cast("bigint")
    end = F.col("_at_us") + F.col("duration_days").cast("bigint") * F.lit(DAY_US)
    asked = questions.withColumn("_at_us", micros("prediction_time")).withColumn(
        "_end_us", F.when(F.col("duration_days") < width_days, too_short).otherwise(end)
    )
    timed = events.where(F.col("time").isNotNull() & F.col("subject_id").isNotNull() & F.col("code").isNotNull())
    large = large_keys(timed, ["subject_id"], light_rows)
    if large is None:
        found = _ordered_questions(asked, timed)
    else:
        rest = [rows.join(large, "subject_id", "left_anti") for rows in (asked, timed)]
        many = [rows.join(large, "subject_id", "left_semi") for rows in (asked, timed)]
        found = _ordered_questions(*rest).unionByName(_zoned_questions(*many, width_days))
    return found.select(*questions.columns, "occurs")


def _ordered_questions(asked: DataFrame, timed: DataFrame) -> DataFrame:
    """Questions answered by the next time of their code, found backwards over events and questions together."""
    none = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in asked.columns if c not in ("subject_id", "query", "_at_us")]
    seen = timed.select("subject_id", F.col("code").alias("query"), micros("time").alias("_at_us"), *none, F.lit(False).alias("_asked"))
    key = ["subject_id", "query"]
    # Sized by the events alone, as counting the questions would draw them twice.
    n_tasks = tasks_for(timed.sparkSession, 2 * timed.count())
    rows = seen.unionByName(asked.withColumn("_asked", F.lit(True))).repartition(n_tasks, *key)
    # Growing frames only: looking ahead runs backwards through time.
    later = Window.partitionBy(*key).orderBy(-F.col("_at_us")).rangeBetween(Window.unboundedPreceding, -1)
    next_us = F.min(F.when(~F.col("_asked"), F.col("_at_us"))).over(later)
    return (
        rows.withColumn("_next_us", next_us)
        .where("_asked")
        .withColumn("occurs", F.coalesce(F.col("_next_us") < F.col("_end_us"), F.lit(False)))
        .select(*asked.columns, "occurs")
    )


def _zoned_questions(asked: DataFrame, events: DataFrame, width_days: int) -> DataFrame:
    """The same from the zone map; the cost follows the questions rather than the grid."""
    width_us = width_days * DAY_US
    steps = F.sequence(cell_start("_at_us", width_us), cell_start("_end_us", width_us), F.lit(width_us))
    zones = zone_map(events, width_days).drop("n_rows").withColumnRenamed("code", "query")
    hit = (F.col("last_us") > F.col("_at_us")) & (F.col("first_us") < F.col("_end_us"))
    return (
        asked.withColumn("zone", F.explode(steps))
        .join(zones, ["subject_id", "query", "zone"], "left")
        .groupBy(*asked.columns)
        .agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("occurs"))
    )
