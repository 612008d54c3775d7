"""Running results along a subject's timeline, without one task per subject.

A plain window partitioned by subject puts a subject's whole history into one task. Here time is cut
into nested cells (a day, then a second). Each cell is summarised by an ordinary pre-aggregated
``groupBy``, windows run over the summaries of one enclosing cell, and only rows that share the finest
cell meet in a row-level window. No window therefore sees more than the days of the calendar, the
86,400 seconds of a day, or the moments of one second, however much of the data one subject owns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askahead.functions.columns import DAY_US, SECOND_US, cell_start, from_micros, micros
from askahead.operators.skew import large_keys

CELLS = (DAY_US, SECOND_US)


@dataclass(frozen=True)
class Running:
    """One running column: ``sum``, ``max`` or ``min`` of ``value``, with or without ties at the row.

    With ``whole`` it covers all rows of the key instead.
    """

    name: str
    value: Column
    fold: str = "sum"
    ties: bool = True
    whole: bool = False

    def aggregate(self, col: Column | str) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.fold](col)

    def merge(self, *parts: Column) -> Column:
        if self.fold == "sum":
            return sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
        return (F.greatest if self.fold == "max" else F.least)(*parts)


def running(
    rows: DataFrame,
    keys: list[str],
    at: str,
    measures: list[Running],
    ahead: bool = False,
    cells: tuple[int, ...] = CELLS,
) -> DataFrame:
    """Add running measures over the rows up to ``at`` (or, with ``ahead``, from ``at`` on) per key.

    Rows without a key or a time are on no timeline and are left out. Keep ``rows`` to the columns that
    matter here and join others afterwards: cell summaries and row windows then start from one and the
    same shuffle of ``rows``.
    """
    cell_names = [f"_cell{i}" for i in range(len(cells))]

    def cell(width: int) -> Column:
        # Never null, so that the joins below add no null checks under the shared shuffle.
        return F.coalesce(cell_start(micros(at), width), F.lit(0).cast("bigint"))

    for column in (*keys, at):
        rows = rows.where(F.col(column).isNotNull())
    marked = rows.repartition(*keys, cell(cells[-1])).withColumns(
        {"_us": micros(at)}
        | {name: cell(width) for name, width in zip(cell_names, cells, strict=True)}
        | {f"_v_{m.name}": m.value for m in measures}
    )

    # Cell summaries, finest first; each coarser level aggregates the finer one.
    summaries: list[DataFrame] = []
    source = marked
    for depth in range(len(cells), 0, -1):
        source = source.groupBy(*keys, *cell_names[:depth]).agg(
            *[m.aggregate(f"_v_{m.name}").alias(f"_v_{m.name}") for m in measures]
        )
        summaries.insert(0, source)

    # Frames always grow from the start of the order: one that shrinks towards the end would be
    # recomputed for every row. Looking ahead therefore means running through time backwards.
    sign = -1 if ahead else 1

    # What lies outside the row's cell: the other cells of the enclosing cell, level by level.
    outside: DataFrame | None = None
    for depth, summary in enumerate(summaries):
        enclosing = [*keys, *cell_names[:depth]]
        in_order = Window.partitionBy(*enclosing).orderBy(F.col(cell_names[depth]) * sign)
        w = in_order.rowsBetween(Window.unboundedPreceding, -1)
        grain = [*enclosing, cell_names[depth]]
        if outside is None:
            over = {m.name: Window.partitionBy(*keys) if m.whole else w for m in measures}
            outside = summary.select(
                *grain, *[m.aggregate(f"_v_{m.name}").over(over[m.name]).alias(f"_o_{m.name}") for m in measures]
            )
        else:
            partial = [m for m in measures if not m.whole]
            level = summary.select(*grain, *[m.aggregate(f"_v_{m.name}").over(w).alias(f"_n_{m.name}") for m in partial])
            outside = level.join(outside, enclosing).select(
                *grain,
                *[m.merge(F.col(f"_n_{m.name}"), F.col(f"_o_{m.name}")).alias(f"_o_{m.name}") for m in partial],
                *[f"_o_{m.name}" for m in measures if m.whole],
            )

    within = Window.partitionBy(*keys, cell_names[-1]).orderBy(F.col("_us") * sign)

    def frame(m: Running):
        return within.rangeBetween(Window.unboundedPreceding, 0 if m.ties else -1)

    inside = marked.withColumns(
        {f"_i_{m.name}": m.aggregate(f"_v_{m.name}").over(frame(m)) for m in measures if not m.whole}
    )
    joined = inside.join(outside.drop(*cell_names[:-1]), [*keys, cell_names[-1]], "left")

    def result(m: Running) -> Column:
        return F.col(f"_o_{m.name}") if m.whole else m.merge(F.col(f"_i_{m.name}"), F.col(f"_o_{m.name}"))

    return joined.select(*rows.columns, *[result(m).alias(m.name) for m in measures])


def next_event_time(probes: DataFrame, events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First event time of the same key strictly after ``at`` (null when there is none)."""
    marks = probes.select(*keys, F.col(at).alias("_at"), F.lit(True).alias("_probe")).distinct().unionByName(
        events.select(*keys, F.col("time").alias("_at"), F.lit(False).alias("_probe")).distinct()
    )
    event_us = F.when(~F.col("_probe"), micros("_at"))
    scanned = running(marks, keys, "_at", [Running("_next_us", event_us, "min", ties=False)], ahead=True)
    return scanned.where("_probe").select(
        *keys, F.col("_at").alias(at), from_micros("_next_us").alias("next_time")
    )


# Cells of 2 ** 10 microseconds, and each next level 32 times as wide; the last is wider than any calendar.
_FIRST_BITS, _STEP_BITS, _LEVELS = 10, 5, 11
_OPEN = -1
# Rows of one subject that are ordered in one task.
_LIGHT_ROWS = 10_000


def gaps_before(events: DataFrame) -> DataFrame:
    """(subject_id, code, from_us, next_us): each event time of a code with that code's time before, null at the first."""
    times = events.where(F.col("time").isNotNull() & F.col("subject_id").isNotNull() & F.col("code").isNotNull())
    times = times.select("subject_id", "code", "time")
    large = large_keys(times, ["subject_id"], _LIGHT_ROWS)
    light = times if large is None else times.join(large, "subject_id", "left_anti")
    in_order = Window.partitionBy("subject_id", "code").orderBy("next_us")
    gaps = (
        light.select("subject_id", "code", micros("time").alias("next_us"))
        .repartition("subject_id")
        .distinct()
        .withColumn("from_us", F.lag("next_us").over(in_order))
    )
    if large is not None:
        heavy = times.join(large, "subject_id", "left_semi").distinct()
        placed = running(heavy, ["subject_id", "code"], "time", [Running("from_us", micros("time"), "max", ties=False)])
        gaps = gaps.unionByName(placed.select("subject_id", "code", micros("time").alias("next_us"), "from_us"))
    return gaps


def next_times(probes: DataFrame, events: DataFrame) -> DataFrame:
    """(subject_id, prediction_time, code, next_time) for every distinct probe and each code that comes strictly after it.

    An event answers for the gap before it, from the code's time before. A gap is filed under the level whose cells are
    just as wide, so it lies in two cells at most, and a cell has at most some 34 gaps of one code, whatever the data. A
    probe looks into its cell of each level that occurs. No probe is combined with a code that does not follow it.
    """
    gaps = gaps_before(events)
    length = F.col("next_us") - F.col("from_us")
    level = F.when(F.col("from_us").isNull(), F.lit(_OPEN))
    for k in range(_LEVELS):
        level = level.when(length <= (1 << (_FIRST_BITS + _STEP_BITS * k)), F.lit(k))
    filed = gaps.withColumn("_level", level)
    bits = f"{_FIRST_BITS} + {_STEP_BITS} * _level"
    cells = F.expr(f"IF(_level = {_OPEN}, array(0L), array_distinct(array(shiftright(from_us, {bits}), shiftright(next_us - 1, {bits}))))")
    filed = filed.withColumn("_cell", F.explode(cells))
    levels = gaps.select(level.alias("_level")).agg(F.collect_set("_level").alias("levels")).scalar()
    asked = (
        probes.select("subject_id", "prediction_time")
        .distinct()
        .withColumn("_at", micros("prediction_time"))
        .withColumn("_level", F.explode(levels))
        .withColumn("_cell", F.expr(f"IF(_level = {_OPEN}, 0L, shiftright(_at, {bits}))"))
    )
    inside = (F.col("_at") < F.col("next_us")) & (F.col("from_us").isNull() | (F.col("from_us") <= F.col("_at")))
    found = asked.join(filed, ["subject_id", "_level", "_cell"]).where(inside)
    return found.select("subject_id", "prediction_time", "code", from_micros("next_us").alias("next_time"))


def with_all_codes(found: DataFrame, probes: DataFrame, codes: Column) -> DataFrame:
    """A row per probe and code of the array, without a time where the code does not come again."""
    key = ["subject_id", "prediction_time"]
    known = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("code", "next_time"))).alias("_next"))
    rows = probes.select(*key).distinct().join(known, key, "left").withColumn("code", F.explode(codes))
    return rows.withColumn("next_time", F.col("_next")[F.col("code")]).drop("_next")


def history_bound(probes: DataFrame, events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Number of distinct event times up to and including ``at`` for each distinct probe.

    Subjects without any event drop out, as in an inner join with the history.
    """
    times = events.where(F.col("time").isNotNull()).select(*keys, F.col("time").alias("_at")).distinct()
    marks = (
        probes.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_n")).distinct()
        .unionByName(times.withColumn("_n", F.lit(1)))
    )
    n = F.col("_n")
    scanned = running(marks, keys, "_at", [Running("end_event_index", n), Running("_times", n, whole=True)])
    return scanned.where("_n = 0 AND _times > 0").select(*keys, F.col("_at").alias(at), "end_event_index")
