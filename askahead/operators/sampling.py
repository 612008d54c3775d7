"""Seeded per-subject samples. A row's place in the order depends only on its own values and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askahead.functions import draw_key, draw_number, from_micros, micros
from askahead.operators.codesets import CodeSet, code_universe, codes_or_all, codes_table, numbered
from askahead.operators.context import candidate_times, numbered_times, record_end, row_index, subject_times
from askahead.operators.skew import large_keys
from askahead.operators.zones import LIGHT_ROWS, tasks_for


def _key_parts(df: DataFrame, keys: list[str]) -> list[Column]:
    return [micros(k) if df.schema[k].dataType.typeName().startswith("timestamp") else F.col(k) for k in keys]


def seeded_shuffle(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """All rows in a random order that is the same on every run; ``keys`` identify a row."""
    return df.withColumn("shuffle_key", draw_key(seed, *_key_parts(df, keys))).orderBy("shuffle_key", *keys)


def at_most(rows: DataFrame, key: Column, k: int) -> DataFrame:
    """A random ``k`` of the rows in the order of ``key``, a hexadecimal draw key; all if there are fewer.

    Rows are counted first, and only those below a bound on the key that about ``k`` rows pass are ordered. So what
    meets in one task is about ``k`` rows, however many tasks the rows come from.
    """
    total = rows.agg(F.count("*")).scalar()
    wanted = k + 8 * int(k**0.5) + 16
    bound = F.lit(float(wanted)) / total * F.lit(float(1 << 60))
    passed = rows.withColumn("_draw", key).where(draw_number(F.col("_draw")) < bound)
    return passed.orderBy("_draw").limit(k).drop("_draw")


def sample_per_subject(df: DataFrame, keys: list[str], k: int, seed: int) -> DataFrame:
    """The first ``k`` rows of each subject in seeded order.

    The limit is applied within each task before the shuffle, so a large subject sends only ``k`` rows
    per task.
    """
    order = Window.partitionBy("subject_id").orderBy("_key", *keys)
    return (
        df.withColumn("_key", draw_key(seed, *_key_parts(df, keys)))
        .withColumn("_nth", F.row_number().over(order))
        .where(F.col("_nth") <= k)
        .drop("_key", "_nth")
    )


def sample_index_times(labels: DataFrame, k: int = 1, seed: int = 43, subjects: Column | None = None) -> DataFrame:
    """Index times: ``k`` seeded prediction times per subject with their censoring flag.

    ``subjects`` is a condition on ``subject_id``, such as the held-out split; without it all are sampled.
    """
    times = labels.select("subject_id", "prediction_time", "censored")
    times = times if subjects is None else times.where(subjects)
    return sample_per_subject(times, ["subject_id", "prediction_time"], k, seed)


def _draw_without_replacement(population: Column, k: int, seed: int, *key: str) -> Column:
    """Array of min(k, population) distinct numbers below ``population``, uniformly drawn.

    Floyd's method: for each i the draw is below n - k + i + 1 and, when already taken, is replaced by
    that upper end, which cannot have been taken before. No draw is ever repeated or rejected.
    """
    size = F.least(F.lit(k).cast("bigint"), population)

    def step(taken: Column, i: Column) -> Column:
        top = population - size + i
        pick = F.pmod(draw_number(draw_key(seed, *[F.col(c) for c in key], i)), top + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, pick), top).otherwise(pick)))

    steps = F.sequence(F.lit(0).cast("bigint"), size - 1)
    return F.aggregate(steps, F.array().cast("array<bigint>"), step)


def _numbered_codes(codes: CodeSet, spark: SparkSession) -> DataFrame:
    return numbered(code_universe(codes_table(codes, spark)).where(F.col("code").isNotNull()), ["code"], "_code_no")


def _drawn_cells(sizes: DataFrame, vocab: DataFrame, durations: range, k: int, seed: int) -> DataFrame:
    """The drawn cells of each subject with ``_n_times`` times, decoded to ``row_index``, ``_code_no`` and ``duration_days``."""
    n_durations = F.lit(len(durations)).cast("bigint")
    population = F.col("_n_times") * F.col("_n_codes") * n_durations
    return (
        sizes.withColumn("_n_codes", vocab.agg(F.count("*")).scalar())
        .where(F.col("_n_codes") > 0)
        .withColumn("_cell", F.explode(_draw_without_replacement(population, k, seed, "subject_id")))
        .withColumn("duration_days", (F.pmod("_cell", n_durations) * F.lit(durations.step) + durations.start).cast("int"))
        .withColumn("_rest", F.expr(f"_cell div {len(durations)}"))
        .withColumn("_code_no", F.pmod("_rest", "_n_codes"))
        .withColumn("row_index", F.expr("_rest div _n_codes"))
        .drop("_n_times", "_n_codes", "_cell", "_rest")
    )


def _with_query(cells: DataFrame, vocab: DataFrame) -> DataFrame:
    # Drawn numbers are uniform, so this join has no large key however skewed the codes are in the log.
    return cells.join(vocab.withColumnRenamed("code", "query"), "_code_no").drop("_code_no")


def _sample_times(candidates: DataFrame, vocab: DataFrame, durations: range, k: int, seed: int) -> DataFrame:
    sizes = candidates.groupBy("subject_id").agg(F.count("*").alias("_n_times"))
    cells = _with_query(_drawn_cells(sizes, vocab, durations, k, seed), vocab)
    asked = row_index(candidates).join(cells, ["subject_id", "row_index"])
    return asked.select("subject_id", "prediction_time", "query", "duration_days")


def sample_grid(candidates: DataFrame, codes: CodeSet, durations: range, k: int, seed: int) -> DataFrame:
    """``k`` random cells per subject from times × codes × durations, without building the grid.

    Cell numbers are drawn per subject and then decoded, codes through a table of numbered codes; only the drawn
    cells are ever rows, and the size of the vocabulary does not matter. Gives
    (subject_id, prediction_time, query, duration_days).
    """
    return _sample_times(candidates, _numbered_codes(codes, candidates.sparkSession), durations, k, seed)


def sample_log(
    events: DataFrame,
    codes: CodeSet | None,
    durations: range,
    k: int,
    seed: int,
    min_context: int,
    light_rows: int = LIGHT_ROWS,
) -> DataFrame:
    """``sample_grid`` over the candidate times of a log, with ``record_end_time``.

    Subjects with at most ``light_rows`` rows are each read and drawn for in one task, from one shuffle of the log that is
    dealt to more tasks the longer the log is. The rows of others are dealt by their times, whatever their number.
    """
    vocab = _numbered_codes(codes_or_all(codes, events), events.sparkSession)
    if min_context < 1:
        # A sample has at most k rows per subject, so this join has no large key.
        drawn = _sample_times(candidate_times(events, min_context), vocab, durations, k, seed)
        return drawn.join(record_end(events), "subject_id")
    timed = events.where(F.col("time").isNotNull() & F.col("subject_id").isNotNull())
    large = large_keys(timed, ["subject_id"], light_rows)
    n_tasks = tasks_for(timed.sparkSession, timed.count())
    light = timed if large is None else timed.join(large, "subject_id", "left_anti")
    known = subject_times(light, min_context, n_tasks).withColumn("_n_times", F.size("times").cast("bigint"))
    at = from_micros(F.get("times", F.col("row_index").cast("int")))
    cells = _drawn_cells(known, vocab, durations, k, seed).withColumn("prediction_time", at).drop("times")
    columns = ["subject_id", "prediction_time", "query", "duration_days", "record_end_time"]
    drawn = _with_query(cells, vocab).select(*columns)
    if large is None:
        return drawn
    times = numbered_times(timed.join(large, "subject_id", "left_semi"), min_context, n_tasks)
    sizes = times.groupBy("subject_id").agg(
        F.count("*").alias("_n_times"), F.min("_nth").alias("_first"), F.max("prediction_time").alias("record_end_time")
    )
    cells = _drawn_cells(sizes, vocab, durations, k, seed).withColumn("_nth", F.col("_first") + F.col("row_index"))
    return drawn.unionByName(times.join(_with_query(cells, vocab), ["subject_id", "_nth"]).select(*columns))
