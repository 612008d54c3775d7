"""Writers. Partitioned tables are overwritten partition by partition, so a rerun after a failure is safe.

Before a partitioned write rows are rebalanced by the partition columns: few files per partition, and a
partition that holds much of the data is split over several tasks.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from askahead.functions import micros
from askahead.session import configure


def _finished(spark: SparkSession, path: str, keys: list[str]) -> list[tuple]:
    """What former runs have completed: one small row per configured duration and split, or one per table."""
    try:
        log = spark.read.json(f"{path}.finished")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [tuple(r) for r in log.select(*keys).distinct().collect()]


class BrokenRule(ValueError):
    """A table broke rules; ``counts`` has the rows that broke each."""

    def __init__(self, counts: dict[str, int]) -> None:
        super().__init__(f"rows that break a rule: {counts}; the table was not kept")
        self.counts = counts


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this session's file systems."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def write_checked(
    spark: SparkSession,
    build: Callable[[SparkSession], DataFrame],
    path: str,
    broken: dict[str, Column],
    counts: dict[str, Column] | None = None,
) -> dict[str, int]:
    """Write a new table and, in the same pass, count the rows for which a condition of ``broken`` holds.

    The counts ride on the write as observed metrics, so nothing is read or computed twice. If a rule is broken, what was
    written is deleted and ``BrokenRule`` raised. Returns these counts, the number of rows and further ``counts``.

    ``build`` makes the rows in a session of their own, which shares tables and executors: Spark ML functions cannot be
    sent to tasks from a session that has observed metrics.
    """
    rows, seen = build(configure(spark.newSession())), Observation()
    metrics = {name: F.count_if(condition) for name, condition in (broken | (counts or {})).items()}
    observed = rows.observe(seen, F.count("*").alias("n_rows"), *[m.alias(name) for name, m in metrics.items()])
    observed.write.mode("errorifexists").parquet(path)
    found = dict(seen.get)
    if wrong := {name: found[name] for name in broken if found[name]}:
        _remove(spark, path)
        raise BrokenRule(wrong)
    return found


def write_label_table(
    spark: SparkSession,
    build: Callable[[list[int]], DataFrame],
    path: str,
    durations: list[int],
    splits: list[str],
) -> list[tuple]:
    """Write the (duration, split) partitions that are not there yet; returns those written.

    ``build`` gets the durations that lack a partition and returns their labels with ``split``, so finished
    durations are not computed again. A partition counts as done once its whole job has finished, so
    half-written ones are made again.
    """
    keys = ["duration_days", "split"]
    done = {(int(d), s) for d, s in _finished(spark, path, keys)}
    missing = [(d, s) for d in durations for s in splits if (d, s) not in done]
    if not missing:
        return []
    todo = spark.createDataFrame(missing, "duration_days int, split string")
    labels = build(sorted({d for d, _ in missing})).where(F.col("split").isin(sorted({s for _, s in missing})))
    (
        labels.join(todo, keys, "left_semi")
        .hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )
    todo.coalesce(1).write.mode("append").json(f"{path}.finished")
    return missing


def codes_fingerprint(codes: DataFrame, durations: list[int]) -> DataFrame:
    """Identity of a training configuration, as a one-row table: its codes (repeats kept) and durations in order."""
    tail = "_" + "|".join(str(d) for d in sorted(durations))
    names = F.array_join(F.sort_array(F.collect_list("code")), "|")
    return codes.agg(F.md5(F.encode(F.concat(names, F.lit(tail)), "UTF-8")).alias("fingerprint"))


def write_collated(rows: DataFrame, root: str, fingerprint: str) -> str:
    """Training rows per split below a folder named by the configuration.

    Kept when a former run has logged its end; what an interrupted run left is replaced.
    """
    spark, path = rows.sparkSession, f"{root}/collated/{fingerprint}"
    if not _finished(spark, path, ["fingerprint"]):
        whole = rows.hint("rebalance", "split").write.mode("overwrite").option("partitionOverwriteMode", "static")
        whole.partitionBy("split").parquet(path)
        spark.createDataFrame([(fingerprint,)], "fingerprint string").write.mode("overwrite").json(f"{path}.finished")
    return path


def write_per_code(rows: DataFrame, path: str) -> str:
    """One dataset per code in a single job; codes with many rows get several files."""
    balanced = rows.hint("rebalance", "code_slug").write.mode("overwrite")
    balanced.option("partitionOverwriteMode", "dynamic").partitionBy("code_slug").parquet(path)
    return path


def write_index_times(index: DataFrame, root: str, name: str, k: int, seed: int) -> str:
    """Index times and a one-row description of how they were drawn, below a folder that says the same."""
    spark, path = index.sparkSession, f"{root}/index_times/{name}-{k}-per-subject-seed-{seed}"
    index.write.mode("overwrite").parquet(f"{path}/held_out")
    drawn = spark.createDataFrame([(name, k, seed)], "name string, sample_times_per_subject int, seed int")
    drawn.coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return path


def write_csv(rows: DataFrame, path: str, overwrite: bool = False) -> str:
    """Metrics or predictions as CSV; refuses an existing path unless told to overwrite."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)
    return path


REPORT = "bucket string, code string, code_slug string, occurs_auc double, censor_auc double"


def write_code_report(report: DataFrame, root: str, name: str, at: dt.datetime, overwrite: bool = False) -> str:
    """Both AUROCs per code with bucket and slug as CSV, under a name that says when they were measured.

    A report of that name and time is refused unless told to overwrite it. A class that is missing leaves an empty field.
    """
    columns = [f.split()[0] for f in REPORT.split(", ")]
    return write_csv(report.select(*columns), f"{root}/{name}_{at:%Y%m%d_%H%M%S}.csv", overwrite)


def write_predictions(predictions: DataFrame, path: str, overwrite: bool = False) -> str:
    """Prediction CSV: prediction_time as epoch microseconds."""
    flat = predictions.select("subject_id", micros("prediction_time").alias("prediction_time"), "occurs_probs", "code")
    return write_csv(flat, path, overwrite)


def write_embeddings(rows: DataFrame, path: str) -> str:
    rows.write.mode("errorifexists").parquet(path)
    return path


def write_code_sample(sample: DataFrame, root: str, fingerprint: str, n: int, kind: str = "ID") -> str:
    """Code sample under a name made of its size and fingerprint; an existing one is never replaced."""
    path = f"{root}/{n}_{kind}__{fingerprint}"
    sample.write.mode("errorifexists").json(path)
    return path
