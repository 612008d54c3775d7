"""Removal of lines that many documents share, with levelled sorted runs of line hashes.

Documents come in batches of falling ids. The keys of a batch are sorted by hash and merge-anti-joined with the runs:
keys in no run are new, and the batch's largest id holding one is the document that keeps the line; keys found in a run
only add to its count. The batch then adds its own run. Once a level has ``fanout`` runs, they are merged into one run
of the next level, so there are few runs at any time and each row is rewritten once per level.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askahead.llm.common import LOWER, UPPER, fresh_path, stored

KEY = ["h1", "h2"]
_SPACE = " \t\n\x0b\x0c\r"
# Stands in for a null id: one document below all others.
_NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z as a-z; other letters keep their case."""
    bare = F.btrim(line, F.lit(_SPACE))
    # For ASCII text lower() is the same and much faster.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, keeper), level by level; ``keeper`` is set in the run that brought the key."""

    def __init__(self, fanout: int = 3) -> None:
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """Add a batch with columns h1, h2, n_docs, last_doc and one row per key, all ids below those added before."""
        keys = stored(keys.sortWithinPartitions(*KEY), "batch_keys")
        new = keys.withColumnRenamed("last_doc", "keeper")
        if self.runs():
            known = reduce(DataFrame.union, self.runs()).where(F.col("keeper").isNotNull()).select(*KEY).hint("merge")
            again = keys.join(known, KEY, "left_semi").withColumn("last_doc", F.lit(None).cast("bigint"))
            new = new.join(known, KEY, "left_anti").union(again)
        self._place(new.sortWithinPartitions(*KEY), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(stored(run, f"run_level_{level}"))
        if len(self.levels[level]) >= self.fanout:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            self._place(merged, level + 1)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        merged = reduce(DataFrame.union, runs).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
        return merged.sortWithinPartitions(*KEY)

    def state(self) -> DataFrame:
        """One row per key over all runs."""
        return self._merge(self.runs())


def _batch_bounds(ids: DataFrame, batches: int) -> list[float]:
    """Ids that divide the documents into about equal batches; any bounds give the same result."""
    shares = [i / batches for i in range(1, batches)]
    return sorted(set(ids.approxQuantile("_doc", shares, 0.01)), reverse=True) if shares else []


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 4,
    fanout: int = 3,
) -> DataFrame:
    """(id, n_lines, n_dropped, kept_text): one row per document.

    A line whose key has at least ``min_chars`` code points and occurs in at least ``min_docs`` documents stays only in
    the one with the largest id. Null and empty texts are one empty line. Rows with the same id count as one document
    and keep or lose a line together; rows with null id count as one document below all others. Repeats of a line within
    a document go or stay together. Other columns are ignored; an empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("_doc"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    ).withColumn("_sig", F.xxhash64("_text"))
    bounds = _batch_bounds(rows.select("_doc"), batches)
    batch = reduce(lambda acc, b: acc + (F.col("_doc") <= b).cast("int"), bounds, F.lit(0))
    path = fresh_path(spark, "lines")
    (
        rows.select(batch.alias("batch"), "_doc", "_sig", F.posexplode(lines_of("_text")).alias("pos", "_line"))
        .withColumn("_key", line_key(F.col("_line")))
        .where(F.length("_key") >= min_chars)
        .select("batch", "_doc", "_sig", "pos", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), "_key").alias("h2"))
        .write.partitionBy("batch")
        .parquet(path)
    )
    lines = spark.read.schema("_doc bigint, _sig bigint, pos int, h1 bigint, h2 bigint, batch int").parquet(path)
    runs = LineRuns(fanout)
    for i in range(len(bounds) + 1):
        of_batch = lines.where(F.col("batch") == i)
        runs.add(of_batch.groupBy(*KEY).agg(F.countDistinct("_doc").alias("n_docs"), F.max("_doc").alias("last_doc")))
    # Stored, so that both sides of the join below come from a shuffle and adaptive execution can split hot lines.
    common = stored(runs.state().where(F.col("n_docs") >= min_docs), "common_lines")
    dropped = (
        lines.join(common, KEY)
        .where(F.col("_doc") != F.col("keeper"))
        .groupBy("_doc", "_sig")
        .agg(F.collect_set("pos").alias("_dropped"))
    )
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.transform(F.array_except(every, F.col("_dropped")), lambda i: F.get("_lines", i))
    return (
        rows.join(dropped, ["_doc", "_sig"], "left")
        .withColumn("_lines", lines_of("_text"))
        .select(
            F.col("_id").alias(id_col),
            F.size("_lines").cast("bigint").alias("n_lines"),
            F.greatest(F.size("_dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
            F.when(F.col("_dropped").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        )
    )
