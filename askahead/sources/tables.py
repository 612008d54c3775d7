"""Readers. All of them project early so that only the needed columns are read."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askahead.functions import from_micros
from askahead.operators.codesets import CodeSet, numbered, only_codes
from askahead.operators.sequences import OPTIONAL_LABELS
from askahead.schemas import PREDICTIONS_CSV

_REQUIRED_LABELS = ["subject_id", "prediction_time"]


def event_view(rows: DataFrame, subject: str, time: str, code: str, value: str | None = None) -> DataFrame:
    """Name the event columns of any table; nothing else is read from it."""
    picked = [
        F.col(subject).cast("bigint").alias("subject_id"),
        F.col(time).cast("timestamp_ntz").alias("time"),
        F.col(code).alias("code"),
    ]
    return rows.select(*picked, *([F.col(value).cast("double").alias("numeric_value")] if value else []))


def scan_events(rows: DataFrame) -> DataFrame:
    """Distinct (subject_id, time, code) rows."""
    return rows.select("subject_id", "time", "code").distinct()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return scan_events(event_view(spark.read.parquet(path), "subject_id", "time", "code"))


def code_vocab(rows: DataFrame) -> DataFrame:
    """Vocabulary of a table with a ``code`` column: index by code order, 0 stays free for padding."""
    codes = rows.where(F.col("code").isNotNull()).select("code").distinct()
    return numbered(codes, ["code"], "_no").select("code", (F.col("_no") + 1).cast("int").alias("vocab_index"))


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Stored vocabulary with ``code`` and ``code/vocab_index``; a missing file is an empty vocabulary, with a warning."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        warnings.warn(f"no vocabulary at {path}: every code becomes the padding index", stacklevel=2)
        return spark.createDataFrame([], "code string, vocab_index int")
    return stored.select("code", F.col("`code/vocab_index`").cast("int").alias("vocab_index"))


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The label columns of each file with their types, from its footer."""
    for batch in batches:
        shapes = []
        for path in batch["path"]:
            fs, inner = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(inner) as file:
                kinds = {f.name: str(f.type) for f in pq.read_schema(file)}
            shapes.append(",".join(f"{c}:{kinds[c]}" for c in [*_REQUIRED_LABELS, *OPTIONAL_LABELS] if c in kinds))
        yield pd.DataFrame({"path": batch["path"], "shape": shapes})


def label_shapes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(shape, n_files, path): the different sets of label columns in these files, with one file of each.

    Spark lists the files, tasks read their footers, and equal ones are counted before anything reaches the driver.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(paths).select("path")
    # Their contents are not read; dealt anew, as files are packed into tasks by their size.
    files = listed.repartition(spark.sparkContext.defaultParallelism)
    shapes = files.mapInPandas(_footers, "path string, shape string")
    return shapes.groupBy("shape").agg(F.count("*").alias("n_files"), F.min("path").alias("path"))


def read_labels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Label files in one scan: the required columns and whichever optional ones exist. All files must agree.

    Only footers are read to compare the files, by tasks; the driver sees the first two different shapes.
    """
    shapes = label_shapes(spark, paths).orderBy(F.desc("n_files"), "shape").take(2)
    if len(shapes) > 1:
        raise ValueError(f"label file {shapes[1]['path']} has other label columns than {shapes[0]['path']}")
    rows = spark.read.parquet(*paths)
    return rows.select(*[c for c in [*_REQUIRED_LABELS, *OPTIONAL_LABELS] if c in rows.columns])


def pruned_labels(labels: DataFrame, codes: CodeSet) -> DataFrame:
    """Keys and labels of the wanted codes only; a code list reaches the file scan as a filter."""
    return only_codes(labels, codes, "query").select("subject_id", "prediction_time", "query", "censored", "occurs")


def pruned_matrix(matrix: DataFrame, codes: list[str]) -> DataFrame:
    return matrix.select("subject_id", "prediction_time", "censored", *codes)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction CSV with epoch microseconds."""
    stored = spark.read.schema(PREDICTIONS_CSV).csv(path, header=True)
    return stored.withColumn("prediction_time", from_micros("prediction_time"))


def _split() -> Column:
    """Split by subject: eight tenths train, one tuning, one held out."""
    digit = F.pmod("subject_id", F.lit(10))
    return F.when(digit < 8, F.lit("train")).when(digit == 8, F.lit("tuning")).otherwise(F.lit("held_out"))


def with_split(rows: DataFrame) -> DataFrame:
    return rows.withColumn("split", _split())


def in_split(split: str) -> Column:
    return _split() == split
