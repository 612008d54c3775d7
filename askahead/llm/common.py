"""Session settings, shared tables and file access of the corpus operators."""

from __future__ import annotations

import uuid
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askahead.session import configure, fresh_path

# Documents per Arrow batch; with the byte limit it bounds what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 512, "16m"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings and small Arrow batches, as documents can be very long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written once to the shared folder and read back: computed once, kept if an executor is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def with_row_id(df: DataFrame) -> tuple[DataFrame, str]:
    """The table with a number per row under a name that it did not have, and that name.

    Stored, so that every later read sees the same numbers.
    """
    name = "_rid"
    while name in df.columns:
        name += "_"
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def text_bytes(column: str = "text") -> Any:
    """UTF-8 bytes of a text column, null kept; Python tasks then need not decode and encode."""
    return F.col(column).cast("binary")


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system behind a shared folder's path or URI, and the path inside it."""
    return pafs.FileSystem.from_uri(path)


def write_file(folder: str, stem: str, suffix: str, write) -> tuple[str, int]:
    """Write one file under a name no other task attempt uses; only names that reach the caller count.

    ``write`` gets the open stream. Returns (name, bytes). A lost task leaves an unlisted file behind, never half a
    listed one.
    """
    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    with fs.open_output_stream(f"{base}/{name}") as out:
        write(out)
        size = out.tell()
    return name, size


def read_file(folder: str, name: str) -> bytes:
    fs, base = open_folder(folder)
    with fs.open_input_stream(f"{base}/{name}") as source:
        return source.read()
