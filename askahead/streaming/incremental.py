"""Label tables kept up to date from newly arrived event files.

A time's labels can still change while less than the longest duration of follow-up is on record. So per subject the events
of its last horizon are kept as state, with the number of event rows before them. A delivery is labelled together with the
kept events of its subjects: times whose follow-up has grown are labelled again, everything before is final.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from askahead.functions import micros
from askahead.functions.columns import DAY_US
from askahead.session import checkpointed

# Gets events and, per subject, how many distinct event rows came before them; returns rows with a prediction time.
Build = Callable[[DataFrame, DataFrame], DataFrame]

_LEDGER = "subject_id bigint, from_us bigint, batch_id int"
_STATE = "subject_id bigint, time timestamp_ntz, code string, n_earlier bigint, open_us bigint, batch_id int"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What earlier batches have written; nothing at first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _write(rows: DataFrame, batch_id: int, path: str) -> None:
    tagged = rows.withColumn("batch_id", F.lit(batch_id))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def current_rows(spark: SparkSession, target: str) -> DataFrame:
    """The table as of the last batch: of each prediction time the rows of the last batch that labelled it."""
    ledger = spark.read.schema(_LEDGER).parquet(f"{target}.subjects")
    # A later batch of a subject replaces everything from the start of what it had kept open.
    later = Window.partitionBy("subject_id").orderBy("batch_id")
    ends = ledger.select("subject_id", "batch_id", F.lead("from_us").over(later).alias("_until_us"))
    rows = spark.read.parquet(target).join(ends, ["subject_id", "batch_id"])
    final = F.col("_until_us").isNull() | (micros("prediction_time") < F.col("_until_us"))
    return rows.where(final).drop("_until_us", "batch_id")


def _kept(spark: SparkSession, state: str, batch_id: int, subjects: DataFrame) -> DataFrame:
    """The state of these subjects: rows of the last batch that had them."""
    rows = _read(spark, state, _STATE).where(F.col("batch_id") < batch_id).join(subjects, "subject_id", "left_semi")
    last = rows.groupBy("subject_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, ["subject_id", "batch_id"], "left_semi").drop("batch_id")


def process_new_shards(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    build: Build,
    horizon_days: int,
) -> None:
    """Run ``build`` over the event files that arrived since the last call, each exactly once.

    All files of a delivery, however many, are one batch, and a subject's events may be spread over deliveries in the order
    of time; ``current_rows`` reads the result, which equals one run over everything. ``horizon_days`` is the longest
    duration. An event from before a subject's open horizon would change labels that are final and is an error.

    The stream's checkpoint remembers the files. A batch overwrites its own partitions of labels, state and subjects, and
    reads those of earlier batches only, so a batch repeated after a failure leaves no duplicates. A delivery costs its own
    events, the open horizon of its subjects and a scan of the state.
    """
    horizon_us = horizon_days * DAY_US

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        fresh = checkpointed(batch.select("subject_id", "time", "code").where("time IS NOT NULL AND subject_id IS NOT NULL"))
        kept = checkpointed(_kept(session, f"{target}.state", batch_id, fresh.select("subject_id").distinct()))
        opened = kept.groupBy("subject_id").agg(F.max("n_earlier").alias("n_earlier"), F.max("open_us").alias("open_us"))
        late = fresh.join(opened, "subject_id").where(micros("time") < F.col("open_us"))
        if not late.isEmpty():
            raise ValueError("an event arrived from before its subject's open horizon; final labels would change")
        events = checkpointed(fresh.unionByName(kept.select(fresh.columns)).distinct())
        _write(build(events, opened.select("subject_id", "n_earlier")), batch_id, target)

        ends = events.groupBy("subject_id").agg((F.max(micros("time")) - horizon_us).alias("open_us"))
        placed = events.join(ends, "subject_id").join(opened.drop("open_us"), "subject_id", "left")
        done = placed.groupBy("subject_id").agg(
            (F.coalesce(F.max("n_earlier"), F.lit(0)) + F.count_if(micros("time") < F.col("open_us"))).alias("n_earlier")
        )
        still_open = placed.drop("n_earlier").where(micros("time") >= F.col("open_us")).join(done, "subject_id")
        _write(still_open.select("subject_id", "time", "code", "n_earlier", "open_us"), batch_id, f"{target}.state")
        subjects = ends.select("subject_id").join(opened.select("subject_id", F.col("open_us").alias("from_us")), "subject_id", "left")
        _write(subjects, batch_id, f"{target}.subjects")

    stream = spark.readStream.schema(schema).parquet(source)
    query = (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
