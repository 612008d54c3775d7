"""Table layouts. Timestamps are naive, microsecond precision; codes and durations are rows."""

from __future__ import annotations

from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("code", T.StringType()),
    ]
)

CODES = T.StructType([T.StructField("code", T.StringType()), T.StructField("vocab_index", T.IntegerType())])

CODE_LIST = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("pos", T.IntegerType()),
    ]
)

# As written to CSV: prediction_time is an epoch microsecond count.
PREDICTIONS_CSV = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("prediction_time", T.LongType()),
        T.StructField("occurs_probs", T.DoubleType()),
        T.StructField("code", T.StringType()),
    ]
)

SCORED = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("prediction_time", T.TimestampNTZType()),
        T.StructField("code", T.StringType()),
        T.StructField("occurs_probs", T.DoubleType()),
        T.StructField("censor_probs", T.DoubleType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

SPLITS = ("train", "tuning", "held_out")
LABEL_KEY = ["subject_id", "prediction_time", "query", "duration_days"]
PAD_INDEX = 0
