"""A stored log of numbered, encoded tokens that histories are read from.

Tokens are numbered once, along their subject's timeline. Block b of a subject stands for the prediction times from the
time of its token b * L up to that of token (b + 1) * L, and holds the tokens of block b - 1, too, so that the last L tokens
before any such time are in the one row. Blocks are stored bucketed and sorted by subject; those of subjects with very many
tokens are bucketed by subject and block. Reading histories then shuffles the prediction times only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askahead.functions import micros
from askahead.functions.columns import DAY_US, from_micros
from askahead.operators.skew import ROWS_PER_TASK, heavy_keys, join_to_unique, large_keys
from askahead.operators.timeline import Running, running
from askahead.schemas import PAD_INDEX
from askahead.session import checkpointed, fresh_path

_TOKEN = "struct<us:bigint,code:int,numeric_value:float,time_delta_days:float>"
_BLOCK = f"subject_id bigint, block bigint, from_us bigint, until_us bigint, tokens array<{_TOKEN}>"
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1
# Further fields of a token by name.
TokenFields = Callable[[Column], dict[str, Column]]
# Blocks of one subject that its prediction times are compared with one by one.
FEW_BLOCKS = 64
# Tokens that are worth a bucket of their own.
BUCKET_TOKENS = 10_000
# Rows of one subject that are ordered in one task.
LIGHT_ROWS = 10_000


def encode(rows: DataFrame, vocab: DataFrame, heavy: DataFrame | None, on: str = "code", to: str = "code_id") -> DataFrame:
    """Vocabulary index of each code; a code outside the vocabulary becomes the padding index."""
    ids = vocab.select(F.col("code").alias(on), F.col("vocab_index").alias("_index"))
    coded = join_to_unique(rows, ids, [on], heavy, F.xxhash64(*rows.columns), "left")
    return coded.withColumn(to, F.coalesce("_index", F.lit(PAD_INDEX))).drop("_index")


def numbered_tokens(
    events: DataFrame, vocab: DataFrame, max_len: int, heavy_codes: DataFrame | None = None, light_rows: int = LIGHT_ROWS
) -> DataFrame:
    """(subject_id, pos, us, code, numeric_value, time_delta_days) of every token that can be among the last ``max_len``.

    Within one time tokens are ordered by code id, then value. A time counts at most ``max_len`` tokens, its last ones,
    because a prediction time sees all of its events or none. The first token of a time carries the days since the time
    before, 0 at the subject's first, and the others 0. Subjects with at most ``light_rows`` rows are ordered by one
    shuffle, the others cell by cell.
    """
    timed = events.where(F.col("time").isNotNull() & F.col("subject_id").isNotNull())
    nan = F.lit(float("nan")).cast("float")
    value = F.coalesce(F.col("numeric_value").cast("float"), nan) if "numeric_value" in events.columns else nan
    large = large_keys(timed, ["subject_id"], light_rows)

    def coded(rows: DataFrame) -> DataFrame:
        return encode(rows, vocab, heavy_codes).select("subject_id", "time", "code_id", value.alias("numeric_value"))

    if large is None:
        return _ordered_tokens(coded(timed), max_len)
    heavy = timed.join(large, "subject_id", "left_semi")
    light = coded(timed.join(large, "subject_id", "left_anti"))
    return _ordered_tokens(light, max_len).unionByName(_placed_tokens(coded(heavy), heavy, max_len))


def _token_columns(pos: Column, first: Column, before_us: Column) -> list[Column]:
    delta = F.coalesce((F.col("us") - before_us) / F.lit(float(DAY_US)), F.lit(0.0))
    return [
        F.col("subject_id"),
        pos.cast("bigint").alias("pos"),
        F.col("us"),
        F.col("code_id").alias("code"),
        F.col("numeric_value"),
        F.when(first, delta).otherwise(F.lit(0.0)).cast("float").alias("time_delta_days"),
    ]


def _ordered_tokens(coded: DataFrame, max_len: int) -> DataFrame:
    """Tokens numbered along each subject: one shuffle and one order serve all windows."""
    one_time = Window.partitionBy("subject_id", "us")
    subject = Window.partitionBy("subject_id").orderBy("us", "code_id", "numeric_value")
    rows = coded.withColumn("us", micros("time")).drop("time").repartition("subject_id")
    rows = rows.withColumns(
        {"_nth": F.row_number().over(one_time.orderBy("code_id", "numeric_value")), "_n": F.count("*").over(one_time)}
    )
    kept = rows.where(F.col("_n") - F.col("_nth") < max_len)
    kept = kept.withColumns({"_pos": F.row_number().over(subject) - 1, "_before": F.lag("us").over(subject)})
    first = F.col("_nth") == F.greatest(F.col("_n") - max_len + 1, F.lit(1))
    return kept.select(*_token_columns(F.col("_pos"), first, F.col("_before")))


def _placed_tokens(coded: DataFrame, timed: DataFrame, max_len: int) -> DataFrame:
    """The same without one task per subject."""
    latest = Window.partitionBy("subject_id", "time").orderBy(F.desc("code_id"), F.desc("numeric_value"))
    tokens = coded.withColumn("from_end", F.row_number().over(latest)).where(F.col("from_end") <= max_len)
    sizes = timed.groupBy("subject_id", "time").agg(F.least(F.count("*"), F.lit(max_len)).alias("n_tokens"))
    measures = [Running("end", F.col("n_tokens")), Running("before_us", micros("time"), "max", ties=False)]
    placed = running(sizes, ["subject_id"], "time", measures)
    first = F.col("from_end") == F.col("n_tokens")
    rows = tokens.join(placed, ["subject_id", "time"]).withColumn("us", micros("time"))
    return rows.select(*_token_columns(F.col("end") - F.col("from_end"), first, F.col("before_us")))


def _blocks(tokens: DataFrame, max_len: int) -> DataFrame:
    """Tokens gathered by block, with those of the block before."""
    own = F.expr(f"pos div {max_len}")
    # A subject's last block has no copy of itself in one after it; that row has no token of its own and is dropped.
    copies = F.explode(F.array(own, own + 1)).alias("block")
    entry = F.struct("pos", F.struct("us", "code", "numeric_value", "time_delta_days").alias("token"))
    starts = F.min(F.when(F.col("pos") == F.col("block") * max_len, F.col("us")))
    gathered = (
        tokens.select("*", copies)
        .groupBy("subject_id", "block")
        .agg(F.sort_array(F.collect_list(entry))["token"].alias("tokens"), starts.alias("from_us"))
        .where(F.col("from_us").isNotNull())
    )
    return gathered


def _with_ends(blocks: DataFrame, tokens: DataFrame, max_len: int) -> DataFrame:
    """Blocks with the time up to which each stands; the first stands for all times before it, too."""
    starts = tokens.where(f"pos % {max_len} = 0 AND pos > 0").select(
        "subject_id", F.expr(f"pos div {max_len} - 1").alias("block"), F.col("us").alias("until_us")
    )
    bounded = blocks.join(starts, ["subject_id", "block"], "left")
    return bounded.select(
        "subject_id",
        "block",
        F.when(F.col("block") == 0, F.lit(_FIRST)).otherwise(F.col("from_us")).alias("from_us"),
        F.coalesce("until_us", F.lit(_LAST)).alias("until_us"),
        "tokens",
    )


@dataclass(frozen=True)
class TokenLog:
    """Blocks of ``max_len`` tokens below ``path``: ``few`` by subject, ``many`` by subject and block."""

    spark: SparkSession
    path: str
    max_len: int
    buckets: int
    has_many: bool

    def _table(self, name: str, keys: str) -> DataFrame:
        """The stored blocks as a table that Spark knows to be bucketed."""
        table = f"token_log_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {table} ({_BLOCK}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
        )
        return self.spark.table(table)

    def histories(
        self, probes: DataFrame, max_len: int | None = None, more: TokenFields | None = None, keep: list[str] | None = None
    ) -> DataFrame:
        """(subject_id, prediction_time, tokens): the last ``max_len`` tokens up to each distinct time, oldest first.

        Times of subjects without tokens drop out; one before the first token has none. ``more`` gives each token further
        fields, made once per stored token instead of once per history that it is in. With ``keep`` there is a row per row
        of ``probes``, with these columns of it.
        """
        max_len = max_len or self.max_len
        if max_len > self.max_len:
            raise ValueError(f"the log holds histories of at most {self.max_len} tokens")

        def stored(name: str, keys: str) -> DataFrame:
            blocks = self._table(name, keys)
            if more is None:
                return blocks
            names = blocks.schema["tokens"].dataType.elementType.names
            token = lambda t: F.struct(*(t[n].alias(n) for n in names), *(v.alias(n) for n, v in more(t).items()))
            return blocks.withColumn("tokens", F.transform("tokens", token))

        key, keep = ["subject_id", "prediction_time"], keep or []
        rows = probes.select(*key, *keep) if keep else probes.select(*key).distinct()
        times = rows.withColumn("_us", micros("prediction_time"))
        inside = (F.col("_us") >= F.col("from_us")) & (F.col("_us") < F.col("until_us"))
        found = stored("few", "subject_id").join(times, "subject_id").where(inside)
        if self.has_many:
            many = stored("many", "subject_id, block")
            # Only the starts of blocks are read and shuffled for this.
            starts = many.select("subject_id", F.col("from_us").alias("_at"), F.col("block").alias("_block"))
            marks = times.join(starts.select("subject_id").distinct(), "subject_id", "left_semi").select(
                "subject_id", F.col("_us").alias("_at"), F.lit(None).cast("bigint").alias("_block")
            )
            first = F.when(F.col("_at") == _FIRST, F.lit(0)).otherwise(F.col("_at"))
            timed = starts.unionByName(marks).where(f"_at <> {_FIRST}").withColumn("_time", from_micros(first))
            at = running(timed, ["subject_id"], "_time", [Running("_in", F.col("_block"), "max")])
            located = at.where("_block IS NULL").select(
                "subject_id", F.col("_time").alias("prediction_time"), F.coalesce("_in", F.lit(0)).cast("bigint").alias("block")
            )
            located = rows.join(located.distinct(), key) if keep else located
            late = many.join(located, ["subject_id", "block"]).withColumn("_us", micros("prediction_time"))
            found = found.unionByName(late)
        seen = F.filter("tokens", lambda t: t["us"] <= F.col("_us"))
        late = found.select(*key, *keep, seen.alias("tokens"))
        start = F.greatest(F.size("tokens") - max_len + 1, F.lit(1))
        return late.withColumn("tokens", F.slice("tokens", start, F.lit(max_len)))


def build(
    events: DataFrame,
    vocab: DataFrame,
    max_len: int = 256,
    path: str | None = None,
    few_blocks: int = FEW_BLOCKS,
    buckets: int | None = None,
) -> TokenLog:
    """Number and encode the tokens of a log and store them; ``path`` defaults to a new one in the shared folder.

    There are as many ``buckets`` as shuffle partitions, and fewer for small logs.
    """
    spark = events.sparkSession
    path = path or fresh_path(spark, "token_log")
    tokens = numbered_tokens(events, vocab, max_len, heavy_keys(events, ["code"], ROWS_PER_TASK))
    tokens.write.parquet(f"{path}/tokens")
    tokens = spark.read.parquet(f"{path}/tokens")
    if buckets is None:
        buckets = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens.count() // BUCKET_TOKENS))
    parts = {"few": (tokens, ["subject_id"])}
    many = checkpointed(tokens.where(F.col("pos") == few_blocks * max_len).select("subject_id"))
    if not many.isEmpty():
        parts["few"] = (tokens.join(many, "subject_id", "left_anti"), ["subject_id"])
        parts["many"] = (tokens.join(many, "subject_id", "left_semi"), ["subject_id", "block"])
    for name, (part, keys) in parts.items():
        rows = _with_ends(_blocks(part, max_len), part, max_len).repartition(buckets, *keys)
        table = f"token_log_{uuid.uuid4().hex}"
        rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{path}/{name}").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")
    about = {"max_len": max_len, "buckets": buckets, "has_many": "many" in parts}
    # Written last: a log without it is not complete.
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
    return TokenLog(spark, path, **about)


def open_log(spark: SparkSession, path: str) -> TokenLog:
    """A log that ``build`` stored, perhaps in another session."""
    return TokenLog(spark, path, **json.loads(spark.read.text(f"{path}/about").first()["value"]))
