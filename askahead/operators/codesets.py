"""Code universes: filtering, seeded sampling, complements and combined evaluation lists.

A code set is a list from a configuration or a table with a ``code`` column. Both are bounded by the
vocabulary, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askahead.functions import draw_key
from askahead.schemas import CODE_LIST
from askahead.session import checkpointed

CodeSet = list[str] | DataFrame

def codes_array(codes: CodeSet) -> Column:
    """The distinct codes as one array value; a table is read through a scalar subquery.

    For dense grids only, whose every prediction time gets a row per code anyway.
    """
    if isinstance(codes, list):
        return F.lit(sorted(set(codes)))
    return codes.agg(F.sort_array(F.collect_set("code")).alias("codes")).scalar()


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Distinct rows with their place from 0 in the given order, counted without gathering them in one task.

    Rows are cut into ranges; a range's offset is the number of rows in the ranges before it, and there are
    only as many ranges as shuffle partitions.
    """
    cut = checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        cut.withColumn("_nth", nth)
        .join(offsets, "_range")
        .withColumn(name, F.col("_offset") + F.col("_nth") - 1)
        .drop("_range", "_nth", "_offset")
    )


def codes_or_all(codes: CodeSet | None, events: DataFrame) -> CodeSet:
    """The given codes, or every code of the log."""
    return events.where(F.col("code").isNotNull()).select("code") if codes is None else codes


def codes_table(codes: CodeSet, spark: SparkSession) -> DataFrame:
    """A code set as a table with a ``code`` column."""
    return spark.createDataFrame([(c,) for c in codes], "code string") if isinstance(codes, list) else codes


def only_codes(rows: DataFrame, codes: CodeSet, on: str = "code") -> DataFrame:
    if isinstance(codes, list):
        return rows.where(F.col(on).isin(codes))
    return rows.join(codes.select(F.col("code").alias(on)).distinct(), on, "left_semi")


def code_universe(codes: DataFrame) -> DataFrame:
    return codes.select("code").distinct()


def code_list(spark: SparkSession, spec) -> DataFrame:
    """Rows (code, bucket, pos) from a flat list or from ``{"id": [...], "ood": [...]}``.

    Duplicates are kept. The structured form puts the ``id`` codes first.
    """
    if isinstance(spec, dict) and "codes" in spec:
        spec = spec["codes"]
    if isinstance(spec, (list, tuple)):
        tagged = [(c, None) for c in spec]
    elif isinstance(spec, dict):
        tagged = [(c, b) for b in ("id", "ood") for c in spec.get(b) or []]
    else:
        raise ValueError(f"expected a list of codes or id/ood lists, got {type(spec).__name__}")
    return spark.createDataFrame([(c, b, i) for i, (c, b) in enumerate(tagged)], CODE_LIST)


def concat_code_lists(id_codes: DataFrame, ood_codes: DataFrame, manual: DataFrame) -> DataFrame:
    """All three lists one after another, duplicates kept; ``bucket`` by membership in the ood list.

    A manual code that is not in the ood list counts as in-distribution.
    """
    lists = [df.select("code", "pos", F.lit(i).alias("list_no")) for i, df in enumerate((id_codes, ood_codes, manual))]
    every = lists[0].unionByName(lists[1]).unionByName(lists[2])
    return bucket_codes(every.where(F.col("code").isNotNull()), ood_codes)


def bucket_codes(rows: DataFrame, ood_codes: DataFrame) -> DataFrame:
    """Tag each row's code ``ood`` where it is in the list, else ``id``."""
    ood = ood_codes.select("code").distinct().withColumn("_ood", F.lit(True))
    return (
        rows.join(ood, "code", "left")
        .withColumn("bucket", F.when(F.col("_ood"), F.lit("ood")).otherwise(F.lit("id")))
        .drop("_ood")
    )


def is_time_code(code: Column | str = "code") -> Column:
    return (F.col(code) if isinstance(code, str) else code).contains("TIME")


def exclude_time_codes(codes: DataFrame) -> DataFrame:
    return code_universe(codes).where(~is_time_code())


def removed_time_codes(codes: DataFrame) -> DataFrame:
    return code_universe(codes).where(is_time_code())


def code_counts(codes: DataFrame) -> DataFrame:
    return code_universe(codes).agg(
        F.count("*").alias("n_codes"),
        F.count_if(is_time_code()).alias("n_time_codes"),
        F.count_if(~is_time_code()).alias("n_kept"),
    )


def _require(rows: DataFrame, n: int, available: Column) -> DataFrame:
    """Fail when fewer than ``n`` codes are there to draw."""
    short = F.concat(F.lit(f"cannot draw {n} codes from "), available.cast("string"))
    return rows.where(F.when(available < n, F.raise_error(short).cast("boolean")).otherwise(F.lit(True)))


def sample_codes(codes: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` codes without replacement; ``pos`` is the order of the draw."""
    universe = code_universe(codes)
    keyed = universe.withColumn("_key", draw_key(seed, "code"))
    drawn = numbered(keyed, ["_key", "code"], "pos").where(F.col("pos") < n)
    population = universe.agg(F.count("*")).scalar()
    return _require(drawn, n, population).select("code", F.col("pos").cast("int").alias("pos"))


def sample_codes_repeated(codes: DataFrame, n: int, repeats: int, seed: int) -> DataFrame:
    """``repeats`` independent draws of ``n`` codes; columns (draw, code, pos)."""
    universe = code_universe(codes)
    spread = universe.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    by_draw = Window.partitionBy("draw").orderBy(draw_key(seed, "code", "draw"), "code")
    drawn = spread.withColumn("pos", F.row_number().over(by_draw) - 1).where(F.col("pos") < n)
    return _require(drawn, n, universe.agg(F.count("*")).scalar()).select("draw", "code", "pos")


def ood_complement(codes: DataFrame, id_codes: DataFrame) -> DataFrame:
    return code_universe(codes).join(id_codes.select("code"), "code", "left_anti")


def eval_code_sets(codes: DataFrame, id_codes: DataFrame, n_id: int, n_ood: int, seed: int) -> DataFrame:
    """Seeded samples of the training codes and of their complement; columns (code, bucket, pos)."""
    inside = sample_codes(id_codes, n_id, seed).withColumn("bucket", F.lit("id"))
    outside = sample_codes(ood_complement(codes, id_codes), n_ood, seed).withColumn("bucket", F.lit("ood"))
    return inside.unionByName(outside)


def available_codes(wanted: DataFrame, rows: DataFrame, on: str = "query") -> DataFrame:
    """Wanted codes that have data, and those that do not, as one table with ``available``."""
    have = rows.select(F.col(on).alias("code")).distinct().withColumn("_have", F.lit(True))
    return wanted.join(have, "code", "left").select(
        *wanted.columns, F.coalesce(F.col("_have"), F.lit(False)).alias("available")
    )
