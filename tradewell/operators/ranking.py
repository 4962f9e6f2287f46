"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SAMPLES_PER_BUCKET = 16
_MAX_BUCKETS = 8192
_LAST = 2**63 - 1


def top_by_rank(df: DataFrame, value: str, key: str, k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows with their rank; Spark plans this as a distributed top-k."""
    order = W.orderBy(F.col(value).desc_nulls_last(), F.col(key))
    return df.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= k)


def _bucket(bounds: Column, x: Column, buckets: int) -> Column:
    """How many of the sorted ``bounds`` are <= ``x``, by binary search."""
    steps = []
    step = buckets // 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda at, s: F.when(F.get(bounds, at + s - 1) <= x, at + s).otherwise(at),
    )


def global_rank(
    df: DataFrame,
    value: str,
    key: str,
    out: str = "rank",
    buckets: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add ``row_number`` over (``value`` descending, ``key``) of the whole table.

    The rows are cut into ranges of (value, key), each range is numbered on its own, and
    the sizes of the ranges before it are added. The cuts are quantiles of 16 keys per
    range, those with the smallest hash, so they are the same whenever a task runs
    again, and tied values are cut by key, so a value shared by a third of the rows is
    still spread. Only those keys and the range sizes meet in one task; they decide how
    the work is dealt, never which rows are ranked.

    ``value`` must be a whole number; ``key`` should be unique. ``source`` is a table with
    the same keys and values that is cheaper to read than ``df``, for a second rank.
    """
    source = df if source is None else source
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(_MAX_BUCKETS, 1 << max(1, (buckets - 1).bit_length()))
    at = F.struct(F.coalesce(-F.col(value).cast("bigint"), F.lit(_LAST)).alias("v"), F.col(key).alias("k"))

    picked = (
        source.select(at.alias("at"))
        .orderBy(F.xxhash64("at.k"), "at")
        .limit(_SAMPLES_PER_BUCKET * buckets)
        .agg(F.sort_array(F.collect_list("at")).alias("s"))
    )
    cuts = picked.select(
        F.transform(
            F.sequence(F.lit(1), F.lit(buckets - 1)),
            lambda i: F.get(F.col("s"), (i * F.size("s") / F.lit(buckets)).cast("int")),
        )
    ).scalar()

    def ranged(rows: DataFrame) -> DataFrame:
        cut = rows.withColumn("_cuts", cuts)
        return cut.withColumn("_bucket", _bucket(F.col("_cuts"), at, buckets)).drop("_cuts")

    before = (
        ranged(source)
        .groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select("_bucket", "_before")
    )
    order = W.partitionBy("_bucket").orderBy(F.col(value).desc_nulls_last(), F.col(key))
    return (
        ranged(df)
        .withColumn("_no", F.row_number().over(order))
        .join(F.broadcast(before), "_bucket")
        .withColumn(out, (F.col("_before") + F.col("_no")).cast("bigint"))
        .drop("_bucket", "_no", "_before")
    )
