"""Late loads: only the partitions that a load touches are read whole and written again.

Loads are merged in the order in which they came: a key of a load takes the place of every
version of it that the table holds. A load that was merged, or only in part before a failure,
can be merged again with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewell.operators import gold
from tradewell.sources.io import drop_partitions, materialize, replace_partitions

MONTH = "order_year_month"


def is_one_of(name: str, values: Sequence[Any]) -> Column:
    """Whether a column has one of ``values``, a missing value included if it is among them; a
    filter on a partition column that reads no other partition."""
    found = F.col(name).isin([v for v in values if v is not None])
    return found | F.col(name).isNull() if None in values else found


def is_none_of(name: str, values: Sequence[Any]) -> Column:
    return ~F.coalesce(is_one_of(name, values), F.lit(False))


def _values(df: DataFrame, name: str) -> list[Any]:
    return [r[0] for r in df.select(name).distinct().collect()]


def merge_load(
    spark: SparkSession, table: str, clean: DataFrame, keys: DataFrame, key: str, partition: str
) -> list[Any]:
    """Merge a load into a partitioned table; the values of the partitions that were touched.

    ``clean`` are the rows of the load that the table takes, one for each key, ``keys`` all keys
    of the load: a key whose new version was cleaned away leaves the table. Of partitions that
    are not touched only the key is read. A partition of which nothing stays is dropped. On the
    driver are the touched values, at most one for each partition of the table and of the load.
    A null key is no key; a load without keys and rows touches nothing.
    """
    held = spark.table(table)
    clean = materialize(clean.select(*held.columns), "late-clean")
    keys = materialize(keys.select(key).filter(F.col(key).isNotNull()).distinct(), "late-keys")
    left = held.join(keys, key, "left_semi").select(partition)
    touched = _values(left.unionByName(clean.select(partition)), partition)
    if not touched:
        return []
    kept = held.filter(is_one_of(partition, touched)).join(keys, key, "left_anti").select(*held.columns)
    merged = materialize(kept.unionByName(clean), "late-merged")
    filled = set(_values(merged, partition))
    replace_partitions(merged, table, [partition])
    drop_partitions(spark, table, partition, [v for v in touched if v not in filled])
    return touched


def refresh_months(monthly: DataFrame, orders: DataFrame, months: Sequence[Any]) -> DataFrame:
    """The figures of ``gold.revenue_monthly`` after a load: those of the touched months from the
    orders of these months, all others as they were."""
    if not months:
        return monthly
    again = gold.revenue_monthly(orders.filter(is_one_of(MONTH, months)))
    return monthly.filter(is_none_of(MONTH, months)).unionByName(again)
