"""All registered queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradewell.plans import layered, layered_sql, shop_queries, shop_sql, text_queries, text_sql

Query = Callable[[SparkSession, str], DataFrame]

# Queries take the session as it is; ``config.build_session`` and ``config.tune`` have the
# settings that split hot keys even at the price of a shuffle.
QUERIES: dict[str, Query] = {**shop_queries.QUERIES, **text_queries.QUERIES, **layered.QUERIES}
SQL = {**shop_sql.SQL, **text_sql.SQL, **layered_sql.SQL}
