"""Refined layer: clean customers, products and orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewell import fixed_values as fv
from tradewell.functions.numbers import round_money
from tradewell.functions.text import code_text, lower_text, parse_date, title_text, with_date_parts
from tradewell.operators.quality import dedupe_latest

METADATA = ("_ingestion_timestamp", "_source_file")


def stamp(df: DataFrame, name: str = "_processed_timestamp") -> DataFrame:
    return df.withColumn(name, F.current_timestamp())


def drop_metadata(df: DataFrame) -> DataFrame:
    return df.drop(*METADATA)


def require_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def in_domain(
    df: DataFrame, name: str, values: Sequence[str], normalize_first: bool = False
) -> DataFrame:
    """Rows whose value is one of ``values``, compared as stored unless asked otherwise."""
    value = lower_text(F.col(name)) if normalize_first else F.col(name)
    return df.filter(value.isin(*values))


def fill_defaults(
    df: DataFrame, defaults: Mapping[str, Any], blank_as_null: bool = False
) -> DataFrame:
    """Fill missing values; NaN counts as missing, a blank text only when asked."""
    if blank_as_null:
        texts = [n for n, t in df.dtypes if t == "string" and n in defaults]
        df = df.withColumns({n: F.when(F.trim(n) != "", F.col(n)) for n in texts})
    return df.fillna(dict(defaults))


def clamp_min(df: DataFrame, name: str, floor: float, replacement: float) -> DataFrame:
    c = F.col(name)
    return df.withColumn(name, F.when(c <= floor, F.lit(replacement)).otherwise(c))


def _latest(order_cols: Sequence[str], df: DataFrame) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in order_cols if c in df.columns]


def silver_customers(
    bronze: DataFrame,
    latest_by: Sequence[str] = ("_ingestion_timestamp",),
    blank_as_null: bool = False,
) -> DataFrame:
    # Keyless rows go first: they are dropped anyway and would share one key.
    keyed = require_keys(bronze, ["customer_id"])
    single = dedupe_latest(keyed, ["customer_id"], _latest(latest_by, keyed))
    filled = fill_defaults(single, fv.CUSTOMER_DEFAULTS, blank_as_null)
    return drop_metadata(
        filled.withColumns(
            {
                "customer_name": title_text(F.col("customer_name")),
                "city": title_text(F.col("city")),
                "state": code_text(F.col("state")),
                "email": lower_text(F.col("email")),
                "registration_date": parse_date(F.col("registration_date")),
            }
        )
    )


def silver_products(
    bronze: DataFrame,
    latest_by: Sequence[str] = ("_ingestion_timestamp",),
    blank_as_null: bool = False,
) -> DataFrame:
    keyed = require_keys(bronze, ["product_id"])
    single = dedupe_latest(keyed, ["product_id"], _latest(latest_by, keyed))
    filled = fill_defaults(single, fv.PRODUCT_DEFAULTS, blank_as_null)
    typed = filled.withColumns(
        {
            "product_name": F.trim("product_name"),
            "category": title_text(F.col("category")),
            "price": round_money(F.col("price")),
            "stock_quantity": F.col("stock_quantity").cast("int"),
            "created_date": parse_date(F.col("created_date")),
        }
    )
    return drop_metadata(clamp_min(typed, "price", 0.0, fv.PRICE_FLOOR))


def silver_orders(
    bronze: DataFrame,
    latest_by: Sequence[str] = ("_ingestion_timestamp",),
    normalize_first: bool = False,
) -> DataFrame:
    """Clean orders, one row per order, with their nested items if they have them.

    ``num_items`` is NULL for an order without an item array. The status is checked as
    stored, before lower-casing, but after the newest version of the order was chosen.
    """
    keyed = require_keys(bronze, ["order_id"])
    single = dedupe_latest(keyed, ["order_id"], _latest(latest_by, keyed))
    owned = require_keys(single, ["customer_id"])
    valid = in_domain(owned, "status", fv.ORDER_STATUSES, normalize_first)
    clean = valid.withColumns(
        {
            "status": lower_text(F.col("status")),
            "payment_method": lower_text(F.col("payment_method")),
            "order_date": parse_date(F.col("order_date")),
            "total_amount": round_money(F.col("total_amount")),
        }
    )
    if "items" in clean.columns:
        clean = clean.withColumn("num_items", F.size("items"))
    return drop_metadata(with_date_parts(clean, "order_date"))


def order_items(orders: DataFrame, items: DataFrame, load: str = "load_no") -> DataFrame:
    """The item rows of clean orders: those of the load whose header was kept."""
    kept = orders.select("order_id", load, "order_date")
    return items.join(kept, ["order_id", load])


def with_item_count(orders: DataFrame, items: DataFrame, load: str = "load_no") -> DataFrame:
    """``num_items`` of orders whose items are rows; NULL for an order without items."""
    counts = items.groupBy("order_id", load).agg(F.count("*").cast("int").alias("num_items"))
    return orders.join(counts, ["order_id", load], "left")


def silver_findings(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Rows the cleaning kept with a doubtful value: orders without a readable date and
    products at the price floor."""
    undated = orders.filter(F.col("order_date").isNull()).select(
        F.lit("orders").alias("table_name"),
        F.lit("order_date missing").alias("finding"),
        F.col("order_id").alias("key"),
    )
    floored = products.filter(F.col("price") == fv.PRICE_FLOOR).select(
        F.lit("products").alias("table_name"),
        F.lit("price at floor").alias("finding"),
        F.col("product_id").alias("key"),
    )
    return undated.unionByName(floored)
