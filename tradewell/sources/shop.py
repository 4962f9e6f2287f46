"""The given star-schema tables, seen as the shop's customers, products and orders.

``raw_*`` frames have the shape of the raw inputs, with the dirt the refined layer must
clean (missing and padded texts, bad dates, repeated and missing keys). The other frames
have the refined shape directly: the given tables are clean, so no cleaning is repeated
in front of every aggregate, and filters reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewell.functions.numbers import cents, from_cents, half_up_div
from tradewell.functions.text import with_date_parts

CANCELLED_BELOW = 25000.0
ITEM_FIELDS = ("product_id", "product_name", "quantity", "unit_price", "item_total")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, c: str) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.col(c))


def _status() -> Column:
    return (
        F.when(F.col("o_totalprice") < CANCELLED_BELOW, "cancelled")
        .when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "processing")
        .otherwise("shipped")
    )


def _payment() -> Column:
    urgency = F.substring("o_orderpriority", 1, 1)
    return (
        F.when(urgency == "1", "credit_card")
        .when(urgency == "2", "debit_card")
        .when(urgency == "3", "pix")
        .when(urgency == "4", "boleto")
        .otherwise(" Pix ")
    )


def _unit_price() -> Column:
    return from_cents(
        half_up_div(cents(F.col("l_extendedprice")), F.col("l_quantity").cast("bigint"))
    )


# --- refined shape -----------------------------------------------------------


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        "n_nationkey",
        F.initcap("n_name").alias("city"),
        F.upper(F.substring("r_name", 1, 2)).alias("state"),
    )
    return (
        table(spark, sf_dir, "customer")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            _key("CUST", "c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            "city",
            "state",
        )
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        _key("PROD", "p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.initcap("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("stock_quantity"),
    )


def _refined_orders(source: DataFrame, status: Column) -> DataFrame:
    return with_date_parts(
        source.select(
            _key("ORD", "o_orderkey").alias("order_id"),
            _key("CUST", "o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            status.alias("status"),
            F.lower(F.trim(_payment())).alias("payment_method"),
            F.col("o_totalprice").alias("total_amount"),
        ),
        "order_date",
    )


def _completed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(
        (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") >= CANCELLED_BELOW)
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined_orders(table(spark, sf_dir, "orders"), _status())


def completed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with status completed, as a filter on the stored columns."""
    return _refined_orders(_completed_source(spark, sf_dir), F.lit("completed"))


def completed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item of a completed order; joined on the stored numeric keys."""
    done = _completed_source(spark, sf_dir).select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("order_date")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(done, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            _key("ORD", "l_orderkey").alias("order_id"),
            "order_date",
            _key("PROD", "l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            _unit_price().alias("unit_price"),
            F.col("l_extendedprice").alias("item_total"),
        )
    )


# --- raw shape ---------------------------------------------------------------


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw customers; ``load_no`` numbers the loads. The second load repeats every
    customer who has a debt, with a new city, and holds keyless rows."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region")
    base = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )
    key = F.col("c_custkey")
    first = base.select(
        _key("CUST", "c_custkey").alias("customer_id"),
        F.when(F.col("c_acctbal") > 9900, F.lit(None))
        .when(F.col("c_acctbal") > 9800, F.lit("  "))
        .otherwise(F.concat(F.lit("  "), F.lower("c_name"), F.lit(" "), F.col("c_mktsegment")))
        .alias("customer_name"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.concat(F.lit(" User"), key, F.lit("@Mail.COM")))
        .alias("email"),
        F.when(F.col("c_nationkey") != 3, F.concat(F.lower("n_name"), F.lit(" do sul "))).alias("city"),
        F.when(F.col("c_nationkey") != 5, F.concat(F.lit(" "), F.lower(F.substring("r_name", 1, 2))))
        .alias("state"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("2024-13-45"))
        .when(F.col("c_mktsegment") == "FURNITURE", F.lit(""))
        .otherwise(F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), F.col("c_nationkey")), "yyyy-MM-dd"))
        .alias("registration_date"),
        F.lit(1).alias("load_no"),
        "c_acctbal",
    )
    second = first.filter("c_acctbal < 0").select(
        F.when(F.col("c_acctbal") > -900, F.col("customer_id")).alias("customer_id"),
        "customer_name",
        "email",
        F.lit("cidade nova").alias("city"),
        "state",
        "registration_date",
        F.lit(2).alias("load_no"),
        "c_acctbal",
    )
    return first.unionByName(second).drop("c_acctbal")


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw products with missing, zero, negative and NaN prices and padded texts."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        _key("PROD", "p_partkey").alias("product_id"),
        F.when(size != 1, F.concat(F.lit(" "), F.col("p_name"), F.lit("  "))).alias("product_name"),
        F.when(size != 2, F.concat(F.lit(" "), F.lower("p_type"), F.lit(" & decoração "))).alias("category"),
        F.when(size == 3, F.lit(None))
        .when(size == 4, F.lit("NaN").cast("double"))
        .when(size == 5, F.lit(0.0))
        .when(size == 6, -F.col("p_retailprice"))
        .when(size == 7, F.lit(0.004))
        .otherwise(F.col("p_retailprice"))
        .cast("double")
        .alias("price"),
        F.when(size != 8, size).alias("stock_quantity"),
        F.when(size != 9, F.lit("2023-06-30")).otherwise(F.lit("30/06/2023")).alias("created_date"),
        F.lit(1).alias("load_no"),
    )


def raw_order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw orders without their items: mixed-case statuses, bad dates, a missing
    customer, and a later load that corrects every expensive order."""
    return _raw_order_headers(spark, sf_dir).drop("o_orderkey")


def _raw_order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_order_headers`` with the stored key of the order."""
    source = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    first = source.join(names, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        _key("ORD", "o_orderkey").alias("order_id"),
        F.when(price < 495000, _key("CUST", "o_custkey")).alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.when(price > 490000, F.lit("1998-02-31")).otherwise(day).alias("order_date"),
        F.when(price > 480000, F.concat(F.lit(" "), F.initcap(_status()))).otherwise(_status()).alias("status"),
        _payment().alias("payment_method"),
        price.alias("total_amount"),
        F.lit(1).alias("load_no"),
        "o_orderkey",
    )
    second = first.filter("total_amount > 450000").withColumns(
        {"total_amount": F.col("total_amount") / 2, "load_no": F.lit(2)}
    )
    return first.unionByName(second)


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of every raw order as rows of their own, keyed by ``(order_id, load_no)``.

    A load that repeats an order repeats its items, so both sides of an order come from the
    same load. Amounts of the order are on its header only.
    """
    headers = raw_order_headers(spark, sf_dir).select("order_id", "load_no")
    return _shop_items(spark, sf_dir).join(headers, "order_id").select(
        "order_id", "load_no", *ITEM_FIELDS
    )


def _shop_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return (
        table(spark, sf_dir, "lineitem")
        .join(names, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select(
            "l_orderkey",
            _key("ORD", "l_orderkey").alias("order_id"),
            _key("PROD", "l_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("l_quantity").cast("int").alias("quantity"),
            _unit_price().alias("unit_price"),
            F.col("l_extendedprice").alias("item_total"),
        )
    )


def nest_items(items: DataFrame, keys: Sequence[str] = ("order_id",)) -> DataFrame:
    """One row per order with the array of all its items, in the order of their values.

    The array is the result here, as in the order file, where an order with all its items is
    one record. Totals, counts and flat items are made from item rows, without an array.
    """
    item = F.struct(*ITEM_FIELDS)
    return items.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw orders with nested items, one row per order and load, as the order file has them.

    Items are nested and joined by the stored number, which is sorted faster than its text.
    """
    nested = nest_items(_shop_items(spark, sf_dir), ["l_orderkey"])
    headers = _raw_order_headers(spark, sf_dir)
    joined = headers.join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.drop("o_orderkey", "l_orderkey")
