"""Aggregated layer: revenue by month, customers, products and KPIs.

Amounts are summed exactly and rounded once (see ``functions.numbers``). Every aggregate is a
grouped sum with a map-side partial, so a hot key sends one row per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewell import fixed_values as fv
from tradewell.functions.numbers import (
    cents_avg,
    cents_sum,
    exact,
    from_cents,
    half_up_div,
    money_avg,
    money_sum,
    round_money,
    whole_cents,
)
from tradewell.operators.ranking import global_rank
from tradewell.sources.io import materialize


def completed_only(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status") == fv.REVENUE_STATUS)


ITEM_FIELDS = ("product_id", "product_name", "quantity", "unit_price", "item_total")


def flatten_items(orders: DataFrame, fields: Sequence[str] = ITEM_FIELDS) -> DataFrame:
    """One row per item of the nested orders, with the named item fields.

    Only those fields are zipped and exploded, so the scan reads only them; exploding
    the item struct itself would read every field of it.
    """
    zipped = F.arrays_zip(*[F.col(f"items.{f}").alias(f) for f in fields])
    return orders.select("order_id", "order_date", F.explode(zipped).alias("item")).select(
        "order_id", "order_date", *[F.col(f"item.{f}").alias(f) for f in fields]
    )


def enrich(facts: DataFrame, dim: DataFrame, on: str, cols: Sequence[str]) -> DataFrame:
    """Left join of attributes. Spark broadcasts the dimension only when its measured
    size allows, and splits skewed keys at run time otherwise."""
    return facts.join(dim.select(on, *cols), on, "left")


def revenue_monthly(orders: DataFrame) -> DataFrame:
    amount = F.col("total_amount")
    return (
        completed_only(orders)
        .groupBy("order_year_month")
        .agg(
            money_sum(amount).alias("total_revenue"),
            F.count("order_id").alias("total_orders"),
            money_avg(amount).alias("avg_ticket"),
            round_money(F.min(amount)).alias("min_order_value"),
            round_money(F.max(amount)).alias("max_order_value"),
            F.countDistinct("customer_id").alias("unique_customers"),
        )
    )


def with_growth(monthly: DataFrame, calendar_gaps: bool = False) -> DataFrame:
    """Growth in percent on the previous month present, 0 for the first and after a
    month without revenue. With ``calendar_gaps`` a missing month gives 0 as well.

    The window is over one row per month, so it is small whatever the number of orders.
    """
    months = W.orderBy("order_year_month")
    before = F.lag("total_revenue").over(months)
    if calendar_gaps:
        month = F.to_date(F.concat("order_year_month", F.lit("-01")))
        adjacent = F.lag(month).over(months) == F.add_months(month, -1)
        before = F.when(adjacent, before)
    growth = (F.col("total_revenue") - F.col("_before")) / F.col("_before") * 100
    return (
        monthly.withColumn("_before", before)
        .withColumn("growth_pct", F.when(F.col("_before") > 0, F.round(growth, 2)).otherwise(0.0))
        .drop("_before")
    )


def revenue_summary(orders: DataFrame, calendar_gaps: bool = False) -> DataFrame:
    return with_growth(revenue_monthly(orders), calendar_gaps)


def customer_totals(orders: DataFrame) -> DataFrame:
    amount = F.col("total_amount")
    return (
        completed_only(orders)
        .groupBy("customer_id")
        .agg(
            cents_sum(amount).alias("_revenue"),
            F.count("order_id").alias("total_orders"),
            money_avg(amount).alias("avg_ticket"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
        )
    )


def named_revenue(df: DataFrame) -> DataFrame:
    return df.withColumn("total_revenue", from_cents(F.col("_revenue"))).drop("_revenue")


def top_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Every customer with completed orders, ranked by revenue, ties by id.

    The rank reads the totals three times, so they are written once before it.
    """
    totals = materialize(customer_totals(orders), "customer_totals")
    ranked = global_rank(totals, "_revenue", "customer_id", "rank")
    return enrich(
        named_revenue(ranked), customers, "customer_id", ["customer_name", "city", "state"]
    )


def product_totals(items: DataFrame) -> DataFrame:
    """Per product; ``num_orders`` counts item rows and the price mean is unweighted."""
    return items.groupBy("product_id").agg(
        F.sum("quantity").alias("total_quantity"),
        cents_sum(F.col("item_total")).alias("_revenue"),
        F.count("order_id").alias("num_orders"),
        money_avg(F.col("unit_price")).alias("avg_unit_price"),
    )


def top_products(items: DataFrame, products: DataFrame) -> DataFrame:
    """Every product sold, ranked by revenue and by quantity, ties by id."""
    totals = materialize(product_totals(items), "product_totals")
    ranked = global_rank(totals, "_revenue", "product_id", "rank_revenue")
    ranked = global_rank(ranked, "total_quantity", "product_id", "rank_quantity", source=totals)
    return enrich(named_revenue(ranked), products, "product_id", ["product_name", "category"])


def _order_figures(grouped):
    return grouped.agg(
        F.count("order_id").alias("total_orders"),
        money_sum(F.col("total_amount")).alias("total_revenue"),
        money_avg(F.col("total_amount")).alias("avg_ticket"),
    )


def tag_kpi(df: DataFrame, dim_col: str, kpi_type: str) -> DataFrame:
    return df.select(
        F.col(dim_col).alias("dimension_value"),
        "total_orders",
        "total_revenue",
        "avg_ticket",
        F.lit(kpi_type).alias("kpi_type"),
    )


def kpi_by(orders: DataFrame, dim_col: str, kpi_type: str | None = None) -> DataFrame:
    return tag_kpi(
        _order_figures(orders.groupBy(dim_col)), dim_col, kpi_type or fv.KPI_TYPES[dim_col]
    )


def kpi_by_payment(orders: DataFrame) -> DataFrame:
    return kpi_by(completed_only(orders), "payment_method")


def kpi_by_status(orders: DataFrame) -> DataFrame:
    return kpi_by(orders, "status")


def kpi_by_category(items: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct orders, revenue and mean line total per category.

    The lines are first reduced to one row per (order, category), which both counts the
    orders exactly and keeps a hot category from gathering its lines in one task.
    """
    amount = exact(F.col("item_total"))
    per_order = (
        enrich(items, products, "product_id", ["category"])
        .groupBy("category", "order_id")
        .agg(F.sum(amount).alias("_sum"), F.count(amount).alias("_lines"))
    )
    per_category = per_order.groupBy("category").agg(
        F.count("order_id").alias("total_orders"),
        from_cents(whole_cents(F.sum("_sum"))).alias("total_revenue"),
        from_cents(cents_avg(F.sum("_sum"), F.sum("_lines"))).alias("avg_ticket"),
    )
    return tag_kpi(per_category, "category", fv.KPI_TYPES["category"])


def union_kpis(*parts: DataFrame) -> DataFrame:
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def headline_of(customer_totals: DataFrame, units: Column) -> DataFrame:
    """The headline row from totals per customer and a scalar number of units sold."""
    revenue, orders = F.sum("_revenue"), F.sum("total_orders")
    row = customer_totals.agg(
        from_cents(revenue).alias("total_revenue"),
        F.coalesce(orders, F.lit(0)).alias("total_orders"),
        F.count("customer_id").alias("total_customers"),
        from_cents(half_up_div(revenue, orders)).alias("_ticket"),
    )
    return row.select(
        "total_revenue",
        "total_orders",
        "total_customers",
        units.alias("total_products_sold"),
        F.when(F.col("total_orders") > 0, F.col("_ticket")).otherwise(0.0).alias("avg_ticket"),
    )


def kpi_headline(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row: revenue, orders, customers, units and the mean order of all time.

    Orders and items are two aggregates; customers are counted through one row per
    customer, spread over the cluster.
    """
    return headline_of(customer_totals(orders), items.agg(F.sum("quantity")).scalar())
