"""Rows of the aggregated tables as sentences, built as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewell import fixed_values as fv
from tradewell.functions.numbers import fixed_text, float_text
from tradewell.functions.ptbr import format_brl
from tradewell.functions.text import fill_template
from tradewell.operators.silver import stamp


def _money(*names: str) -> dict[str, Column]:
    return {n: format_brl(F.col(n)) for n in names}


def _documents(
    df: DataFrame,
    doc_type: str,
    key: Sequence[str],
    template: str,
    values: dict[str, Column],
    null_text: str,
) -> DataFrame:
    doc_id = F.concat_ws(
        "_", F.lit(doc_type), *[F.coalesce(F.col(k).cast("string"), F.lit(null_text)) for k in key]
    )
    return df.select(
        doc_id.alias("doc_id"),
        F.lit(doc_type).alias("doc_type"),
        fill_template(template, values, null_text).alias("text"),
    )


def customer_docs(df: DataFrame, variant: str = "long", null_text: str = "None") -> DataFrame:
    """``long`` needs the ranked customers, ``short`` only totals and names."""
    template = fv.CUSTOMER_SENTENCE if variant == "long" else fv.CUSTOMER_SENTENCE_SHORT
    money = _money("total_revenue", "avg_ticket")
    return _documents(df, "customer", ["customer_id"], template, money, null_text)


def product_docs(df: DataFrame, variant: str = "long", null_text: str = "None") -> DataFrame:
    """``short`` needs the list price of the product as ``price``."""
    if variant == "long":
        template, money = fv.PRODUCT_SENTENCE, _money("avg_unit_price", "total_revenue")
    else:
        template, money = fv.PRODUCT_SENTENCE_SHORT, _money("price", "total_revenue")
    return _documents(df, "product", ["product_id"], template, money, null_text)


def revenue_docs(df: DataFrame, variant: str = "long", null_text: str = "None") -> DataFrame:
    money = _money("total_revenue", "avg_ticket", "min_order_value", "max_order_value")
    growth = F.col("growth_pct")
    if variant == "long":
        values = {**money, "growth_pct": float_text(growth)}
        return _documents(df, "revenue", ["order_year_month"], fv.MONTH_SENTENCE, values, null_text)
    values = {
        **money,
        "growth_pct": fixed_text(growth, 1),
        "period": F.col("order_year_month"),
    }
    return _documents(
        df, "revenue", ["order_year_month"], fv.PERIOD_SENTENCE_SHORT, values, null_text
    )


def kpi_docs(df: DataFrame, null_text: str = "None") -> DataFrame:
    money = _money("total_revenue", "avg_ticket")
    return _documents(df, "kpi", ["kpi_type", "dimension_value"], fv.KPI_SENTENCE, money, null_text)


def corpus(*parts: DataFrame) -> DataFrame:
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def stamped(docs: DataFrame) -> DataFrame:
    return stamp(docs, "_created_timestamp")


def docs_by_type(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_type").agg(F.count("*").alias("documents"))
