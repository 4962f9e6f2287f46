"""Queries over customers, products and orders: cleaning, checks, aggregates, serving."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tradewell import fixed_values as fv
from tradewell.config import LayerStep, scratch_root
from tradewell.functions.numbers import cents, plain_number_text
from tradewell.functions.ptbr import format_brl, parse_brl, slug
from tradewell.functions.text import (
    code_text,
    lower_text,
    parse_date,
    title_text,
    with_date_parts,
)
from tradewell.operators import gold, quality, serving, silver
from tradewell.operators.ranking import global_rank, top_by_rank
from tradewell.sources import io, json_arrays, schemas, shop


def _text_of_items(items: str) -> F.Column:
    """Nested items as text, for comparison with another engine."""
    return F.array_join(
        F.transform(
            items,
            lambda i: F.concat_ws(
                "|",
                i["product_id"],
                i["product_name"],
                i["quantity"].cast("string"),
                cents(i["unit_price"]).cast("string"),
                cents(i["item_total"]).cast("string"),
            ),
        ),
        ";",
    )


# --- scans, sinks ------------------------------------------------------------


def bronze_customers(spark: SparkSession, sf: str) -> DataFrame:
    return io.add_ingestion_metadata(shop.raw_customers(spark, sf), "customers.json").drop(
        "_ingestion_timestamp"
    )


def _nested_rows(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_id",
        "load_no",
        "customer_id",
        "customer_name",
        "order_date",
        "status",
        "payment_method",
        "total_amount",
        F.size("items").alias("num_items"),
        _text_of_items("items").alias("items_text"),
    )


def bronze_orders_nested(spark: SparkSession, sf: str) -> DataFrame:
    return _nested_rows(shop.raw_orders(spark, sf))


def bronze_orders_array_files(spark: SparkSession, sf: str) -> DataFrame:
    """Nested orders scanned from files that hold one JSON array each, with the declared schema. The
    files are compressed, so they are kept small enough for a task."""
    path = f"{scratch_root(spark)}/orders-arrays-{uuid.uuid4().hex}"
    json_arrays.write_json_arrays(shop.raw_orders(spark, sf), path, "gzip", 32 * 2**20)
    loads = StructType([*schemas.ORDERS.fields, StructField("load_no", IntegerType())])
    good, _ = io.split_corrupt(json_arrays.read_json_array(spark, path, loads, keep_corrupt=True))
    return _nested_rows(good)


def _written(spark: SparkSession, df: DataFrame, stem: str, partition_by=()) -> DataFrame:
    name = f"{stem}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{name}"
    return io.write_table(df, name, partition_by=partition_by, path=path)


def sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, gold.revenue_summary(shop.completed_orders(spark, sf)), "revenue_summary")


def sink_partitioned_month(spark: SparkSession, sf: str) -> DataFrame:
    orders = shop.orders(spark, sf).select("order_id", "total_amount", "status", "order_year_month")
    table = _written(spark, orders, "orders_by_month", ["order_year_month"])
    return table.groupBy("order_year_month").agg(
        F.count("*").alias("rows"), F.sum(cents(F.col("total_amount"))).alias("total_cents")
    )


def sql_adhoc(spark: SparkSession, sf: str) -> DataFrame:
    return io.run_sql(
        spark,
        """SELECT status, payment_method, count(*) AS total_orders,
                  sum(CAST(rint(total_amount * 100) AS BIGINT)) AS total_cents
           FROM {orders} WHERE order_date >= :since GROUP BY status, payment_method""",
        args={"since": "1997-01-01"},
        orders=shop.orders(spark, sf),
    )


def _kpi_chart(spark: SparkSession, sf: str) -> DataFrame:
    """Two charts per KPI breakdown and one over the months, as points."""
    kpis = _kpis(spark, sf)
    months = gold.revenue_monthly(shop.completed_orders(spark, sf))
    # Both charts of a KPI row come from that row, so the KPIs are computed once.
    both = F.array(
        F.struct(
            F.concat(F.lit("Receita por  "), "kpi_type").alias("title"),
            F.col("dimension_value").alias("x"),
            F.col("total_revenue").alias("y"),
        ),
        F.struct(
            F.concat(F.lit("Quantidade de pedidos por "), "kpi_type").alias("title"),
            F.col("dimension_value").alias("x"),
            F.col("total_orders").cast("double").alias("y"),
        ),
    )
    monthly = months.select(
        F.lit("Receita Mensal").alias("title"),
        F.col("order_year_month").alias("x"),
        F.col("total_revenue").alias("y"),
    )
    return kpis.select(F.explode(both).alias("p")).select("p.*").unionByName(monthly)


def _brand_chart(spark: SparkSession, sf: str) -> DataFrame:
    """Stock per brand, with a missing label and labels that hold quotes."""
    size = F.col("p_size")
    label = F.when(size == 2, F.concat(F.lit('"'), "p_brand", F.lit('"'))).when(size != 1, F.col("p_brand"))
    stock = shop.table(spark, sf, "part").groupBy(label.alias("x")).agg(F.sum("p_size").cast("double").alias("y"))
    return stock.select(F.lit("Estoque por marca").alias("title"), "x", "y")


def export_ptbr_csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    charts = _kpi_chart(spark, sf).unionByName(_brand_chart(spark, sf))
    lines = io.csv_lines(charts, "x", "y")
    return lines.select(
        F.concat(slug(F.col("title"), fv.CSV_FILE_NAME), F.lit(".csv")).alias("file_name"), "line"
    )


def chart_series(spark: SparkSession, sf: str) -> DataFrame:
    return serving.chart_series(_kpi_chart(spark, sf))


# --- cleaning ----------------------------------------------------------------


def silver_customers(spark: SparkSession, sf: str) -> DataFrame:
    bronze = io.add_ingestion_metadata(shop.raw_customers(spark, sf), "customers.json")
    return silver.silver_customers(bronze, ["load_no"])


def silver_products(spark: SparkSession, sf: str) -> DataFrame:
    bronze = io.add_ingestion_metadata(shop.raw_products(spark, sf), "products.json")
    return silver.silver_products(bronze, ["load_no"])


def silver_orders(spark: SparkSession, sf: str) -> DataFrame:
    bronze = io.add_ingestion_metadata(shop.raw_orders(spark, sf), "orders.json")
    clean = silver.silver_orders(bronze, ["load_no"])
    return clean.withColumn("items", _text_of_items("items")).withColumnRenamed("items", "items_text")


def silver_findings(spark: SparkSession, sf: str) -> DataFrame:
    return silver.silver_findings(
        silver.silver_orders(shop.raw_order_headers(spark, sf), ["load_no"]),
        silver.silver_products(shop.raw_products(spark, sf), ["load_no"]),
    )


def dedupe_latest(spark: SparkSession, sf: str) -> DataFrame:
    raw = shop.raw_order_headers(spark, sf)
    return quality.dedupe_latest(raw, ["order_id"], [F.desc("load_no")])


def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return shop.raw_customers(spark, sf).select(
        "customer_id",
        "load_no",
        title_text(F.col("customer_name")).alias("title"),
        code_text(F.col("state")).alias("code"),
        lower_text(F.col("email")).alias("lowered"),
    )


def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    raw = shop.raw_order_headers(spark, sf)
    dated = raw.select("order_id", "load_no", parse_date(F.col("order_date")).alias("order_date"))
    return with_date_parts(dated, "order_date")


def standardize_columns(spark: SparkSession, sf: str) -> DataFrame:
    source = shop.table(spark, sf, "customer")
    return quality.standardize_column_names(
        source.toDF("CustomerKey", "HTTPServer Name", "nation-key", "preço", "__Market  Segment__")
    )


def order_items_flat(spark: SparkSession, sf: str) -> DataFrame:
    """Items of the completed refined orders, as rows from the start."""
    done = gold.completed_only(silver.silver_orders(shop.raw_order_headers(spark, sf), ["load_no"]))
    return silver.order_items(done, shop.raw_items(spark, sf)).select(
        "order_id", "order_date", *shop.ITEM_FIELDS
    )


# --- checks ------------------------------------------------------------------


def dq_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    raw = shop.raw_customers(spark, sf)
    lines = shop.table(spark, sf, "lineitem")
    return quality.validate_no_duplicates(raw, ["customer_id"], "customers").unionByName(
        quality.validate_no_duplicates(lines, ["l_orderkey", "l_linenumber"], "lineitem")
    )


def dq_nulls(spark: SparkSession, sf: str) -> DataFrame:
    customers = shop.raw_customers(spark, sf)
    orders = shop.raw_order_headers(spark, sf)
    return quality.validate_no_nulls(
        customers, ["customer_id", "customer_name", "email"], "customers"
    ).unionByName(
        quality.validate_no_nulls(
            orders, ["order_id", "customer_id", "order_date", "total_amount"], "orders"
        )
    )


_FLOORS = {"customer": 50, "part": 30, "orders": 500, "nation": 500}


def dq_min_records(spark: SparkSession, sf: str) -> DataFrame:
    checks = [
        quality.validate_record_count(shop.table(spark, sf, name), name, floor)
        for name, floor in _FLOORS.items()
    ]
    return gold.union_kpis(*checks)


def dq_types(spark: SparkSession, sf: str) -> DataFrame:
    expected = {
        "order_date": "date",
        "total_amount": "double",
        "order_year": "int",
        "order_id": "bigint",
        "coupon": "string",
    }
    clean = silver.silver_orders(shop.raw_order_headers(spark, sf), ["load_no"])
    return quality.check_types(clean, expected, "orders")


def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    return quality.table_profile(shop.table(spark, sf, "orders"), "orders")


def layer_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status over named tables. The raw orders carry load times, one table is missing, and the
    files of the document table are not what its schema says."""
    broken = f"{scratch_root(spark)}/broken-{uuid.uuid4().hex}"
    shop.table(spark, sf, "nation").select("n_name").write.text(broken)
    loaded = F.try_to_timestamp("order_date", F.lit("yyyy-MM-dd"))
    tables = {
        "tw_bronze_customers": shop.raw_customers(spark, sf),
        "tw_bronze_products": shop.raw_products(spark, sf),
        "tw_bronze_orders": shop.raw_order_headers(spark, sf).withColumn("_ingestion_timestamp", loaded),
        "tw_silver_customers": shop.customers(spark, sf),
        "tw_gold_revenue": gold.revenue_summary(shop.completed_orders(spark, sf)),
        "tw_gold_kpis": _kpis(spark, sf),
        "tw_documents": spark.read.schema("doc_id string, text string").parquet(broken),
    }
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    steps = [
        LayerStep("01_bronze", "raw", ("tw_bronze_customers", "tw_bronze_products", "tw_bronze_orders")),
        LayerStep("02_silver", "refined", ("tw_silver_customers",)),
        LayerStep("03_gold", "aggregated", ("tw_gold_revenue", "tw_gold_kpis", "tw_gold_missing")),
        LayerStep("04_documents", "documents", ("tw_documents",)),
        LayerStep("05_chat", "index", ()),
    ]
    status = quality.layer_status(spark, steps)
    for name in tables:
        spark.catalog.dropTempView(name)
    return status


# --- aggregates --------------------------------------------------------------


def gold_revenue_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return gold.revenue_monthly(shop.completed_orders(spark, sf))


def gold_revenue_summary(spark: SparkSession, sf: str) -> DataFrame:
    return gold.revenue_summary(shop.completed_orders(spark, sf))


def gold_top_customers(spark: SparkSession, sf: str) -> DataFrame:
    return gold.top_customers(shop.completed_orders(spark, sf), shop.customers(spark, sf))


def gold_top_products(spark: SparkSession, sf: str) -> DataFrame:
    return gold.top_products(shop.completed_items(spark, sf), shop.products(spark, sf))


def _customer_totals(spark: SparkSession, sf: str) -> DataFrame:
    return gold.customer_totals(shop.completed_orders(spark, sf))


def _product_totals(spark: SparkSession, sf: str) -> DataFrame:
    return gold.product_totals(shop.completed_items(spark, sf))


def global_rank_distributed(spark: SparkSession, sf: str) -> DataFrame:
    # Prices in steps of a thousand: many orders share a value, so ties are cut by key.
    orders = shop.orders(spark, sf).select(
        "order_id", F.floor(F.col("total_amount") / 1000).alias("thousands")
    )
    return global_rank(orders, "thousands", "order_id")


def top10_customers(spark: SparkSession, sf: str) -> DataFrame:
    best = top_by_rank(_customer_totals(spark, sf), "_revenue", "customer_id", 10)
    return gold.enrich(
        gold.named_revenue(best), shop.customers(spark, sf), "customer_id", ["customer_name"]
    ).select("rank", "customer_id", "customer_name", "total_revenue", "total_orders", "avg_ticket")


def top10_products(spark: SparkSession, sf: str) -> DataFrame:
    best = top_by_rank(_product_totals(spark, sf), "_revenue", "product_id", 10)
    return gold.enrich(
        gold.named_revenue(best), shop.products(spark, sf), "product_id", ["product_name"]
    ).select("rank", "product_id", "product_name", "total_revenue", "total_quantity")


def kpi_by_payment(spark: SparkSession, sf: str) -> DataFrame:
    return gold.kpi_by_payment(shop.completed_orders(spark, sf))


def kpi_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return gold.kpi_by_status(shop.orders(spark, sf))


def kpi_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return gold.kpi_by_category(shop.completed_items(spark, sf), shop.products(spark, sf))


def _kpis(spark: SparkSession, sf: str) -> DataFrame:
    return gold.union_kpis(
        kpi_by_payment(spark, sf), kpi_by_status(spark, sf), kpi_by_category(spark, sf)
    )


def gold_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return _kpis(spark, sf)


def kpi_headline(spark: SparkSession, sf: str) -> DataFrame:
    return gold.kpi_headline(shop.completed_orders(spark, sf), shop.completed_items(spark, sf))


# --- serving -----------------------------------------------------------------


def api_dashboard_headline(spark: SparkSession, sf: str) -> DataFrame:
    orders = shop.completed_orders(spark, sf)
    return serving.dashboard_headline(
        gold.revenue_monthly(orders), orders.select("customer_id").distinct()
    )


def api_monthly_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return serving.monthly_revenue(gold.revenue_monthly(shop.completed_orders(spark, sf)))


def best_products(spark: SparkSession, sf: str, totals: DataFrame, by: str) -> DataFrame:
    """First five products by ``by``; names are looked up for those five only."""
    best = serving.top_n(totals, [F.desc(by), F.asc("product_id")], fv.TOP_K)
    named = gold.enrich(gold.named_revenue(best), shop.products(spark, sf), "product_id", ["product_name"])
    return named.select("product_id", "product_name", "total_quantity", "total_revenue")


def best_customers(spark: SparkSession, sf: str, totals: DataFrame) -> DataFrame:
    best = serving.top_n(totals, [F.desc("_revenue"), F.asc("customer_id")], fv.TOP_K)
    return gold.enrich(
        gold.named_revenue(best), shop.customers(spark, sf), "customer_id", ["customer_name"]
    ).select("customer_id", "customer_name", "total_orders", "total_revenue")


def api_top5_products(spark: SparkSession, sf: str) -> DataFrame:
    return serving.top5_products(context_top_products_volume(spark, sf))


def context_top_products_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return best_products(spark, sf, _product_totals(spark, sf), "_revenue")


def context_top_products_volume(spark: SparkSession, sf: str) -> DataFrame:
    return best_products(spark, sf, _product_totals(spark, sf), "total_quantity")


def context_top_customers(spark: SparkSession, sf: str) -> DataFrame:
    return best_customers(spark, sf, _customer_totals(spark, sf))


def written_totals(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Totals per customer and per product, written once for several readers."""
    return (
        io.materialize(_customer_totals(spark, sf), "customer_totals"),
        io.materialize(_product_totals(spark, sf), "product_totals"),
    )


def format_brl_amounts(spark: SparkSession, sf: str) -> DataFrame:
    orders = shop.table(spark, sf, "orders")
    price = F.col("o_totalprice")
    amount = (
        F.when(F.col("o_orderstatus") == "P", -price)
        .when(F.col("o_orderpriority") != "5-LOW", price)
    )
    return orders.select("o_orderkey", format_brl(amount).alias("brl"))


def parse_brl_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """Amount texts in the shapes charts carry, and the numbers read from them."""
    orders = shop.table(spark, sf, "orders")
    price = F.col("o_totalprice")
    urgency = F.substring("o_orderpriority", 1, 1)
    text = (
        F.when(urgency == "1", format_brl(price))
        .when(urgency == "2", plain_number_text(price))
        .when(urgency == "3", F.concat(F.lit("R$"), F.floor(price).cast("string"), F.lit(",5,7 mil")))
        .when(urgency == "4", F.concat(F.lit("-"), F.replace(format_brl(price), F.lit("R$ "))))
        .otherwise("sem valor")
    )
    return orders.select("o_orderkey", text.alias("amount_text")).withColumn(
        "amount", parse_brl(F.col("amount_text"))
    )


QUERIES = {
    "gold_revenue_summary": gold_revenue_summary,
    "bronze_customers": bronze_customers,
    "bronze_orders_nested": bronze_orders_nested,
    "bronze_orders_array_files": bronze_orders_array_files,
    "sink_roundtrip": sink_roundtrip,
    "sink_partitioned_month": sink_partitioned_month,
    "sql_adhoc": sql_adhoc,
    "export_ptbr_csv_rows": export_ptbr_csv_rows,
    "chart_series": chart_series,
    "silver_customers": silver_customers,
    "silver_products": silver_products,
    "silver_orders": silver_orders,
    "silver_findings": silver_findings,
    "dedupe_latest": dedupe_latest,
    "text_normalize": text_normalize,
    "date_parts": date_parts,
    "standardize_columns": standardize_columns,
    "order_items_flat": order_items_flat,
    "dq_duplicates": dq_duplicates,
    "dq_nulls": dq_nulls,
    "dq_min_records": dq_min_records,
    "dq_types": dq_types,
    "table_profile": table_profile,
    "layer_status": layer_status,
    "gold_revenue_monthly": gold_revenue_monthly,
    "gold_top_customers": gold_top_customers,
    "gold_top_products": gold_top_products,
    "global_rank_distributed": global_rank_distributed,
    "top10_customers": top10_customers,
    "top10_products": top10_products,
    "kpi_by_payment": kpi_by_payment,
    "kpi_by_status": kpi_by_status,
    "kpi_by_category": kpi_by_category,
    "gold_kpis": gold_kpis,
    "kpi_headline": kpi_headline,
    "api_dashboard_headline": api_dashboard_headline,
    "api_monthly_revenue": api_monthly_revenue,
    "api_top5_products": api_top5_products,
    "context_top_products_revenue": context_top_products_revenue,
    "context_top_products_volume": context_top_products_volume,
    "context_top_customers": context_top_customers,
    "format_brl": format_brl_amounts,
    "parse_brl": parse_brl_amounts,
}
