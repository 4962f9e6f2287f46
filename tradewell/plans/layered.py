"""The whole way in one chain: raw JSON files, Bronze, Silver, Gold, sentences, retrieval.

Every layer is written to the shared folder and read from there, as on a scheduled run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tradewell.config import scratch_root
from tradewell.operators import chat, documents, gold, late_load, retrieval, silver
from tradewell.plans.text_queries import user_questions
from tradewell.sources import io, schemas, shop


def _together(spark: SparkSession, steps: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Results of steps that don't read each other, run at the same time: the cores that the last
    tasks and small jobs of one leave free work for another."""
    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        runs = {name: pool.submit(inheritable_thread_target(spark)(step)) for name, step in steps.items()}
        return {name: run.result() for name, run in runs.items()}


def _bronze(spark: SparkSession, raw: DataFrame, name: str, schema: StructType) -> DataFrame:
    """Raw rows as compressed JSON lines, scanned with the declared schema and stamped.

    The files are read once, so they are compressed at the fastest level.
    """
    path = f"{scratch_root(spark)}/raw-{name}-{uuid.uuid4().hex}"
    raw.write.option("zlib.compress.level", "BEST_SPEED").json(path, compression="gzip")
    loads = StructType([*schema.fields, StructField("load_no", IntegerType())])
    scan = io.read_raw_json(spark, path, loads, multiline=False)
    return io.materialize(io.add_ingestion_metadata(scan, f"{name}.json"), f"bronze-{name}")


def silver_layer(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    """The named Silver tables, each from its own raw files and stamped with the time of the run."""
    build = {
        "customers": (shop.raw_customers, schemas.CUSTOMERS, silver.silver_customers),
        "products": (shop.raw_products, schemas.PRODUCTS, silver.silver_products),
        "orders": (shop.raw_orders, schemas.ORDERS, silver.silver_orders),
    }

    def table(name: str) -> DataFrame:
        raw, schema, clean = build[name]
        cleaned = clean(_bronze(spark, raw(spark, sf), name, schema), ["load_no"])
        return io.materialize(silver.stamp(cleaned), f"silver-{name}")

    return _together(spark, {name: lambda name=name: table(name) for name in names})


def gold_layer(layer: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The Gold tables, stamped with the time of the run; items come from the nested Silver orders."""
    orders, products = layer["orders"], layer["products"]
    items = gold.flatten_items(gold.completed_only(orders))
    tables = {
        "revenue_summary": lambda: gold.revenue_summary(orders),
        "top_products": lambda: gold.top_products(items, products),
        "top_customers": lambda: gold.top_customers(orders, layer["customers"]),
        "kpis": lambda: gold.union_kpis(
            gold.kpi_by_payment(orders), gold.kpi_by_status(orders), gold.kpi_by_category(items, products)
        ),
    }
    written = lambda name: io.materialize(silver.stamp(tables[name]()), f"gold-{name}")
    return _together(orders.sparkSession, {name: lambda name=name: written(name) for name in tables})


def pipeline_gold_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return gold.revenue_summary(silver_layer(spark, sf, "orders")["orders"])


def gold_revenue_late_load(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue after each load of the orders was merged into a partitioned Silver table: later
    loads rewrite the months they touch, and only these are computed again."""
    raw = shop.raw_order_headers(spark, sf)
    loads = [r.load_no for r in raw.select("load_no").distinct().orderBy("load_no").collect()]
    name = f"silver_orders_{uuid.uuid4().hex}"
    clean = lambda load: silver.silver_orders(raw.filter(F.col("load_no") == load), ["load_no"])
    try:
        io.write_table(clean(loads[0]), name, partition_by=[late_load.MONTH])
        monthly = io.materialize(gold.revenue_monthly(spark.table(name)), "gold-months")
        for load in loads[1:]:
            keys = raw.filter(F.col("load_no") == load)
            months = late_load.merge_load(spark, name, clean(load), keys, "order_id", late_load.MONTH)
            monthly = io.materialize(late_load.refresh_months(monthly, spark.table(name), months), "gold-months")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return gold.with_growth(monthly)


def pipeline_gold_products(spark: SparkSession, sf: str) -> DataFrame:
    layer = silver_layer(spark, sf, "orders", "products")
    items = gold.flatten_items(gold.completed_only(layer["orders"]))
    return gold.top_products(items, layer["products"])


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    tables = gold_layer(silver_layer(spark, sf, "customers", "products", "orders"))
    return documents.corpus(
        documents.customer_docs(tables["top_customers"]),
        documents.product_docs(tables["top_products"]),
        documents.revenue_docs(tables["revenue_summary"]),
        documents.kpi_docs(tables["kpis"]),
    )


def pipeline_docs(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf)


def pipeline_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """The Gold sentences that answer the questions, with their types."""
    docs = io.materialize(documents.stamped(_sentences(spark, sf)), "gold-documents")
    hits = retrieval.retrieve(user_questions(spark, sf), docs)
    return chat.hits_with_text(hits, docs).select("question_id", "rank", "doc_id", "doc_type", "text", F.round("score", 6).alias("score"))


QUERIES = {
    "pipeline_gold_revenue": pipeline_gold_revenue,
    "gold_revenue_late_load": gold_revenue_late_load,
    "pipeline_gold_products": pipeline_gold_products,
    "pipeline_docs": pipeline_docs,
    "pipeline_retrieval": pipeline_retrieval,
}
