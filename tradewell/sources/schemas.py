"""Declared schemas of the raw JSON inputs."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


CUSTOMERS = StructType(
    _strings("customer_id", "customer_name", "email", "city", "state", "registration_date")
)
PRODUCTS = StructType(
    [
        *_strings("product_id", "product_name", "category"),
        StructField("price", DoubleType()),
        StructField("stock_quantity", IntegerType()),
        *_strings("created_date"),
    ]
)
ORDER_ITEM = StructType(
    [
        *_strings("product_id", "product_name"),
        StructField("quantity", IntegerType()),
        StructField("unit_price", DoubleType()),
        StructField("item_total", DoubleType()),
    ]
)
ORDERS = StructType(
    [
        *_strings(
            "order_id", "customer_id", "customer_name", "order_date", "status", "payment_method"
        ),
        StructField("items", ArrayType(ORDER_ITEM)),
        StructField("total_amount", DoubleType()),
    ]
)
