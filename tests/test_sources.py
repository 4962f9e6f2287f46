import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tradewell.config import LakehouseConfig, scratch_root
from tradewell.operators import gold, silver
from tradewell.sources import io, schemas, shop

ORDERS = [
    {
        "order_id": "ORD-1",
        "customer_id": "CUST-1",
        "customer_name": "Ana",
        "order_date": "2024-01-05",
        "status": "completed",
        "payment_method": " Pix ",
        "items": [
            {"product_id": "P1", "product_name": "A", "quantity": 2, "unit_price": 1.5, "item_total": 3.0},
            {"product_id": "P2", "product_name": "B", "quantity": 1, "unit_price": 7.0, "item_total": 7.0},
        ],
        "total_amount": 10.0,
    },
    {"order_id": "ORD-2", "customer_id": "CUST-1", "order_date": "x", "status": "Completed", "items": []},
    {"order_id": "ORD-3", "customer_id": "CUST-2", "order_date": "2024-02-01", "status": "shipped"},
    {"order_id": None, "customer_id": "CUST-2", "status": "shipped"},
]


@pytest.fixture
def orders_file(tmp_path):
    path = tmp_path / "orders.json"
    path.write_text(json.dumps(ORDERS, indent=2))
    return str(path)


def test_nested_json_to_refined_orders(spark, orders_file):
    raw = io.read_raw_json(spark, orders_file, schemas.ORDERS)
    bronze = io.add_ingestion_metadata(raw, "orders.json")
    assert {"_ingestion_timestamp", "_source_file"} <= set(bronze.columns)
    rows = {r.order_id: r for r in silver.silver_orders(bronze).collect()}
    assert set(rows) == {"ORD-1", "ORD-3"}  # 'Completed' is not a status as stored
    assert rows["ORD-1"].payment_method == "pix"
    assert (rows["ORD-1"].order_year, rows["ORD-1"].order_month) == (2024, 1)
    assert rows["ORD-1"].order_year_month == "2024-01"
    assert (rows["ORD-1"].num_items, rows["ORD-3"].num_items) == (2, None)
    relaxed = silver.silver_orders(bronze, normalize_first=True)
    assert relaxed.filter("order_id = 'ORD-2'").first().num_items == 0


def test_flatten_reads_only_the_wanted_fields(spark, orders_file, tmp_path):
    path = str(tmp_path / "orders")
    io.read_raw_json(spark, orders_file, schemas.ORDERS).write.parquet(path)
    orders = spark.read.parquet(path)
    assert gold.flatten_items(orders).count() == 2
    items = gold.flatten_items(orders, ["product_id", "quantity"])
    plan = items.groupBy("product_id").agg(F.sum("quantity"))._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("ReadSchema") :]
    assert "product_id" in scan and "quantity" in scan
    assert "unit_price" not in scan and "total_amount" not in scan


def test_bad_values_and_files(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('[{"product_id": "P1", "stock_quantity": 1.5}, {"product_name": "no id"}]')
    bad.write_text('[{"product_id": "P2", ')
    rows = io.read_raw_json(spark, str(good), schemas.PRODUCTS).collect()
    assert [r.product_id for r in rows] == ["P1", None]
    assert rows[0].stock_quantity is None
    broken = io.read_raw_json(spark, str(bad), schemas.PRODUCTS).collect()
    assert len(broken) == 1 and broken[0].product_id is None
    sound = tmp_path / "sound.json"
    sound.write_text('[{"product_id": "P3", "stock_quantity": 1}, {"product_name": "no id"}]')
    both = io.read_raw_json(spark, [str(sound), str(bad)], schemas.PRODUCTS, keep_corrupt=True).cache()
    fine, quarantined = io.split_corrupt(both)
    assert [r[io.CORRUPT] for r in quarantined.collect()] == ['[{"product_id": "P2", ']
    assert fine.count() == 2


def test_inferred_schema_and_lines(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text('{"a": 1}\n{"a": 2}\n')
    assert io.read_raw_json(spark, str(path), multiline=False).agg(F.sum("a")).first()[0] == 3


def test_write_table_modes_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, p string")
    name = "sources_partitioned"
    path = str(tmp_path / name)
    table = io.write_table(df, name, partition_by=["p"], path=path)
    assert table.count() == 3
    assert sorted(p.name for p in (tmp_path / name).glob("p=*")) == ["p=a", "p=b"]
    assert io.write_table(df, name, mode="append", partition_by=["p"], path=path).count() == 6
    assert io.write_table(df, name, partition_by=["p"], path=path).count() == 3
    assert io.read_table(spark, name).filter("p = 'b'").count() == 1
    spark.sql(f"DROP TABLE {name}")


def test_namespaces(spark):
    config = LakehouseConfig(bronze="t_bronze", silver="t_silver", gold="t_gold")
    config.ensure_namespaces(spark)
    assert spark.catalog.databaseExists("t_gold")
    assert config.table("gold", "kpis") == "t_gold.kpis"
    assert [len(s.tables) for s in config.steps()] == [3, 3, 4, 1, 0]
    io.write_table(spark.range(3), config.table("gold", "kpis"))
    assert spark.table("t_gold.kpis").count() == 3


def test_csv_export(spark, tmp_path):
    series = spark.createDataFrame([("Jan", 1234.5), ('a "b"', 1e8), (None, None)], "x string, y double")
    path = io.export_ptbr_csv(series, str(tmp_path), "Receita  por Mês", x_title="Mês")
    assert path == f"{tmp_path}/receita_por_mês.csv"
    data = (tmp_path / "receita_por_mês.csv").read_bytes()
    assert data.startswith(b"\xef\xbb\xbfM")
    assert data.decode("utf-8-sig").splitlines() == ["Mês;Valor", '"Jan";"1234,5"', '"a ""b""";"100000000"', '"null";"null"']
    assert io.export_ptbr_csv(series.limit(0), str(tmp_path)) == f"{tmp_path}/dados.csv"
    assert (tmp_path / "dados.csv").read_text("utf-8-sig") == "Categoria;Valor\n"


def test_an_order_of_any_length_is_one_row(spark, tmp_path, monkeypatch):
    """With 2,500 items in one order, totals, counts and items are those of the rows."""
    from tradewell.operators import gold, silver

    big = spark.read.parquet(f"{SF}/lineitem.parquet")
    order = spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderstatus = 'F' and o_totalprice between 30000 and 400000")
    key = order.agg(F.min("o_orderkey")).first()[0]
    more = big.filter(F.col("l_orderkey") == key).limit(1).crossJoin(spark.range(2500).select(F.col("id").alias("_n"))).drop("_n")
    plain = shop.table

    def table(spark, sf, name):
        df = plain(spark, SF, name)
        return df.unionByName(more) if name == "lineitem" else df

    before = gold.revenue_monthly(silver.silver_orders(shop.raw_orders(spark, SF), ["load_no"])).collect()
    monkeypatch.setattr(shop, "table", table)
    nested = silver.silver_orders(shop.raw_orders(spark, SF), ["load_no"])
    headers = silver.silver_orders(shop.raw_order_headers(spark, SF), ["load_no"])
    assert sorted(gold.revenue_monthly(nested).collect(), key=str) == sorted(before, key=str)
    assert sorted(gold.revenue_monthly(headers).collect(), key=str) == sorted(before, key=str)
    items = shop.raw_items(spark, SF)
    counted = silver.with_item_count(headers, items).filter(F.col("order_id") == f"ORD-{key}").first()
    whole = nested.filter(F.col("order_id") == f"ORD-{key}").collect()
    assert [r.num_items for r in whole] == [counted.num_items] and counted.num_items > 2500
    flat = silver.order_items(headers, items)
    assert flat.filter(F.col("order_id") == f"ORD-{key}").count() == counted.num_items
    assert sorted(map(str, gold.flatten_items(nested).collect())) == sorted(
        map(str, flat.select("order_id", "order_date", *shop.ITEM_FIELDS).collect())
    )


def test_items_follow_the_load_that_is_kept(spark):
    from tradewell.operators import silver

    schema = "order_id string, customer_id string, status string, payment_method string, order_date string, total_amount double, load_no int"
    headers = spark.createDataFrame(
        [("o", "c", "completed", "pix", "2024-01-01", 9.0, 1), ("o", "c", "completed", "pix", "2024-01-01", 3.0, 2)], schema
    )
    items = spark.createDataFrame([("o", 1, "a"), ("o", 1, "b"), ("o", 2, "c")], "order_id string, load_no int, product_id string")
    clean = silver.silver_orders(headers, ["load_no"])
    assert [r.product_id for r in silver.order_items(clean, items).collect()] == ["c"]
    assert [r.num_items for r in silver.with_item_count(clean, items).collect()] == [1]


def test_scratch_root_is_the_shared_folder(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_sql_with_arguments(spark):
    df = io.run_sql(spark, "SELECT count(*) AS n FROM {t} WHERE id >= :low", {"low": 7}, t=spark.range(10))
    assert df.first().n == 3
