import re
import uuid

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tradewell.operators import bucketed_index, gold, index_sync, late_load, silver
from tradewell.sources import io, shop

ROWS = "id string, month string, x int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def name(spark):
    made = f"late_{uuid.uuid4().hex}"
    yield made
    spark.sql(f"DROP TABLE IF EXISTS {made}")


def files_of(spark, name):
    return {r.f for r in spark.table(name).select(F.input_file_name().alias("f")).distinct().collect()}


def test_a_load_rewrites_its_partitions_only(spark, name):
    first = [("a", "m1", 1), ("b", "m1", 2), ("c", "m2", 3), ("d", None, 4), ("e", "m3", 5), ("f", "it's", 6), ("g", "m4", 7)]
    io.write_table(spark.createDataFrame(first, ROWS), name, partition_by=["month"])
    before = files_of(spark, name)
    untouched = {f for f in before if "month=m3" in f}
    # b changes, c moves to another month, d leaves the missing month, f was cleaned away, h is new
    clean = spark.createDataFrame([("b", "m1", 20), ("c", "m5", 30), ("d", "m1", 40), ("h", None, 80)], ROWS)
    keys = spark.createDataFrame([("b",), ("c",), ("d",), ("f",), ("h",), (None,), ("nowhere",)], "id string")
    want = [("a", "m1", 1), ("b", "m1", 20), ("c", "m5", 30), ("d", "m1", 40), ("e", "m3", 5), ("g", "m4", 7), ("h", None, 80)]
    for _ in range(2):  # again: the same result
        touched = late_load.merge_load(spark, name, clean, keys, "id", "month")
        got = spark.table(name).select("id", "month", "x")
        assert rows_of(got) == sorted(want, key=str)
        assert {"m1", "m5", None} <= set(touched) and not {"m3", "m4"} & set(touched)
    after = files_of(spark, name)
    assert untouched and untouched <= after
    parts = [r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    assert not [p for p in parts if "m2" in p or "it" in p]


def test_the_last_row_of_the_missing_partition_goes(spark, name):
    io.write_table(spark.createDataFrame([("a", None, 1), ("b", "m", 2)], ROWS), name, partition_by=["month"])
    none = spark.createDataFrame([], ROWS)
    assert late_load.merge_load(spark, name, none, spark.createDataFrame([("a",)], "id string"), "id", "month") == [None]
    assert rows_of(spark.table(name).select("id", "month", "x")) == [("b", "m", 2)]
    assert late_load.merge_load(spark, name, none, none, "id", "month") == []


def test_gold_months_of_a_late_load_equal_a_full_build(spark, sf, name):
    raw = shop.raw_order_headers(spark, sf)
    loads = [r[0] for r in raw.select("load_no").distinct().orderBy("load_no").collect()]
    assert len(loads) > 1
    build = lambda df: silver.silver_orders(df, ["load_no"])
    io.write_table(build(raw.filter(F.col("load_no") == loads[0])), name, partition_by=["order_year_month"])
    monthly = io.materialize(gold.revenue_monthly(spark.table(name)), "months")
    for load in loads[1:]:
        late = raw.filter(F.col("load_no") == load)
        months = late_load.merge_load(spark, name, build(late), late, "order_id", "order_year_month")
        assert months
        monthly = io.materialize(late_load.refresh_months(monthly, spark.table(name), months), "months")
    full = build(raw)
    columns = full.columns
    assert rows_of(spark.table(name).select(*columns)) == rows_of(full)
    assert rows_of(gold.with_growth(monthly)) == rows_of(gold.revenue_summary(full).select(*gold.with_growth(monthly).columns))


def test_recomputed_months_read_their_partitions_only(spark, name):
    rows = [(m, "completed", 1.0, "o", "c") for m in ("2024-01", "2024-02", None)]
    schema = "order_year_month string, status string, total_amount double, order_id string, customer_id string"
    io.write_table(spark.createDataFrame(rows, schema), name, partition_by=["order_year_month"])
    monthly = gold.revenue_monthly(spark.table(name))
    again = late_load.refresh_months(io.materialize(monthly, "months"), spark.table(name), ["2024-02"])
    plan = plan_of(again)
    assert re.search(r"PartitionFilters: \[[^\]]*order_year_month[^\]]*2024-02", plan)
    assert again.count() == 3
    assert late_load.refresh_months(monthly, spark.table(name), []) is monthly


def test_a_sync_reads_changed_buckets_only(spark, name):
    n = 16
    docs = spark.range(300).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    digests = bucketed_index.write_buckets(bucketed_index.with_hash(docs), name, n)
    index_name = f"{name}_index"
    try:
        index_digests = bucketed_index.write_buckets(spark.table(name).select("doc_id", "text_hash"), index_name, n)
        assert bucketed_index.changed_buckets(digests, index_digests) == []
        plan = bucketed_index.changed_sync_plan(spark.table(name), digests, spark.table(index_name), index_digests)
        assert plan.collect() == []

        fresh = spark.createDataFrame([("d5", "changed"), ("new", "text 5"), ("d7", "text 7")], "doc_id string, text string")
        gone = spark.createDataFrame([("d9",), ("never",)], "doc_id string")
        digests = bucketed_index.merge_documents(spark, name, digests, fresh, gone, n)
        assert rows_of(digests) == rows_of(bucketed_index.bucket_digests(spark.table(name)))
        changed = bucketed_index.changed_buckets(digests, index_digests)
        of = {r.doc_id: r.b for r in spark.createDataFrame([("d5",), ("new",), ("d9",)], "doc_id string").select("doc_id", bucketed_index.bucket_of(n).alias("b")).collect()}
        assert changed == sorted(set(of.values())) and len(changed) < n

        source, index = spark.table(name), spark.table(index_name)
        plan = bucketed_index.changed_sync_plan(source, digests, index, index_digests)
        assert {r.doc_id: r.action for r in plan.collect()} == {"d5": "update", "new": "insert", "d9": "delete"}
        full = index_sync.index_sync_plan(source, index.select("doc_id", "text_hash"))
        assert rows_of(plan) == rows_of(full.filter("action <> 'same'"))
        read = {f for f in plan.inputFiles()}
        assert read and all(any(f"bucket={b}/" in f for b in changed) for f in read)
        assert "text:string" not in plan_of(plan)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {index_name}")
