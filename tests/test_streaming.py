from pyspark.sql import functions as F

from tradewell.streaming.index_refresh import current_index, refresh_index

SCHEMA = "doc_id string, text string, updated_at int"


def test_refresh_embeds_only_changes(spark, tmp_path):
    source, index, progress = (str(tmp_path / n) for n in ("source", "index", "progress"))
    embed = lambda df: df.withColumn("vec", F.array(F.length("text").cast("float")))

    def arrive(rows):
        df = spark.createDataFrame(rows, SCHEMA)
        df.coalesce(1).write.mode("append").parquet(source)
        refresh_index(spark, source, df.schema, index, progress, embed)
        return {r.doc_id: (r.text, r.version) for r in current_index(spark, index).collect()}

    assert arrive([("a", "1", 1), ("b", "old", 1), ("b", "older", 0)]) == {"a": ("1", 0), "b": ("old", 0)}
    assert arrive([("a", "1", 2), ("b", "new", 2), ("c", "3", 2)]) == {
        "a": ("1", 1),
        "b": ("new", 1),
        "c": ("3", 1),
    }
    assert arrive([("b", "old", 3)])["b"] == ("old", 2)
    refresh_index(spark, source, spark.createDataFrame([], SCHEMA).schema, index, progress, embed)
    assert current_index(spark, index).count() == 3
    # a late row changes nothing, also one between the times of two equal texts
    assert arrive([("b", "late", 1), ("a", "other", 1)]) == {"a": ("1", 1), "b": ("old", 2), "c": ("3", 1)}
    # a new progress folder starts beside what is there
    refresh_index(spark, source, spark.createDataFrame([], SCHEMA).schema, index, str(tmp_path / "again"), embed)
    assert {r.doc_id: r.text for r in current_index(spark, index).collect()} == {"a": "1", "b": "old", "c": "3"}
