"""Sync of an index that reads only what changed.

Documents and index entries lie in partitions by a hash of the id, and for each such bucket a
digest is kept beside the table when the bucket is written. A sync compares the digests, one
row a bucket, and reads the texts and hashes of the buckets that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewell.operators.index_sync import index_sync_plan, text_hash
from tradewell.operators.late_load import is_none_of, is_one_of, merge_load
from tradewell.sources.io import materialize, write_table

BUCKETS = 256


def bucket_of(n_buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)).cast("int")


def bucket_digests(entries: DataFrame) -> DataFrame:
    """``(bucket, entries, digest_a, digest_b)`` of ``(doc_id, text_hash, bucket)``, whatever the
    order of the rows: their number and two sums of 64-bit hashes of id and text hash."""
    summed = lambda seed: F.sum(F.xxhash64(F.lit(seed), "doc_id", "text_hash").cast("decimal(20,0)"))
    return entries.groupBy("bucket").agg(
        F.count("*").alias("entries"), summed(1).alias("digest_a"), summed(2).alias("digest_b")
    )


def write_buckets(entries: DataFrame, name: str, n_buckets: int = BUCKETS) -> DataFrame:
    """Write ``(doc_id, text_hash, ...)`` as a table partitioned by bucket; its digests, written."""
    table = write_table(entries.withColumn("bucket", bucket_of(n_buckets)), name, partition_by=["bucket"])
    return materialize(bucket_digests(table), "bucket-digests")


def with_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_hash", text_hash())


def merge_documents(
    spark: SparkSession, name: str, digests: DataFrame, docs: DataFrame, gone: DataFrame, n_buckets: int = BUCKETS
) -> DataFrame:
    """Put new versions of documents (one row for each id) into a table of ``write_buckets`` and
    take the ids ``gone`` out of it; the digests after that, for touched buckets computed again."""
    fresh = with_hash(docs).withColumn("bucket", bucket_of(n_buckets))
    keys = fresh.select("doc_id").unionByName(gone.select("doc_id"))
    touched = merge_load(spark, name, fresh, keys, "doc_id", "bucket")
    if not touched:
        return digests
    again = bucket_digests(spark.table(name).filter(is_one_of("bucket", touched)))
    return materialize(digests.filter(is_none_of("bucket", touched)).unionByName(again), "bucket-digests")


def changed_buckets(source: DataFrame, index: DataFrame) -> list[int]:
    """Buckets whose digests differ, or that one side lacks; at most their fixed number."""
    figures = ["entries", "digest_a", "digest_b"]
    a = source.select("bucket", F.struct(*figures).alias("_a"))
    b = index.select("bucket", F.struct(*figures).alias("_b"))
    differ = a.join(b, "bucket", "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return sorted(r.bucket for r in differ.select("bucket").collect())


def changed_sync_plan(
    source: DataFrame, source_digests: DataFrame, index: DataFrame, index_digests: DataFrame
) -> DataFrame:
    """Inserts, updates and deletes of ``index_sync_plan``, from the buckets that differ only.

    Both tables are those of ``write_buckets`` with the same number of buckets. Ids are unique on
    each side. The hash kept with a document is compared, so no text is read at all.
    """
    buckets = is_one_of("bucket", changed_buckets(source_digests, index_digests))
    plan = index_sync_plan(
        source.filter(buckets).select("doc_id", F.col("text_hash").alias("_kept")),
        index.filter(buckets).select("doc_id", "text_hash"),
        wanted_hash=F.col("_kept"),
    )
    return plan.filter("action <> 'same'")
