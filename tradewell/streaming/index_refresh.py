"""Triggered refresh of the document index from newly arrived files.

A run reads the files that came since the last one, embeds only documents that are new or
whose text changed, and stops. Each micro-batch writes its own version folder, so the
index is never rewritten and a repeated micro-batch overwrites its own output only.
Deletions need the whole source: see ``operators.index_sync``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradewell.operators.index_sync import text_hash
from tradewell.operators.quality import dedupe_latest


def current_index(spark: SparkSession, index_dir: str, newest_by: str = "updated_at") -> DataFrame:
    """The newest state of every document: the greatest ``newest_by``, whenever it arrived."""
    order = [F.col(newest_by).desc_nulls_last(), F.desc("version"), F.desc("stream")]
    return dedupe_latest(spark.read.parquet(index_dir), ["doc_id"], order)


def refresh_index(
    spark: SparkSession,
    source_dir: str,
    schema: StructType,
    index_dir: str,
    progress_dir: str,
    embed: Callable[[DataFrame], DataFrame],
    newest_by: str = "updated_at",
) -> None:
    """Process everything that arrived in ``source_dir`` (Parquet with ``doc_id``, ``text`` and
    ``newest_by``) and return.

    ``embed`` adds the vector to ``(doc_id, text, text_hash, newest_by)``. A row that is older
    than what the index holds changes nothing; one that is newer with the same text is written
    again with the vector it has, so that later rows are compared with the right time. Versions
    of another progress folder are kept beside: each has a folder of its own.
    """
    stream = hashlib.sha256(progress_dir.rstrip("/").encode()).hexdigest()[:12]

    def merge(batch: DataFrame, batch_id: int) -> None:
        target = f"{index_dir}/stream={stream}/version={batch_id}"
        arrived = dedupe_latest(batch, ["doc_id"], [F.col(newest_by).desc_nulls_last()])
        arrived = arrived.select("doc_id", "text", text_hash().alias("text_hash"), newest_by)
        held = _held(batch.sparkSession, index_dir, stream, batch_id, newest_by)
        if held is None:
            embed(arrived).write.mode("overwrite").parquet(target)
            return
        known = held.select("doc_id", F.col("text_hash").alias("_hash"), F.col(newest_by).alias("_time"))
        newer = F.col("_time").isNull() | (F.col(newest_by) > F.col("_time"))
        met = arrived.join(known, "doc_id", "left").filter(newer)
        changed = met.filter(~F.col("_hash").eqNullSafe(F.col("text_hash"))).drop("_hash", "_time")
        same = met.filter(F.col("_hash").eqNullSafe(F.col("text_hash"))).select("doc_id", newest_by)
        again = held.drop(newest_by, "stream", "version").join(same, "doc_id")
        embed(changed).unionByName(again).write.mode("overwrite").parquet(target)

    (
        spark.readStream.schema(schema)
        .parquet(source_dir)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", progress_dir)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def _held(spark: SparkSession, index_dir: str, stream: str, batch_id: int, newest_by: str) -> DataFrame | None:
    """What the index holds without what a failed try of this batch may have written."""
    try:
        index = current_index_before(spark, index_dir, stream, batch_id, newest_by)
    except AnalysisException:  # no version was written yet
        return None
    return index


def current_index_before(
    spark: SparkSession, index_dir: str, stream: str, batch_id: int, newest_by: str
) -> DataFrame:
    versions = spark.read.parquet(index_dir).filter((F.col("stream") != stream) | (F.col("version") < batch_id))
    order = [F.col(newest_by).desc_nulls_last(), F.desc("version"), F.desc("stream")]
    return dedupe_latest(versions, ["doc_id"], order)
