"""Keep a keyed document index in step with its source table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_hash(text: str = "text"):
    return F.sha2(F.col(text), 256)


def index_sync_plan(source: DataFrame, current: DataFrame, wanted_hash: Column | None = None) -> DataFrame:
    """What a triggered sync does per ``doc_id``: insert, update, delete or same.

    ``source`` has ``(doc_id, text)``, ``current`` has ``(doc_id, text_hash)``. Only the
    key and the hash of a text are shuffled, never the text. ``wanted_hash`` is the hash of a
    source row where it is stored already.
    """
    new = text_hash() if wanted_hash is None else wanted_hash
    wanted = source.select("doc_id", new.alias("_new"), F.lit(True).alias("_wanted"))
    held = current.select("doc_id", F.col("text_hash").alias("_old"), F.lit(True).alias("_held"))
    return wanted.join(held, "doc_id", "full_outer").select(
        "doc_id",
        F.when(F.col("_held").isNull(), "insert")
        .when(F.col("_wanted").isNull(), "delete")
        .when(F.col("_new").eqNullSafe(F.col("_old")), "same")
        .otherwise("update")
        .alias("action"),
    )


def apply_sync(source: DataFrame, current: DataFrame, embed) -> DataFrame:
    """The index after the sync: ``current`` without updated and deleted entries, plus
    the inserted and updated documents, the only ones that are embedded again.

    ``embed`` maps ``(doc_id, text, text_hash)`` to the columns of ``current``.
    """
    plan = index_sync_plan(source, current)
    stale = plan.filter(F.col("action").isin("insert", "update")).select("doc_id")
    same = plan.filter("action = 'same'").select("doc_id")
    kept = current.join(same, "doc_id", "left_semi")
    fresh = source.withColumn("text_hash", text_hash()).join(stale, "doc_id", "left_semi")
    return kept.unionByName(embed(fresh).select(*current.columns))
