"""Vectors of a costly model, each different text embedded once and kept.

The cache is a table (text_hash, vec) of one model. What a run adds are the texts whose hash is not
in it; the rest of a load, and copies within it, cost a join.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewell.operators.retrieval import Embedder
from tradewell.sources.io import materialize, write_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Model = Callable[[list[str]], list]


def _kept(key: str, load: Callable[[], Model]) -> Model:
    """The model a Python worker holds under ``key``, loaded by the first task that asks. Tasks get
    this module as a copy of their own, so what outlives them stands among the worker's modules."""
    held = sys.modules.setdefault("_tradewell_models", ModuleType("_tradewell_models")).__dict__
    if key not in held:
        held[key] = load()
    return held[key]


def worker_embedder(key: str, load: Callable[[], Model], text_col: str = "text") -> Embedder:
    """Embed with a model that is loaded once per Python worker, not per task.

    ``key`` names the model with its version: another one under the same key would not be loaded.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _kept(key, load)
        for texts in batches:
            yield pd.Series(list(model(texts.tolist())))

    return lambda df: df.withColumn("vec", vectors(F.col(text_col)))


def missing_texts(docs: DataFrame, cache: str, text_col: str = "text") -> DataFrame:
    """(text_hash, text) of the different texts that the cache does not hold.

    Hashes alone decide what is missing; texts are shuffled only for those, and for a text that is
    repeated once for each partition.
    """
    spark = docs.sparkSession
    texts = docs.select(F.sha2(F.col(f"`{text_col}`"), 256).alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.filter("text_hash is not null")
    if spark.catalog.tableExists(cache):
        new = texts.select("text_hash").distinct().join(spark.table(cache).select("text_hash"), "text_hash", "left_anti")
        texts = texts.join(materialize(new, "embedding-new"), "text_hash", "left_semi")
    return texts.dropDuplicates(["text_hash"])


def embed_once(docs: DataFrame, embedder: Embedder, cache: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_hash`` and ``vec``; the model sees a text once, in this run or ever.

    ``embedder`` reads the column ``text``. New vectors are appended to the table ``cache``, which
    holds those of one model and has one writer at a time; a failed run adds nothing. A null text
    has a null vector and is not embedded, an empty one is a text like others. Columns of ``docs``
    with these two names are replaced. A text that a third of the rows share is one row of the
    cache, and the join splits its rows at run time.
    """
    new = missing_texts(docs, cache, text_col)
    write_table(embedder(new).select("text_hash", "vec"), cache, mode="append")
    rows = docs.drop("text_hash", "vec").withColumn("text_hash", F.sha2(F.col(f"`{text_col}`"), 256))
    return rows.join(docs.sparkSession.table(cache), "text_hash", "left")
