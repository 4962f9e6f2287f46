"""From raw documents to token ids: five stages over all documents that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewell.llm import line_dedup, pfair_mix, piece_codec, quality_gbdt, simhash
from tradewell.llm.common import table
from tradewell.sources.io import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_gbdt.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go from the texts, of whatever length, and from 30 characters
    on also lines that nearly do; ``n_chars`` follows.

    A document of which nothing is left stays as an empty one; the next stage, to which all empty
    documents are copies of each other, keeps one of them.
    """
    found = line_dedup.dedup_lines(docs, equal_chars=1).select("row.*", F.col("text").alias("_left"))
    made = {"text": F.col("_left"), "n_chars": F.char_length("_left").cast("long")}
    return found.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which a mix of the sources takes them."""
    return pfair_mix.in_order(pfair_mix.mix(docs))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text."""
    return piece_codec.encode_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", piece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows with ``slot`` and ``place`` of each document in the mix; each stage's
    result is written and read again by the next.

    Ordered by (slot, place) the rows are the mixed stream. The files of a written table are read
    in no certain order, so the mix is kept as these two numbers, which go through the encoding
    with the id, and not as the order of its rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-2]:
        docs = materialize(stage(spark, docs, sf_dir), "corpus-" + name.split()[0].lower())
    mixed = materialize(pfair_mix.mix(docs, columns=["doc_id", "text"]), "corpus-mixing")
    placed = mixed.select(F.struct("row.doc_id", "slot", "place").alias("doc_id"), "row.text")
    coded = STAGES[-1][1](spark, placed, sf_dir)
    rest = [F.col(f"`{c}`") for c in coded.columns if c != "doc_id"]
    return coded.select("doc_id.doc_id", "doc_id.slot", "doc_id.place", *rest)


#: Boosted trees, edit joins and merges of pieces are not expressible in SQL.
ORACLE_SQL = None
