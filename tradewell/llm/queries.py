"""The queries of this subpackage, each over the whole of its table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewell.llm import (
    ann_tree,
    chat_hmm,
    line_dedup,
    pair_maxscore,
    pfair_mix,
    phrases,
    piece_codec,
    quality_gbdt,
    quality_rules,
    secrets,
    simhash,
    toxicity,
    url_graph,
)
from tradewell.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets; the digest is of those found by fixed patterns."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.span_list(base), 256).alias("base_sha256"),
        secrets.span_list(F.col("spans")).alias("spans"),
        of("guess").alias("n_guess"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that go, where their classes' first lines are, and a digest of what stays.

    Equal lines of any length are of one class; edits are looked for from 30 characters on."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), equal_chars=1)
    return found.select(
        "row.doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        F.array_join(F.transform("dropped", lambda i: i.cast("string")), ",").alias("dropped"),
        "class_ids",
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of boosted trees over statistics of the texts."""
    return quality_gbdt.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the texts decoded from them."""
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"), ids=False)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of near-duplicates."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the texts, and what base rules and proven cut-offs make of them."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.drop("broken")


def op7_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return ann_tree.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op8_chat_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts, parsed line by line into rendered turns."""
    turns = table(spark, sf_dir, "conversations")
    return chat_hmm.parse(chat_hmm.transcript_lines(turns), chat_hmm.fit(turns))


def op9_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on pages by rules, else by what their hosts link to and are linked from."""
    return url_graph.judge_pages(table(spark, sf_dir, "pages"))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mix of the sources."""
    mixed = pfair_mix.mix(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return mixed.select("row.doc_id", "source", "number", "block", "slot", "place")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words come together most."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of compression distance between toxic and ordinary text."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_pair_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that score highest for each benchmark item."""
    return pair_maxscore.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_piece_codec": op4_piece_codec,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_ann_tree": op7_ann_tree,
    "op8_chat_hmm": op8_chat_hmm,
    "op9_url_graph": op9_url_graph,
    "op10_pfair_mix": op10_pfair_mix,
    "op11_phrases": op11_phrases,
    "op12_toxicity": op12_toxicity,
    "op13_pair_maxscore": op13_pair_maxscore,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {
    "op6_quality_rules": quality_rules.SQL,
    "op9_url_graph": url_graph.SQL,
    "op10_pfair_mix": pfair_mix.SQL,
    "op11_phrases": phrases.SQL,
    "op13_pair_maxscore": pair_maxscore.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
