"""Queries over documents, questions, answers and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewell import fixed_values as fv
from tradewell.functions.numbers import plain_number_text
from tradewell.functions.text import score_text
from tradewell.operators import bucketed_index, chat, documents, embedding_cache, gold, index_sync, retrieval, vector_cells
from tradewell.plans import shop_queries as sq
from tradewell.sources import io, shop


def docs_customers(spark: SparkSession, sf: str) -> DataFrame:
    return documents.customer_docs(sq.gold_top_customers(spark, sf))


def docs_products(spark: SparkSession, sf: str) -> DataFrame:
    return documents.product_docs(sq.gold_top_products(spark, sf))


def docs_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return documents.revenue_docs(sq.gold_revenue_summary(spark, sf))


def docs_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return documents.kpi_docs(sq.gold_kpis(spark, sf))


def docs_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return documents.corpus(
        docs_customers(spark, sf),
        docs_products(spark, sf),
        docs_revenue(spark, sf),
        docs_kpis(spark, sf),
    )


def docs_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return documents.docs_by_type(docs_corpus(spark, sf))


def _short_customers(spark: SparkSession, sf: str, orders: DataFrame) -> DataFrame:
    totals = gold.named_revenue(gold.customer_totals(orders))
    named = gold.enrich(
        totals, shop.customers(spark, sf), "customer_id", ["customer_name", "city", "state"]
    )
    return documents.customer_docs(named, "short")


def docs_customers_short(spark: SparkSession, sf: str) -> DataFrame:
    return _short_customers(spark, sf, shop.completed_orders(spark, sf))


def docs_products_short(spark: SparkSession, sf: str) -> DataFrame:
    totals = gold.named_revenue(gold.product_totals(shop.completed_items(spark, sf)))
    named = gold.enrich(
        totals, shop.products(spark, sf), "product_id", ["product_name", "category", "price"]
    )
    return documents.product_docs(named, "short")


def docs_period_short(spark: SparkSession, sf: str) -> DataFrame:
    return documents.revenue_docs(sq.gold_revenue_summary(spark, sf), "short")


def _source_and_index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The whole document table, written once, and the index as an older build left it: an entry
    for every customer, with the short sentence of those who bought, products and months as now,
    and no KPIs."""
    source = io.materialize(docs_corpus(spark, sf), "documents")
    short = docs_customers_short(spark, sf).select("doc_id", "text")
    every = shop.customers(spark, sf).select(
        F.concat(F.lit("customer_"), F.col("customer_id")).alias("doc_id"), "customer_name"
    )
    customers = every.join(short, "doc_id", "left").select(
        "doc_id", F.coalesce("text", "customer_name").alias("text")
    )
    others = source.filter(F.col("doc_type").isin("product", "revenue")).select("doc_id", "text")
    held = customers.unionByName(others).withColumn("text_hash", index_sync.text_hash())
    return source.select("doc_id", "text"), held


def doc_index_sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Sync of the whole document table with what the index holds."""
    return index_sync.index_sync_plan(*_source_and_index(spark, sf))


def doc_index_after_sync(spark: SparkSession, sf: str) -> DataFrame:
    after = index_sync.apply_sync(*_source_and_index(spark, sf), lambda fresh: fresh)
    return after.select("doc_id", "text_hash")


def doc_index_sync_changed(spark: SparkSession, sf: str) -> DataFrame:
    """What a sync by buckets has to do. Documents and index lie in buckets with a digest each, as
    the runs that wrote them left them; the buckets without a difference are not read."""
    source, held = _source_and_index(spark, sf)
    tables = [f"documents_{uuid.uuid4().hex}", f"index_{uuid.uuid4().hex}"]
    try:
        source_digests = bucketed_index.write_buckets(bucketed_index.with_hash(source), tables[0])
        index_digests = bucketed_index.write_buckets(held.select("doc_id", "text_hash"), tables[1])
        plan = bucketed_index.changed_sync_plan(
            spark.table(tables[0]), source_digests, spark.table(tables[1]), index_digests
        )
        return io.materialize(plan, "index-changes")
    finally:
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


# --- questions and documents -------------------------------------------------


def user_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn, and a question about the revenue of every nation."""
    turns = shop.table(spark, sf, "conversations").filter("role = 'user'")
    asked = turns.select(F.concat_ws("_", "conv_id", "turn").alias("question_id"), "text")
    nations = shop.table(spark, sf, "nation").select(
        F.concat(F.lit("nation_"), F.col("n_nationkey")).alias("question_id"),
        F.concat(F.lit("Qual a Receita de "), "n_name", F.lit(" les de la?")).alias("text"),
    )
    return asked.unionByName(nations)


def text_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = shop.table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("doc_type"), "text"
    )
    return io.spread(docs, "doc_id")


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.retrieve(user_questions(spark, sf), text_documents(spark, sf))


def _found(spark: SparkSession, sf: str, hits: DataFrame) -> DataFrame:
    return chat.hits_with_text(hits, text_documents(spark, sf))


def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf)


def retrieve_for_questions(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, _hits(spark, sf)).select(
        "question_id",
        "rank",
        "doc_id",
        "doc_type",
        "text",
        score_text(F.col("score")).alias("score_text"),
    )


def route_questions(spark: SparkSession, sf: str) -> DataFrame:
    """User turns, nations, and a question per product and customer."""
    parts = shop.table(spark, sf, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey")).alias("question_id"),
        F.concat(F.lit("Qual o estoque de "), "p_name", F.lit(", lapTOP ou outro?")).alias("text"),
    )
    buyers = shop.table(spark, sf, "customer").select(
        F.concat(F.lit("customer_"), F.col("c_custkey")).alias("question_id"),
        F.concat(F.lit("Onde mora "), "c_name", F.lit("?")).alias("text"),
    )
    every = user_questions(spark, sf).unionByName(parts).unionByName(buyers)
    return chat.route_questions(every).select("question_id", "is_analytical")


def answer_sources(spark: SparkSession, sf: str) -> DataFrame:
    routed = chat.route_questions(user_questions(spark, sf))
    docs, hits = text_documents(spark, sf), _hits(spark, sf)
    return chat.answer_sources(routed, hits, docs)


def prompt_batch(spark: SparkSession, sf: str) -> DataFrame:
    found = _found(spark, sf, _hits(spark, sf))
    return chat.build_prompts(user_questions(spark, sf), found)


def exact_context(spark: SparkSession, sf: str) -> DataFrame:
    """All four figures from one pass over the orders and one over the items."""
    customers, products = sq.written_totals(spark, sf)
    return chat.exact_context(
        gold.headline_of(customers, products.agg(F.sum("total_quantity")).scalar()),
        sq.best_products(spark, sf, products, "_revenue"),
        sq.best_products(spark, sf, products, "total_quantity"),
        sq.best_customers(spark, sf, customers),
    )


def prompt_batch_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    routed = chat.route_questions(user_questions(spark, sf))
    open_questions = routed.filter(~F.col("is_analytical")).select("question_id", "text")
    found = _found(spark, sf, retrieval.retrieve(open_questions, text_documents(spark, sf)))
    return chat.build_prompts_hybrid(routed, found, exact_context(spark, sf))


def conversation_turns(spark: SparkSession, sf: str) -> DataFrame:
    return chat.history_turns(shop.table(spark, sf, "conversations"))


def conversation_history(spark: SparkSession, sf: str) -> DataFrame:
    whole = chat.conversation_history(shop.table(spark, sf, "conversations"))
    said = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return whole.select(
        "conv_id", F.size("history").alias("messages"), F.array_join(said, "\n").alias("history_text")
    )


def chat_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of all questions; a user turn carries the turns of its conversation before it."""
    turns = shop.table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select(
        "conv_id", F.col("turn").alias("_at"), F.concat_ws("_", "conv_id", "turn").alias("question_id")
    )
    said = chat.history_turns(turns).join(asked, "conv_id").filter("turn < _at")
    return chat.chat_requests(prompt_batch_hybrid(spark, sf), said)


def retrieval_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The assistant turn after a user turn is the answer to it."""
    turns = shop.table(spark, sf, "conversations").filter("role = 'assistant'")
    answers = turns.select(
        F.concat_ws("_", "conv_id", F.col("turn") - 1).alias("question_id"),
        F.col("text").alias("answer"),
    )
    return chat.retrieval_coverage(user_questions(spark, sf), _hits(spark, sf), answers)


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """One model answer per product, its chart well formed or broken by the size."""
    size, price = F.col("p_size"), plain_number_text(F.col("p_retailprice"))
    text = F.concat(F.lit('"'), "p_brand", F.lit('", "'), "p_type", F.lit('"'))

    def chart(x, y, rest):
        return F.concat(F.lit('{"x": ['), x, F.lit('], "y": ['), y, F.lit("]"), rest, F.lit("}"))

    labels = F.concat(
        F.lit(', "chart_type": "line", "title": "Volume de '), "p_name", F.lit('", "xaxis": "Marca", "yaxis": "Preço"')
    )
    numbers = F.concat(price, F.lit(", "), size.cast("string"))
    json = (
        F.when(size == 2, F.lit('{"x": ["a"'))
        .when(size == 3, F.concat(F.lit("["), text, F.lit("]")))
        .when(size == 4, chart(numbers, numbers, labels))
        .when(size == 5, chart(text, F.concat(F.lit('"'), price, F.lit('", "3"')), labels))
        .when(size == 6, chart(text, F.lit('"n/a"'), labels))
        .when(size == 7, chart(text, numbers, F.lit("")))
        .when(size == 8, F.lit("{}"))
        .when(size == 9, chart(text, numbers, F.lit(', "title": null')))
        .when(size == 10, chart(text, F.lit("1, null"), labels))
        .when(size == 11, F.lit('{"x": "abc", "y": [1]}'))
        .when(size == 12, chart(text, numbers, F.lit(', "title": 5')))
        .when(size == 13, chart(text, F.lit("true, false"), labels))
        .when(size == 14, chart(F.lit("null"), numbers, labels))
        .when(size == 15, chart(text, F.lit("[1], [2]"), labels))
        .otherwise(chart(text, numbers, labels))
    )
    prose = F.concat(F.lit("  O produto "), "p_name", F.lit(" vende bem. \n"))
    marked = F.concat(prose, F.lit("***\n"), json, F.lit("\n***"))
    return shop.table(spark, sf, "part").select(
        F.col("p_partkey").alias("answer_id"), F.when(size == 1, prose).otherwise(marked).alias("text")
    )


def extract_chart(spark: SparkSession, sf: str) -> DataFrame:
    charts = chat.extract_chart(_answers(spark, sf))
    total = F.aggregate("chart.y", F.lit(0.0), lambda a, v: a + v)
    return charts.select(
        "answer_id",
        "answer",
        F.col("chart").isNotNull().alias("has_chart"),
        F.col("chart.type").alias("chart_type"),
        F.array_join("chart.x", "|").alias("x_text"),
        F.size("chart.y").alias("points"),
        F.round(total, 4).alias("y_total"),
        "chart.title",
        "chart.xaxis_title",
        "chart.yaxis_title",
    )


# --- vectors -----------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    table = shop.table(spark, sf, "embeddings")
    docs = table.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return docs.withColumnRenamed("doc_id", "question_id"), docs


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest other vectors of every vector."""
    return retrieval.vector_topk(*_vectors(spark, sf), skip_same=True)


def vector_topk_cells(spark: SparkSession, sf: str) -> DataFrame:
    return vector_cells.vector_topk_cells(*_vectors(spark, sf), skip_same=True)


def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The values of every document's vector that are not zero, a row for each."""
    docs = text_documents(spark, sf)
    embedded = retrieval.hashing_embedder(retrieval.fit_idf(docs))(docs.select("doc_id", "text"))
    values = embedded.select("doc_id", F.size("vec").alias("dimensions"), F.posexplode("vec").alias("place", "v"))
    return values.filter("v <> 0").select(
        "doc_id", "dimensions", "place", F.round(F.col("v").cast("double"), 5).alias("value")
    )


def embed_documents_once(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors from a model through its cache: English documents come first, then all of them, of
    which only texts not seen before are embedded. The model is a plain count of characters, blanks
    and digits in place of one that needs a file."""
    docs = text_documents(spark, sf)
    cache = f"embeddings_{uuid.uuid4().hex}"
    counts = lambda texts: [[len(t), t.count(" "), sum(t.count(d) for d in "0123456789")] for t in texts]
    model = embedding_cache.worker_embedder("counts-1", lambda: counts)
    try:
        embedding_cache.embed_once(docs.filter("doc_type = 'en'"), model, cache)
        found = embedding_cache.embed_once(docs, model, cache)
        values = [F.col("vec")[i].cast("long").alias(c) for i, c in enumerate(("chars", "blanks", "digits"))]
        return io.materialize(found.select("doc_id", "text_hash", *values), "embedded-once")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {cache}")


def retrieve_by_vector(spark: SparkSession, sf: str) -> DataFrame:
    docs = text_documents(spark, sf)
    embedder = retrieval.hashing_embedder(retrieval.fit_idf(docs))
    return retrieval.retrieve(user_questions(spark, sf), docs, embedder=embedder)


QUERIES = {
    "docs_customers": docs_customers,
    "docs_products": docs_products,
    "docs_revenue": docs_revenue,
    "docs_kpis": docs_kpis,
    "docs_corpus": docs_corpus,
    "docs_by_type": docs_by_type,
    "docs_customers_short": docs_customers_short,
    "docs_products_short": docs_products_short,
    "docs_period_short": docs_period_short,
    "doc_index_sync_plan": doc_index_sync_plan,
    "doc_index_sync_changed": doc_index_sync_changed,
    "doc_index_after_sync": doc_index_after_sync,
    "lexical_topk": lexical_topk,
    "retrieve_for_questions": retrieve_for_questions,
    "route_questions": route_questions,
    "answer_sources": answer_sources,
    "prompt_batch": prompt_batch,
    "prompt_batch_hybrid": prompt_batch_hybrid,
    "exact_context": exact_context,
    "conversation_turns": conversation_turns,
    "conversation_history": conversation_history,
    "chat_requests": chat_requests,
    "retrieval_coverage": retrieval_coverage,
    "extract_chart": extract_chart,
    "vector_topk": vector_topk,
    "vector_topk_cells": vector_topk_cells,
    "embed_documents": embed_documents,
    "embed_documents_once": embed_documents_once,
    "retrieve_by_vector": retrieve_by_vector,
}
