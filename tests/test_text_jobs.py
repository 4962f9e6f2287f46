import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tradewell.operators import block_topk, chat, documents, embedding_cache, index_sync, lexical, retrieval, vector_cells


def brute_lexical(questions, docs, k):
    def counts(t):
        return Counter(w for w in re.split(r"[\W_]+", t.lower()) if w)

    d = {i: counts(t) for i, t in docs}
    df = Counter(w for c in d.values() for w in c)
    out = set()
    for qid, text in questions:
        q = {w: n * math.log(1 + len(d) / df[w]) for w, n in counts(text).items() if w in df}
        ql = math.sqrt(sum(v * v for v in q.values()))
        scores = []
        for i, c in d.items():
            dot = sum(v * c[w] for w, v in q.items())
            if dot:
                scores.append((-round(dot / ql / math.sqrt(sum(n * n for n in c.values())), 6), i))
        out |= {(qid, i, -s, r) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["de", "la"] + [f"w{n}" for n in range(60)]
    make = lambda n: " ".join(rng.choice(words[: rng.choice([2, 10, 62])]) for _ in range(n))
    docs = [(i, make(rng.randint(1, 40))) for i in range(300)]
    # A third of all documents, and many questions, are copies of one text.
    docs = [(i, "de la w1 w2, w2!" if i % 3 == 0 else t) for i, t in docs]
    questions = [(f"q{i}", "W2 de" if i % 3 == 0 else make(rng.randint(1, 9))) for i in range(40)]
    questions += [("empty", "..."), ("unknown", "zzz")]
    return questions, docs


def as_frames(spark, texts):
    q = spark.createDataFrame(texts[0], "question_id string, text string")
    return q, spark.createDataFrame(texts[1], "doc_id bigint, text string")


@pytest.mark.parametrize("k", [1, 5, 200])
def test_lexical_topk_is_exact(spark, texts, k):
    got = lexical.lexical_topk(*as_frames(spark, texts), k=k).collect()
    assert {(r.question_id, r.doc_id, r.score, r.rank) for r in got} == brute_lexical(*texts, k)


@pytest.mark.parametrize("block_terms,first_part", [(7, 1), (20, 2), (500_000, 3), (3, 10**9)])
def test_blocks_do_not_change_the_result(spark, texts, monkeypatch, block_terms, first_part):
    """Many blocks of questions; all documents, some and none searched first for the scores to reach."""
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(lexical, "FIRST_PART", first_part)
    got = lexical.lexical_topk(*as_frames(spark, texts), k=5).collect()
    assert {(r.question_id, r.doc_id, r.score, r.rank) for r in got} == brute_lexical(*texts, 5)


def test_order_and_partitions_do_not_change_a_digit(spark, texts, monkeypatch):
    q, d = as_frames(spark, texts)
    want = sorted(map(str, lexical.lexical_topk(q, d).collect()))
    monkeypatch.setattr(lexical, "PARTS", 1)
    turned = lexical.lexical_topk(q.orderBy("text").repartition(7), d.orderBy("text").repartition(3))
    assert sorted(map(str, turned.collect())) == want


def test_sums_stay_where_the_documents_are(spark, texts):
    """One exchange deals the documents out; none follows the join until the k best are taken,
    no Python runs, and only checked blocks of questions are broadcast."""
    plan = plan_of(lexical.lexical_topk(*as_frames(spark, texts)))
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" not in plan
    main = plan[plan.index("HashAggregate(keys=[q#") :]
    before_scan = main[: main.index("FileScan")]
    assert before_scan.count("Exchange hashpartitioning(doc_id") == 1
    assert "Exchange hashpartitioning(q" not in before_scan


def test_weights_are_of_the_whole_document(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "doc_id bigint, text string")
    vocabulary = spark.createDataFrame([("a",)], "term string").repartition(2)
    weights = lexical.document_weights(docs, vocabulary)
    assert [(r.doc_id, r.term, round(r.w, 6)) for r in weights.collect()] == [(1, "a", round(2 / 5**0.5, 6))]


def test_odd_texts_and_empty_tables(spark):
    q = spark.createDataFrame([("q", "Hay"), ("n", None), ("e", "")], "question_id string, text string")
    docs = spark.createDataFrame([(1, None), (2, "hay hay"), (3, ""), (3, "HAY stack")], "doc_id bigint, text string")
    got = [(r.question_id, r.doc_id, r.score, r.rank) for r in lexical.lexical_topk(q, docs).orderBy("rank").collect()]
    # Rows of one id are one document.
    assert got == [("q", 2, 1.0, 1), ("q", 3, round(2**-0.5, 6), 2)]
    assert lexical.lexical_topk(q.limit(0), docs).collect() == []
    assert lexical.lexical_topk(q, docs.limit(0)).collect() == []


def test_long_documents_count_to_the_last_word(spark):
    far = " ".join(f"x{i}" for i in range(30000)) + " needle"
    docs = spark.createDataFrame([(1, far), (2, "hay")], "doc_id bigint, text string")
    q = spark.createDataFrame([("q", "needle")], "question_id string, text string")
    assert [r.doc_id for r in lexical.lexical_topk(q, docs).collect()] == [1]


def clustered(seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 8))
    vecs = centers[rng.integers(0, 12, 400)] + rng.normal(scale=0.05, size=(400, 8))
    vecs[100:230] = vecs[100]  # a third are copies
    vecs[7] = 0
    return vecs


def brute_vectors(vecs, k):
    v = vecs.astype(np.float32).astype(float)
    norm = np.linalg.norm(v, axis=1)
    scores = np.rint((v / np.where(norm > 0, norm, 1)[:, None]) @ (v / np.where(norm > 0, norm, 1)[:, None]).T * 1e6)
    alive = [i for i in range(len(v)) if norm[i] > 0]
    return {
        (i, j, r)
        for i in alive
        for r, j in enumerate(sorted((x for x in alive if x != i), key=lambda x: (-scores[i, x], x))[:k], 1)
    }


@pytest.mark.parametrize("search", [retrieval.vector_topk, vector_cells.vector_topk_cells])
@pytest.mark.parametrize("k", [1, 5])
def test_vector_topk_is_exact(spark, search, k, monkeypatch):
    monkeypatch.setattr(vector_cells, "DOCS_PER_BLOCK", 50)
    vecs = clustered(k)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "doc_id bigint, vec array<float>")
    q = df.withColumnRenamed("doc_id", "question_id")
    got = search(q, df, k, skip_same=True).collect()
    assert {(r.question_id, r.doc_id, r.rank) for r in got} == brute_vectors(vecs, k)


def test_cells_skip_far_cells(spark):
    vecs = clustered(3)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "doc_id bigint, vec array<float>")
    cells = vector_cells.build_cells(df, 5, n_cells=24)
    q = df.withColumnRenamed("doc_id", "question_id")
    visits = vector_cells.visited(q, cells, 5).groupBy("question_id").count().agg(F.avg("count")).first()[0]
    assert 1 <= visits < 12


@pytest.mark.parametrize("k,skip_same", [(1, True), (5, True), (3, False)])
def test_pivots_of_pivots_are_exact(spark, k, skip_same, monkeypatch):
    """Three levels, cells of many groups, and copies that no pivot splits; same rows as all pairs."""
    for name, n in [("N_CELLS", 4), ("ROWS_PER_CELL", 10), ("PLACED_ROWS", 16), ("DOCS_PER_BLOCK", 32), ("QUESTIONS_PER_BLOCK", 90)]:
        monkeypatch.setattr(vector_cells, name, n)
    vecs = clustered(20 + k)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "doc_id bigint, vec array<float>")
    q = df.withColumnRenamed("doc_id", "question_id")
    got = vector_cells.vector_topk_cells(q, df, k, skip_same=skip_same).orderBy("question_id", "rank").collect()
    want = retrieval.vector_topk(q, df, k, skip_same=skip_same).orderBy("question_id", "rank").collect()
    assert len(got) == 399 * k and [tuple(r) for r in got] == [tuple(r) for r in want]


def test_levels_split_large_cells_and_what_is_collected_does_not_grow(spark, monkeypatch):
    frame, taken = type(spark.range(1)), []
    collect, arrow = frame.collect, frame.toArrow
    monkeypatch.setattr(frame, "collect", lambda df: taken.append(len(rows := collect(df))) or rows)
    monkeypatch.setattr(frame, "toArrow", lambda df: taken.append((rows := arrow(df)).num_rows) or rows)
    vecs = clustered(9)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "doc_id bigint, vec array<float>")
    q = df.withColumnRenamed("doc_id", "question_id")
    cells = vector_cells.build_cells(df, 5, n_cells=4, rows_per_cell=10)
    visits = vector_cells.visited(q, cells, 5)
    assert taken and max(taken) <= 4
    monkeypatch.undo()
    assert len(cells.levels) == 3
    held = {r.cell: r.n for r in cells.docs.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    leaves = {r.cell: r.n for level in cells.levels for r in level.filter("leaf").collect()}
    assert held == leaves and sum(held.values()) == 399
    for upper, lower in zip(cells.levels, cells.levels[1:]):
        split = {r.cell: r.n for r in upper.filter("not leaf").collect()}
        inside = {r.parent: r.n for r in lower.groupBy("parent").agg(F.sum("n").alias("n")).collect()}
        assert split == inside and min(split.values()) > 10
    some = visits.groupBy("question_id").count().agg(F.avg("count")).first()[0]
    assert 1 <= some < len(leaves) / 2


def test_no_documents_and_no_questions_for_cells(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "doc_id bigint, vec array<float>")
    q = df.withColumnRenamed("doc_id", "question_id")
    assert vector_cells.vector_topk_cells(q, df.limit(0), 5).collect() == []
    assert vector_cells.vector_topk_cells(q.limit(0), df, 5).collect() == []
    assert [tuple(r) for r in vector_cells.vector_topk_cells(q, df, 5).collect()] == [(1, 1, 1.0, 1)]


def test_fewer_documents_than_k(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id bigint, vec array<float>")
    q = df.withColumnRenamed("doc_id", "question_id")
    assert vector_cells.vector_topk_cells(q, df, 5).count() == 4


def test_hashing_embedder(spark):
    docs = spark.createDataFrame([(1, "receita total"), (2, "Receita mensal"), (3, "outro"), (4, "")], "doc_id bigint, text string")
    embed = retrieval.hashing_embedder(retrieval.fit_idf(docs, dim=256), dim=256)
    vecs = {r.doc_id: np.array(r.vec) for r in embed(docs).collect()}
    assert all(len(v) == 256 for v in vecs.values())
    assert np.linalg.norm(vecs[1]) == pytest.approx(1, abs=1e-6) and not vecs[4].any()
    assert vecs[1] @ vecs[2] > 0 and vecs[1] @ vecs[3] == 0
    q = spark.createDataFrame([("q", "receita mensal?")], "question_id string, text string")
    assert retrieval.retrieve(q, docs, 1, embed).first().doc_id == 2


def test_model_embedder_loads_once_per_task(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("ab",), ("c",)], "text string")
    assert [r.vec for r in retrieval.model_embedder(load)(df).collect()] == [[2.0, 1.0], [1.0, 1.0]]


def test_a_text_is_embedded_once(spark):
    """Copies in a load, and texts of earlier loads, do not reach the model; nulls have no vector."""
    sent, loaded = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        loaded.add(1)

        def model(texts):
            sent.add(len(texts))
            return [[float(len(t))] for t in texts]

        return model

    embed = embedding_cache.worker_embedder("lengths-of-this-test", load)
    docs = [(i, "copy" if i % 3 == 0 else None if i == 4 else "" if i == 5 else f"text {i}", "own") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, vec string").repartition(7)
    different = {t for _, t, _ in docs if t is not None}
    spark.sql("DROP TABLE IF EXISTS cache_of_test")
    try:
        for rows, new in ((df.limit(0), 0), (df, len(different)), (df, 0), (df.selectExpr("doc_id", "concat(text, '!') AS text"), len(different))):
            before = sent.value
            got = embedding_cache.embed_once(rows, embed, "cache_of_test").select("doc_id", "text", "vec").collect()
            assert sent.value - before == new
            assert len(got) == rows.count()
            assert all(r.vec == (None if r.text is None else [float(len(r.text))]) for r in got)
            assert len({r.doc_id for r in got}) == len(got)
        cache = spark.table("cache_of_test")
        assert cache.count() == cache.select("text_hash").distinct().count() == 2 * len(different)
        before, n = loaded.value, 50
        for _ in range(3):
            embed(spark.range(n).select(F.col("id").cast("string").alias("text")).repartition(5)).collect()
        # Workers come and go, but few of the fifteen tasks load.
        assert loaded.value - before < 15
    finally:
        spark.sql("DROP TABLE IF EXISTS cache_of_test")


def test_index_sync_converges(spark):
    source = spark.createDataFrame([("a", "1"), ("b", "new"), ("c", "3")], "doc_id string, text string")
    held = spark.createDataFrame([("a", "1"), ("b", "old"), ("z", "9")], "doc_id string, text string")
    embed = lambda df: df.select("doc_id", "text_hash", F.length("text").alias("vec"))
    current = embed(held.withColumn("text_hash", index_sync.text_hash()))
    plan = {r.doc_id: r.action for r in index_sync.index_sync_plan(source, current).collect()}
    assert plan == {"a": "same", "b": "update", "c": "insert", "z": "delete"}
    after = index_sync.apply_sync(source, current, embed)
    assert {r.action for r in index_sync.index_sync_plan(source, after).collect()} == {"same"}
    assert after.count() == 3


def test_sentences(spark):
    row = spark.createDataFrame(
        [("C1", "Ana", None, "SP", 2, 1234.5, 617.25, "2024-01-01", "2024-02-01", 1)],
        "customer_id string, customer_name string, city string, state string, total_orders int, total_revenue double, "
        "avg_ticket double, first_order_date string, last_order_date string, rank int",
    )
    doc = documents.customer_docs(row).first()
    assert doc.doc_id == "customer_C1" and doc.text == (
        "Cliente Ana da cidade None, estado SP. Realizou 2 pedidos com receita total de R$ 1.234,50. "
        "Ticket médio de R$ 617,25. Primeiro pedido em 2024-01-01 e último em 2024-02-01. Ranking de receita: #1."
    )
    assert "cidade -," in documents.customer_docs(row, null_text="-").first().text


def test_router(spark):
    df = spark.createDataFrame([("1", "Meu LAPTOP"), ("2", "Qual a Receita?"), ("3", "Bom dia")], "question_id string, text string")
    flags = lambda d: [r.is_analytical for r in d.orderBy("question_id").collect()]
    assert flags(chat.route_questions(df)) == [True, True, False]
    assert flags(chat.route_questions(df, whole_words=True)) == [False, True, False]


def test_sources_and_prompts(spark):
    questions = spark.createDataFrame([("a", "oi"), ("b", "receita?"), ("c", "nada")], "question_id string, text string")
    docs = spark.createDataFrame([(i, "kpi", f"T{i}") for i in range(6)], "doc_id bigint, doc_type string, text string")
    hits = spark.createDataFrame(
        [(q, 5 - r, 1.0 / r, r) for q in "ab" for r in range(1, 6)], "question_id string, doc_id bigint, score double, rank int"
    )
    routed = chat.route_questions(questions)
    sources = chat.answer_sources(routed, hits, docs).groupBy("question_id").count().collect()
    assert {r.question_id: r["count"] for r in sources} == {"a": 6, "b": 1, "c": 1}
    assert chat.answer_sources(routed, hits, docs, limit=4).count() == 6
    found = chat.hits_with_text(hits, docs)
    prompts = {r.question_id: r.prompt for r in chat.build_prompts(questions, found).collect()}
    assert set(prompts) == {"a", "b"}
    assert prompts["a"].startswith("CONTEXTO (dados do e-commerce):\n[Documento 1 - kpi]\nT4\n\n[Documento 2 - kpi]\nT3")
    exact = spark.createDataFrame([("X",)], "context string")
    hybrid = {r.question_id: r.prompt for r in chat.build_prompts_hybrid(routed, found, exact).collect()}
    assert hybrid["b"] == "CONTEXTO DO VECTOR SEARCH:\n\n\nX\n\nPERGUNTA:\nreceita?"
    assert "[Doc 5 - kpi]\nT0\n\nX" in hybrid["a"]
    answers = spark.createDataFrame([("a", "x" * 21), ("b", "x" * 20)], "question_id string, answer string")
    cover = {r.question_id: (r.documents, r.reply is None, r.answered) for r in chat.retrieval_coverage(questions, hits, answers).collect()}
    assert cover == {"a": (5, True, True), "b": (5, True, False), "c": (0, False, False)}


def test_history_is_whole(spark):
    turns = spark.createDataFrame(
        [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in reversed(range(700))] + [(2, 0, "system", None)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    whole = {r.conv_id: [(m.role, m.content) for m in r.history] for r in chat.conversation_history(turns).collect()}
    assert whole == {1: [("user" if t % 2 == 0 else "model", f"m{t}") for t in range(700)], 2: [("model", "")]}


def test_requests_are_rows_in_order(spark):
    prompts = spark.createDataFrame([("a", "P"), ("b", "Q")], "question_id string, prompt string")
    said = spark.createDataFrame([("a", 1, "model", "y"), ("a", 0, "user", "x"), ("z", 0, "user", "?")], "question_id string, turn bigint, role string, content string")
    rows = chat.chat_requests(prompts, said, "S").orderBy("question_id", "position").collect()
    assert [(r.question_id, r.role, r.content) for r in rows] == [
        ("a", "system", "S"), ("a", "user", "x"), ("a", "model", "y"), ("a", "user", "P"), ("b", "system", "S"), ("b", "user", "Q"),
    ]


GOOD = {"chart_type": "line", "x": ["A"], "y": [1.5], "title": "T", "xaxis": "X", "yaxis": "Y"}


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        (GOOD, ("line", ["A"], [1.5], "T", "X", "Y")),
        ({}, ("bar", [], [], "", "", "")),
        ({"x": ["a"], "y": ["10", 2, True]}, ("bar", ["a"], [10.0, 2.0, 1.0], "", "", "")),
        ({**GOOD, "x": [1]}, None),
        ({**GOOD, "x": ["a", 1]}, None),
        ({**GOOD, "x": None}, None),
        ({**GOOD, "x": "abc"}, None),
        ({**GOOD, "x": [["a"]]}, None),
        ({**GOOD, "y": ["dez"]}, None),
        ({**GOOD, "y": [None]}, None),
        ({**GOOD, "y": {}}, None),
        ({**GOOD, "title": 7}, None),
        ({**GOOD, "title": None}, None),
        (["a"], None),
        (5, None),
    ],
)
def test_chart_extraction(spark, payload, want):
    text = f" Resposta. \n***\n{json.dumps(payload)}\n*** fim"
    row = chat.extract_chart(spark.createDataFrame([(1, text)], "id int, text string")).first()
    assert row.answer == "Resposta."
    got = row.chart and (row.chart.type, row.chart.x, row.chart.y, row.chart.title, row.chart.xaxis_title, row.chart.yaxis_title)
    assert got == want


def test_answers_without_chart(spark):
    rows = chat.extract_chart(
        spark.createDataFrame([(1, "  só texto "), (2, "a *** {x"), (3, "a***"), (4, "***{}"), (5, None)], "id int, text string")
    ).orderBy("id").collect()
    assert [r.answer for r in rows] == ["  só texto ", "a", "a", "", None]
    assert [r.chart is None for r in rows] == [True, True, True, False, True]


@pytest.mark.parametrize("first_part", [1, 4, 10**9])
def test_places_that_may_be_among_the_best(monkeypatch, first_part):
    monkeypatch.setattr(lexical, "FIRST_PART", first_part)
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 50, 400):
        sums = rng.integers(0, 7, n) * 10**16 + rng.integers(0, 3, n) * lexical.SLACK // 2
        for k in (1, 5):
            near = lexical._near_places(sums, k)
            best = [i for i in np.lexsort((np.arange(n), -sums))[:k] if sums[i]]
            assert set(best) <= set(near)
            assert Counter(sums[near]).total() <= 4 * k


def test_pairs_of_questions_and_documents_are_no_rows(spark):
    """All documents hold the term of all questions; only the k first copies leave a block."""
    index = spark.createDataFrame([(i, [7, 8], [0.6, 0.8]) for i in range(3000)], "doc_id bigint, codes array<bigint>, ws array<double>")
    asked = spark.createDataFrame([(q, 7, 1.0) for q in range(400)], "q bigint, code bigint, w double")
    near = lexical._near_pairs(index, 6000, asked, 5)
    assert {(r.q, r.d) for r in near.collect()} >= {(q, d) for q in range(400) for d in range(5)}
    blocks = min(8 * lexical.BLOCKS_A_CORE, 6000 // lexical.LEAST_WEIGHTS + 1)
    assert near.count() <= 400 * 5 * blocks


def test_a_document_without_an_id_is_one_document(spark):
    q = spark.createDataFrame([("q", "hay")], "question_id string, text string")
    docs = spark.createDataFrame([(None, "hay"), (None, "stack"), (2, "hay stack")], "doc_id bigint, text string")
    got = [(r.doc_id, r.rank) for r in lexical.lexical_topk(q, docs).orderBy("rank").collect()]
    assert got == [(None, 1), (2, 2)]


def test_vectors_are_shuffled_once_and_questions_once_a_block(spark, monkeypatch):
    """Documents of several blocks, parts of questions: one row of the shuffle for a document."""
    monkeypatch.setattr(block_topk, "DOCS_HELD", 90)
    monkeypatch.setattr(block_topk, "QUESTIONS_PER_BLOCK", 32)
    vecs = clustered(6)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "doc_id bigint, vec array<float>")
    found = retrieval.vector_topk(df.withColumnRenamed("doc_id", "question_id"), df, 5, skip_same=True)
    plan = plan_of(found)
    assert plan.count("Generate explode") == 1 and "CoGroup" not in plan
    assert {(r.question_id, r.doc_id, r.rank) for r in found.collect()} == brute_vectors(vecs, 5)
