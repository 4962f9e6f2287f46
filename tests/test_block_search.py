import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tradewell.operators import block_search, lexical, retrieval
from tradewell.sources import io

UNIT = 10**9


def rows_of(rng, n, n_codes, most):
    """Rows of a few of the codes, the first ones frequent; every fifth is a copy of row 0."""
    at, codes, w = [], [], []
    for i in range(n):
        if i % 5 == 0 and i:
            own = codes[: at.count(0)]
            v = w[: len(own)]
        else:
            own = sorted(set((rng.random(rng.integers(1, most)) ** 3 * n_codes).astype(int).tolist()))
            v = (rng.random(len(own)) + 0.1).tolist()
            v = [x / sum(y * y for y in v) ** 0.5 for x in v]
        at, codes, w = at + [i] * len(own), codes + list(own), w + v
    return np.array(at), np.array(codes), np.array(w)


@pytest.mark.parametrize("first_part,cost,long", [(1, 250, 256), (4, 0, 1), (10**9, 10**9, 3), (8, 250, 10**9)])
def test_the_best_of_a_block_by_few_exact_sums(monkeypatch, first_part, cost, long):
    """All codes in the matrix or none, added alone or together: the k best, and few sums but theirs."""
    monkeypatch.setattr(block_search, "ADDED_COST", cost)
    monkeypatch.setattr(block_search, "LONG", long)
    monkeypatch.setattr(block_search, "SCORES", 4000)
    rng, k, n, n_q, n_codes = np.random.default_rng(4), 3, 500, 40, 60
    at, codes, w = rows_of(rng, n, n_codes, 12)
    at_q, asked, v = rows_of(rng, n_q, n_codes, 6)
    starts = np.searchsorted(at_q, np.arange(n_q + 1))
    docs, asks = np.zeros((n, n_codes)), np.zeros((n_q, n_codes))
    docs[at, codes], asks[at_q, asked] = w, v
    want = np.rint(asks @ docs.T * UNIT).astype(np.int64)
    kept = block_search.first_of_copies(np.searchsorted(at, np.arange(n + 1)), codes, w, k)
    assert kept[1:5].all() and kept[::5].sum() == k and kept[0]
    place = np.flatnonzero(kept)
    at, codes, w = (x[kept[at]] for x in (at, codes, w))
    at = (np.cumsum(kept) - 1)[at]
    dense = block_search.dense_codes(np.bincount(codes, minlength=n_codes), np.bincount(asked, minlength=n_codes), len(place), n_q)
    block = block_search.Block(len(place), at, codes, w, n_codes, dense)
    found, looked = block_search.Found(n_q, k, float(UNIT), 0, 1), []
    exact = lambda q, d: looked.append(len(q)) or want[q, place[d]]
    q, d, s = block_search.near(block, starts, asked, v, found, exact, first_part)
    assert (want[q, place[d]] == s).all()
    got = {(i, x) for i, x in zip(q.tolist(), place[d].tolist())}
    for i in range(n_q):
        best = [j for j in np.lexsort((np.arange(n), -want[i]))[:k] if want[i, j] > 0]
        assert {(i, j) for j in best} <= got
        assert (found.best[i, : len(best)] == want[i, best]).all()
    assert sum(looked) <= n_q * 8 * k
    # A second block that holds nothing better gives nothing but equals.
    again, _, s = block_search.near(block, starts, asked, v, found, exact, first_part)
    assert (s >= found.best[again, -1]).all()


def test_questions_pass_the_blocks_of_documents_packed(spark):
    """What is repeated for every block is a part of the questions as one row, not each question."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, vec array<float>")
    plan = plan_of(retrieval.vector_topk(df.withColumnRenamed("doc_id", "question_id"), df, 5))
    assert "MapInArrow" in plan[plan.index("Generate explode") :]


def few_texts(spark):
    docs = [(i, f"a b{i % 7} c{i % 11} c{i % 3} shared") for i in range(200)] + [(5, "b1 b1 more"), (None, "c1 b2"), (None, "c1 lost")]
    asks = [(f"q{i}", f"b{i % 7} c{i % 5} a lost") for i in range(30)] + [("none", "zzz")]
    return spark.createDataFrame(asks, "question_id string, text string"), spark.createDataFrame(docs, "doc_id bigint, text string")


def test_texts_are_not_shuffled_for_the_index(spark):
    """Without repeated ids rows of the index are made where the texts are read; their weights, and
    those of repeated ids, are those of the documents."""
    _, docs = few_texts(spark)
    single = docs.filter("doc_id <> 5")
    assert "Exchange" not in plan_of(lexical.document_index(single, None))
    for some in (single, docs):
        words = some.select(F.explode(lexical.tokens(F.col("text"))).alias("term")).distinct().withColumn("code", F.xxhash64("term"))
        want = lexical.document_weights(some, words).collect()
        rows = lexical.document_index(some, None).collect()
        got = {(r.doc_id, c): w for r in rows for c, w in zip(r.codes, r.ws)}
        assert got == {(r.doc_id, r.code): pytest.approx(r.w, abs=1e-15) for r in want} and len(got) == len(want)
        assert len(rows) == len({r.doc_id for r in rows})


@pytest.mark.parametrize("name,value", [("SMALL_PAIRS", -1), ("SMALL_VOCABULARY", 0), ("BLOCK_WEIGHTS", 9), ("BLOCK_DOCS", 3), ("KEPT_PAIRS", 1), ("LOOKED_UP", 2), ("MANY_PAIRS", 0)])
def test_sizes_change_the_way_not_the_hits(spark, monkeypatch, name, value):
    asks, docs = few_texts(spark)
    want = sorted(map(str, lexical.lexical_topk(asks, docs).collect()))
    assert any("doc_id=None" in r for r in want)
    monkeypatch.setattr(lexical, name, value)
    found = lexical.lexical_topk(asks, docs)
    if name == "SMALL_PAIRS":
        # The weights of the documents are dealt out once, and the pairs by the same numbers.
        plan = plan_of(found)
        assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange hashpartitioning(d#") == 1
    assert sorted(map(str, found.collect())) == want


def test_large_files_are_read_where_they_lie(spark, tmp_path):
    """A file of many parts is not dealt out over the cores, a small one is."""
    spark.range(20000).selectExpr("id AS doc_id", "uuid() AS text").coalesce(1).write.parquet(str(tmp_path / "docs"))
    scan = spark.read.parquet(str(tmp_path / "docs"))
    assert "Exchange" in plan_of(io.spread(scan, "doc_id"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2**14))
    try:
        assert "Exchange" not in plan_of(io.spread(spark.read.parquet(str(tmp_path / "docs")), "doc_id"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_equal_questions_are_searched_once(spark, monkeypatch):
    """Questions that the documents don't tell apart are one row; each of them gets the hits."""
    rows = pa.table({"q": [7, 8, 9, 10, 11], "terms": [[{"code": c, "w": w} for c, w in t] for t in ([(3, 0.6), (5, 0.8)], [(5, 1.0)], [(5, 0.8), (3, 0.6)], [(3, 0.8), (5, 0.6)], [(5, 1.0)])]})
    asked = lexical._asked(rows)
    assert len(asked["starts"]) == 4 and sorted(np.split(asked["q"], asked["firsts"][1:-1])[i].tolist() for i in range(3)) == [[7, 9], [8, 11], [10]]
    monkeypatch.setattr(lexical, "SENT_PAIRS", 3)
    asks = spark.createDataFrame([(f"q{i}", f"hay x{i}" if i % 2 else f"y{i} stack") for i in range(20)], "question_id string, text string")
    docs = spark.createDataFrame([(1, "hay"), (2, "stack stack"), (3, "hay stack")], "doc_id bigint, text string")
    found = lexical.lexical_topk(asks, docs).collect()
    want = {(f"q{i}", d, s, r) for i in range(20) for d, s, r in ([(1 if i % 2 else 2, 1.0, 1), (3, round(2**-0.5, 6), 2)])}
    assert {(r.question_id, r.doc_id, r.score, r["rank"]) for r in found} == want and len(found) == 40
