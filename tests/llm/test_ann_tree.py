import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewell.llm import ann_tree, queries
from tradewell.llm.ann_tree import grow, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, ask, k=20):
    """All candidates of every query, in double precision, summed in order."""
    ok = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if i is not None and v and usable(v)]
    out = {}
    for q, v in sorted((i, v) for i, v in ok if ask(i)):
        if q not in out:
            scored = sorted((-ordered(v, w), i) for i, w in ok if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def usable(v):
    return all(c is not None and math.isfinite(c) for c in v) and any(v)


def ordered(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def shown(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def test_recall_of_the_query(spark, sf):
    got = shown(queries.op7_ann_tree(spark, sf))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = plain([tuple(r) for r in rows], lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    score = {(q, i): s for q, found in plain([tuple(r) for r in rows], lambda i: i % 20 == 0, 10**6).items() for i, s in found}
    hits = 0
    for q, found in got.items():
        assert len(found) == 20 and all(score[q, i] == s for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def vectors(n, seed=1, d=6):
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(np.random.default_rng(seed).normal(size=(n, d)))]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def test_all_candidates_where_there_are_few(spark):
    rows = vectors(15)
    assert shown(nearest(frame(spark, rows), F.col("id") % 5 == 0)) == plain(rows, lambda i: i % 5 == 0)


def test_one_vector_in_a_third_of_the_rows(spark, monkeypatch):
    """Its leaf is larger than a shard; of equal scores the smallest ids are returned."""
    monkeypatch.setattr(ann_tree, "SHARD_ROWS", 64)
    monkeypatch.setattr(ann_tree, "QUERY_ROWS", 16)
    rows = vectors(600)
    rows += [(600 + i, [5.0] * 6) for i in range(300)]
    got = shown(nearest(frame(spark, rows), F.col("id") % 20 == 0, target=1.0))
    want = plain(rows, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    same = sum(got[q] == want[q] for q in want)
    assert same >= 0.9 * len(want)
    assert got[620] == want[620] and got[620][0] == (600, 150.0)


def test_rows_that_take_no_part(spark):
    rows = vectors(40)
    bad = [(100, None), (120, [0.0] * 6), (140, [1.0, None, *[0.0] * 4]), (160, [math.nan] * 6), (180, [math.inf] * 6)]
    bad += [(200, []), (220, [1.0, 2.0]), (None, [9.0] * 6)]
    assert shown(nearest(frame(spark, rows + bad), F.col("id") % 20 == 0)) == plain(rows, lambda i: i % 20 == 0)


def test_repeated_rows_large_lengths_and_no_rows(spark):
    rows = vectors(30)
    rows += [rows[0], rows[0], rows[3], (31, [1e6] * 6), (40, [1e-30] * 6)]
    df = frame(spark, rows)
    want = plain(rows, lambda i: i % 20 == 0)
    assert shown(nearest(df, F.col("id") % 20 == 0)) == want
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("id", "v", "leaf", "shard", "part", "block", "query")])
    assert shown(nearest(clash, F.col("id") % 20 == 0)) == want
    assert nearest(frame(spark, []), F.col("id") % 20 == 0).collect() == []
    assert nearest(df, F.col("id") < 0).collect() == []


def test_tree_order_is_by_distance():
    x = np.random.default_rng(3).normal(size=(500, 4))
    tree = grow(x, float(np.sqrt((x * x).sum(1)).max()))
    leaf = tree.assign(x)
    assert sorted(set(leaf)) == list(range(tree.leaves))
    assert sorted(tree.visits(tree.far(x[:1])[0])) == list(range(tree.leaves))
    turn = [list(tree.visits(far)).index(a) for far, a in zip(tree.far(x[:100]), leaf, strict=False)]
    assert np.mean(turn) < tree.leaves / 3
    assert grow(np.ones((200, 3)), math.sqrt(3)).leaves >= 1


@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_breaks_ties_by_id(k):
    queries, ids = np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([5, 9, 3, 7, 1])
    vectors = np.array([[1.0, 4.0], [2.0, 4.0], [2.0, 4.0], [2.0, 4.0], [0.0, 4.0]])
    row, at, score = ann_tree.best(queries @ vectors.T, queries, vectors, ids, k)
    assert ids[at[row == 0]].tolist() == [3, 7, 9, 5, 1][:k] and ids[at[row == 1]].tolist() == [1, 3, 5, 7, 9][:k]
    assert score[row == 0].tolist() == [2.0, 2.0, 2.0, 1.0, 0.0][:k]
    near = np.where(np.arange(5) == 2, -np.inf, queries @ vectors.T)
    row, at, _ = ann_tree.best(near, queries, vectors, ids, k)
    assert ids[at[row == 0]].tolist() == [7, 9, 5, 1][:k]
