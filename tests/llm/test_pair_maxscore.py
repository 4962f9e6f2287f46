import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import DOCS
from tradewell.llm import pair_maxscore, queries
from tradewell.llm.pair_maxscore import Best, Item, Plan, Shard, bounds, length_parts, neighbours, rank, search, terms_of

ITEMS = "item_id long, text string"


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, k=20):
    """Every document scored for every item."""
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * len(held) + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in {(i, t) for i, t in items}:
        asked = Counter(plain_terms(text))
        scores = []
        for i, c in held:
            m = 75 + 25 * c.total() * len(held) // total
            s = sum(n * w[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


def test_query_equals_sql_and_plain(spark, sf):
    got = queries.op13_pair_maxscore(spark, sf)
    assert [f.dataType.simpleString() for f in got.select("item_id", "rank", "doc_id", "score").schema] == ["bigint", "int", "bigint", "bigint"]
    got = rows_of(got)
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert got and got == plain([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = con.execute(f"select item_id, rank, doc_id, score from ({pair_maxscore.SQL})").fetchall()
    assert got == sorted(map(str, want))


def made(rng, n, words=60):
    return " ".join(f"w{min(int(rng.exponential(8)), words)}" for _ in range(n))


@pytest.mark.parametrize("k", [1, 3, 20])
def test_many_shards_equal_plain(spark, monkeypatch, k):
    rng = np.random.default_rng(k)
    rows = [(i, made(rng, int(rng.integers(0, 60))), "en", "s", 0) for i in range(500)]
    rows += [(1000 + i, rows[7][1], "en", "s", 0) for i in range(30)] + [(5, "w1 w2 w1", "en", "s", 0)] * 3
    items = [(i, made(rng, int(rng.integers(1, 25)))) for i in range(30)] + [(99, "nothing here"), (98, None), (97, "")]
    docs, asked = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    want = plain([(r[0], r[1]) for r in rows], items, k)
    assert rows_of(rank(docs, asked, k=k)) == want
    monkeypatch.setattr(pair_maxscore, "BLOCK_BYTES", 300)  # several blocks of items
    assert rows_of(rank(docs, asked, k=k)) == want


def test_shards_skip_and_lose_nothing():
    """Shards one after the other, with and without stored pairs, against all scores."""
    rng = np.random.default_rng(4)
    size, k = 40, 5
    weights = rng.integers(0, 5000, size)
    items = []
    for _ in range(20):
        terms = rng.choice(size, 10, replace=False)
        order = np.lexsort((terms, -weights[terms]))
        items.append(Item(terms[order], rng.integers(1, 4, 10)))
    plan = Plan(items, weights, 600, 600 * 12)
    for stored_pairs in (plan.pairs(), []):
        every, best = defaultdict(list), [Best(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        looked = 0
        for s in range(6):
            words = rng.integers(6, 30, 100)
            term = [np.sort(rng.choice(size, int(rng.integers(0, 7)), replace=False)) for _ in words]
            sizes = np.array([len(t) for t in term])
            term = np.concatenate(term)
            tf = rng.integers(1, 4, len(term))
            shard = plan.shard(words, term, tf, sizes)
            ids = np.arange(100) + 100 * s
            stored = shard.pairs(stored_pairs, k)
            part, doc = length_parts(words, 600, 7200), np.repeat(np.arange(100), sizes)
            impact = [int(weights[t]) * (10**9 * int(f) // (1000 * int(f) + 12 * int(part[d]))) for t, f, d in zip(term, tf, doc)]
            for q, item in enumerate(items):
                times = dict(zip(item.terms.tolist(), item.times.tolist()))
                total = Counter()
                for t, d, s_ in zip(term.tolist(), doc.tolist(), impact):
                    total[d] += times.get(t, 0) * s_
                parts = bounds(shard, item, stored)
                assert sorted(t for _, p in parts for t in p) == sorted(t for t in times if shard.most[t])
                for bound, terms in parts:  # no document gets more from a part than its bound
                    got = Counter()
                    for t, d, s_ in zip(term.tolist(), doc.tolist(), impact):
                        got[d] += times[t] * s_ if t in terms else 0
                    assert max(got.values(), default=0) <= bound
                every[q] += [(-v, int(ids[d])) for d, v in total.items() if v > 0]
                looked += search(shard, item, stored, ids, best[q], k)
        for q in range(len(items)):
            assert list(zip((-best[q].score).tolist(), best[q].doc.tolist())) == sorted(every[q])[:k]
        if stored_pairs:
            with_pairs = looked
    assert with_pairs < sum(map(len, every.values()))  # some documents were never looked at


def test_stored_pairs_are_of_the_intersection():
    rng = np.random.default_rng(6)
    term = rng.integers(0, 6, 300)
    doc = rng.integers(0, 80, 300)
    term, doc = np.unique(np.stack([term, doc]), axis=1)
    impact = rng.integers(1, 1000, len(term))
    shard = Shard(term, doc, impact, 80, 7)
    of = {(t, d): s for t, d, s in zip(term.tolist(), doc.tolist(), impact.tolist())}
    wanted = [(a, b) for a in range(7) for b in range(a)]
    stored = shard.pairs(wanted, 4)
    assert set(stored) == {p for p in wanted if 6 not in p}  # the last term is in no document
    for (a, b), (most, kth) in stored.items():
        joint = sorted((of[a, d] + of[b, d] for d in range(80) if (a, d) in of and (b, d) in of), reverse=True)
        assert most == max(joint, default=0) and kth == (joint[3] if len(joint) > 3 else 0)


def test_pair_bounds_are_tighter():
    """Two terms that no document has both of count as the larger alone."""
    shard = Shard(np.array([0, 1]), np.array([0, 1]), np.array([70, 50]), 2, 2)
    item = Item(np.array([0, 1]), np.array([1, 1]))
    assert bounds(shard, item, shard.pairs(neighbours(item), 2)) == [(70, [0, 1])]
    assert bounds(shard, item, {}) == [(50, [1]), (70, [0])]


def test_lengths_beyond_64_bits():
    words, n = np.array([10**10, 3]), 10**10
    assert length_parts(words, n, 10**13).tolist() == [75 + 25 * 10**20 // 10**13, 75 + 75 * 10**10 // 10**13]
    assert length_parts(np.zeros(0, np.int64), 0, 0).tolist() == []


def test_terms():
    for text in ("It's A-Z, 0x1F_é日本 ÀÉ\x00\x7f x", "", " \n", "x" * 100_000):
        assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)
    assert terms_of(None) == []


def test_odd_rows(spark, odd, clash, empty):
    items = [(1, "the QUICK fox, a row"), (1, "the QUICK fox, a row"), (2, "é日本"), (None, "line item id"), (3, None), (4, "zzz"), (1, "lorem")]
    asked = spark.createDataFrame(items, ITEMS)
    want = plain([(r.doc_id, r.text) for r in odd.collect()], [i for i in items])
    assert want and rows_of(rank(odd, asked)) == want
    assert rows_of(rank(clash, asked)) == want
    assert rank(empty, asked).collect() == [] and rank(odd, asked.limit(0)).collect() == []
