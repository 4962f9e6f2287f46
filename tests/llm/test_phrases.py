import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import DOCS, same_rows
from tradewell.llm import phrases, queries
from tradewell.llm.phrases import Index, collocations, counts, filter_of, words_of


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_counts(rows, longest=3):
    """f of every phrase by language, from the rows (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f, n


def plain(rows, longest=3, least=10, covered=50, top=2000):
    f, n = plain_counts(rows, longest)
    out = set()
    for lang, of in f.items():
        wide = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in wide.items():
            cuts = [(1_000_000 * a * a // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(
                len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, b in wide.items()
            )
            if not inside:
                found.append((score, a, " ".join(p), of[p[:k]], of[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out |= {(lang, i, p, a, lf, r, n[lang], s) for i, (s, a, p, lf, r) in enumerate(found[:top], 1)}
    return out


def as_set(df):
    rows = [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_sql_and_plain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = as_set(queries.op11_phrases(spark, sf))
    assert got and got == plain([(r.lang, r.text) for r in docs.collect()])
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    cur = con.execute(phrases.SQL)
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in "lang rank phrase a l r n score".split()]
    assert got == {tuple(r[i] for i in at) for r in cur.fetchall()}


@pytest.mark.parametrize("longest,least,covered,top", [(3, 3, 50, 2000), (4, 2, 70, 2000), (2, 2, 50, 7), (3, 2, 100, 5), (5, 2, 30, 50)])
def test_small_tables_equal_plain(spark, monkeypatch, longest, least, covered, top):
    rng = np.random.default_rng(longest * 100 + least)
    vocabulary = ["of", "The", "the", "a", "ÄB", "äb", "x\x00y", "日本", "(note)", "b-c", " ", "d"]
    glue = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b", "; "]
    rows = []
    for i in range(160):
        n = int(rng.integers(0, 40))
        text = "".join(f"{vocabulary[min(int(rng.exponential(3)), 11)]}{glue[int(rng.integers(len(glue)))]}" for _ in range(n))
        rows.append((i, text if i % 17 else None, ["en", "fr", None, "und", ""][int(rng.integers(5))], "s", 0))
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    want = plain([(lang, text) for _, text, lang, _, _ in rows], longest, least, covered, top)
    assert as_set(collocations(docs, longest=longest, least=least, covered=covered, top=top)) == want


def test_index_counts_and_intervals():
    """Both directions count every phrase as often as it is there, over all orders of extension."""
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 5, 400).astype(np.int32)
    pieces = "".join(map(str, ids)).split("0")
    index = Index(ids, 4)
    levels = {(): index.single()}
    for way in ("l", "r", "ll", "lr", "rl", "rr", "lrl", "rlr", "llr", "rrl"):
        found = levels[tuple(way[:-1])]
        levels[tuple(way)] = found = (index.left if way[-1] == "l" else index.right)(found)
        want = Counter(p[i : i + len(way) + 1] for p in pieces for i in range(len(p) - len(way)))
        got = {"".join(map(str, w)): int(n) for w, n in zip(found.words.tolist(), found.count)}
        assert got == want and len(got) == len(found.count)


def test_filter_knows_all_that_it_was_given(spark):
    rows = [("en", f"word{i} ü") for i in range(3000)] + [("", "x"), ("日", "a b c")]
    known = filter_of(spark.createDataFrame(rows, "lang string, phrase string"), len(rows))
    hashes = lambda lang, p: phrases.word_hashes([(lang, w.encode()) for w in p.split(" ")])
    has = lambda known, lang, p: known.has(hashes(lang, p)[:, None])[0]
    assert all(has(known, lang, p) for lang, p in rows)
    assert np.mean([has(known, "en", f"other{i} ü") for i in range(3000)]) < 0.1
    assert not has(filter_of(spark.createDataFrame([], "lang string, phrase string"), 0), "en", "word1")


def test_stable_order():
    rng = np.random.default_rng(1)
    for keys in (rng.integers(0, 9, 1000), rng.integers(0, 1 << 60, 1000) // (1 << 58) * (1 << 58), np.zeros(0, np.int64), np.zeros(1, int)):
        assert phrases._order(keys).tolist() == np.argsort(keys, kind="stable").tolist()


def test_long_texts_in_cuts_and_shards(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CUT_BYTES", 16)
    text = "One two, three " + "four " * 30 + "five. six\n\n" + "x" * 50 + ";" + "é " * 20
    whole = [w for run in words_of(text.encode()) for w in run]
    folded = text.lower().replace(",", " \xff ").replace(".", " \xff ").replace("\n", " \xff ").replace(";", " \xff ")
    assert [w.decode("utf-8", "replace") for w in whole] == [x.replace("\xff", "�") for x in folded.split()] + ["�"]
    assert all(run[-1] == b"\xff" for run in words_of(text.encode()))
    assert list(words_of(b"")) == [[b"\xff"]]


def test_many_shards_sum_up(spark):
    """Shards of a few words each; the function runs in this process as the tasks' copy would."""
    import pyarrow as pa

    rows = [("en", b"a b c. a b"), ("fr", b"a b c"), ("en", None), ("en", b"b c a b c")] * 5
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([x for _, x in rows], pa.binary())], ["lang", "text"])
    total, before = Counter(), phrases.SHARD_WORDS
    phrases.SHARD_WORDS = 4
    try:
        shards = list(phrases._shards(iter([batch])))
    finally:
        phrases.SHARD_WORDS = before
    for ids, names in shards:
        index = Index(ids, 1)
        found = index.left(index.single())
        for w, n in zip(found.words.tolist(), found.count.tolist()):
            total[names[w[0] - 1][0], " ".join(names[i - 1][1].decode() for i in w)] += n
    f, _ = plain_counts([(lang, x.decode() if x else None) for lang, x in rows], 2)
    assert len(shards) > 5
    assert total == {(lang, " ".join(p)): n for lang, of in f.items() for p, n in of.items() if len(p) == 2}


def test_counts_beyond_64_bits(spark):
    """Products of counts of 13 digits: the exact quotient is kept."""
    from decimal import Decimal

    from pyspark.sql import functions as F

    a, lf, r = 4_000_000_000_003, 9_000_000_000_001, 7_000_000_000_009
    wide = lambda v: F.lit(Decimal(v)).cast("decimal(15,0)")
    row = spark.range(1).select(
        (F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a))).alias("over"), (wide(lf) * wide(r)).alias("under")
    )
    assert row.select(F.expr("over div under")).first()[0] == 1_000_000 * a * a // (lf * r)


def test_odd_rows(spark, odd, clash, empty):
    rows = [(r.lang, r.text) for r in odd.collect()]
    got = as_set(collocations(odd, least=2))
    assert got == plain(rows, least=2)
    assert as_set(collocations(clash, least=2)) == got
    assert as_set(collocations(odd)) == plain(rows)
    assert collocations(empty).collect() == []
    total, tables = counts(odd, least=1)
    f, n = plain_counts(rows)
    assert {(r.lang, r.n) for r in total.collect()} == {(k, v) for k, v in n.items() if v}
    for k, t in enumerate(tables, 1):
        want = {(lang, " ".join(p), a) for lang, of in f.items() for p, a in of.items() if len(p) == k}
        assert {tuple(r) for r in t.collect()} == want
    same_rows(collocations(odd, longest=1), collocations(empty))
