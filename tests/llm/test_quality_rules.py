import math
import re
from collections import Counter
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from tradewell.llm import queries, quality_rules
from tradewell.llm.quality_rules import chance_at_most, choose_cutoffs, judge

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    words = re.findall(WORD, text)
    times = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {k for i in range(len(words) - 4) if times[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
        len(words) < 10 or 100 * len(repeated) > 20 * len(words),
    )


def measured(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_query_has_the_measures_of_every_text(spark, sf):
    got = {r.doc_id: r for r in queries.op6_quality_rules(spark, sf).collect()}
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        assert measured(got[doc_id]) == plain(text)
        assert not (got[doc_id].base_failed and got[doc_id].kept)


def test_chosen_rules_equal_sql(spark, sf):
    """With a loose bound, so that few labels prove something."""
    con = duckdb.connect()
    sf = sf.replace("sf0.001", "sf0.01")
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(quality_rules.sql(0.5, 0.2)).fetchall()
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = [tuple(r) for r in judge(docs, labels, max_rejected=0.5, chance=0.2).drop("broken").collect()]
    assert sorted(got) == sorted(want)
    assert any(not base and not kept for *_, base, kept in got)


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 5, 40, 700, 4000) for k in (0, 1, 2, 7, 15) if k <= n * 0.004]
    rows = spark.createDataFrame(cases, "k long, n long")
    for r in rows.select("k", "n", chance_at_most(F.col("k"), F.col("n"), 0.004).alias("p")).collect():
        want = sum(math.comb(r.n, i) * Fraction(4, 1000) ** i * Fraction(996, 1000) ** (r.n - i) for i in range(r.k + 1))
        assert abs(r.p - float(want)) < 1e-9 * float(want)


def rows(spark, n_good, n_bad, symbols_good=0, stratum="en"):
    """Good texts with ``symbols_good`` rows of many symbols among them, and bad ones with many."""
    schema = "stratum string, good boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"
    good = [(stratum, True, 100, 500, 60 if i < symbols_good else 0, 0, 10, 0) for i in range(n_good)]
    return spark.createDataFrame(good + [(stratum, False, 100, 500, 60, 0, 10, 0)] * n_bad, schema)


def test_cutoffs_need_enough_labels(spark):
    chosen = lambda *a: {(r.rule, r.cutoff) for r in choose_cutoffs(rows(spark, *a)).collect()}
    assert chosen(5000, 50) == {("symbols_per_word", 0.5)}  # the laxest that rejects all bad rows
    assert chosen(1000, 50) == set()  # (1 - 0.004) ** 1000 is above 0.05 / 47
    assert chosen(5000, 0) == set()  # nothing to gain
    assert chosen(5000, 5000, 100) == set()  # two percent of the good rows are too many
    assert chosen(30000, 5000, 50) == {("symbols_per_word", 0.5)}  # one in 600 is proven


def test_more_strata_need_stronger_proof(spark):
    one = rows(spark, 1800, 50)
    assert choose_cutoffs(one).count() == 1
    assert choose_cutoffs(one.unionByName(rows(spark, 10, 10, 0, "de"))).count() == 0


def test_odd_rows(odd, empty, clash, labels):
    got = judge(odd, labels).collect()
    want = sorted(str((r.doc_id, *plain(r.text))) for r in odd.collect())
    assert sorted(str((r.doc_id, *measured(r))) for r in got) == want
    assert all(r.kept != r.base_failed for r in got)  # no rule is proven by so few labels
    assert sorted(map(str, judge(clash, labels).collect())) == sorted(map(str, got))
    assert judge(empty, labels).collect() == []
    assert judge(odd, labels.limit(0)).count() == odd.count()
    assert quality_rules.CUTOFFS.keys() == quality_rules.rule_values().keys()
