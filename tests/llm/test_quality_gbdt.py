import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tradewell.llm import queries
from tradewell.llm.quality_gbdt import FEATURES, Trees, classify, fit, keep_good, statistics


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_labels_are_told_apart(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest table has few labels
    got = {r.doc_id: r for r in queries.op3_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    known = [(got[i].predicted, q) for i, q in labels.items() if held(i)]
    assert len(known) > 50
    assert np.mean([p == q for p, q in known]) >= 0.9


def test_labels_of_held_out_ids_do_not_matter(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    swapped = labels.withColumn(
        "quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    score = lambda y: {r.doc_id: r.score for r in classify(docs, y).collect()}
    assert score(labels) == score(swapped)


def walk(trees, row):
    """One row through one tree after another, node by node."""
    total = trees.start
    for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
        total += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] * x[:, 1] > 0.2)).astype(float)
    trees = fit(x, y, trees=40, depth=3)
    fast = trees.score(x)
    assert fast == pytest.approx([walk(trees, r) for r in x])
    assert ((fast > 0.5) == y).mean() > 0.9


def plain_boost(x, y, trees, depth, rate=0.12, penalty=2.0, least=20):
    """Probabilities after boosting with every cut between two values tried, node by node."""
    total = np.full(len(y), math.log((sum(y) + 0.5) / (len(y) + 0.5 - sum(y))))

    def value(g, h):
        return g * g / (h + penalty)

    def grow(rows, left_levels, g, h):
        best, at = 1e-6, None
        for f in range(x.shape[1] if left_levels else 0):
            for cut in sorted({x[i, f] for i in rows}):
                left, right = [i for i in rows if x[i, f] <= cut], [i for i in rows if x[i, f] > cut]
                if min(len(left), len(right)) < least:
                    continue
                sums = [(sum(g[i] for i in part), sum(h[i] for i in part)) for part in (left, right, rows)]
                gain = value(*sums[0]) + value(*sums[1]) - value(*sums[2])
                if gain > best:
                    best, at = gain, (left, right)
        if at is None:
            step = rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + penalty)
            return {i: step for i in rows}
        return {**grow(at[0], left_levels - 1, g, h), **grow(at[1], left_levels - 1, g, h)}

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        steps = grow(range(len(y)), depth, y - p, p * (1 - p))
        total = total + np.array([steps[i] for i in range(len(y))])
    return 1 / (1 + np.exp(-total))


@pytest.mark.parametrize("seed,depth", [(0, 1), (1, 2), (2, 3)])
def test_fit_equals_boosting_over_all_cuts(seed, depth):
    """Few values a feature, so that the bins part all of them; one feature of a single value."""
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 7, 300), rng.integers(0, 5, 300) / 4, np.full(300, 3.0), rng.integers(0, 6, 300) ** 2], 1)
    y = (rng.random(300) < 1 / (1 + np.exp(x[:, 0] - 3 - 2 * x[:, 1] * (x[:, 3] > 4)))).astype(float)
    got = fit(x, y, trees=5, depth=depth).score(x)
    assert got == pytest.approx(plain_boost(x, y, 5, depth), abs=1e-9)


TEXTS = (
    "The  quick brown fox.\nThe  quick brown fox.\n\n- No 12, no 13! #tag | end",
    "a a a b a b é日本 ÀB \"x\" 3.14 " * 7,
    "One line only, without an end",
    "x",
)


def plain_statistics(text):
    """Features by name, character by character and word by word."""
    n, words = len(text), text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda of: sum(of(c) for c in text) / n
    sizes = [len(w) for w in words]
    mean = sum(sizes) / len(words)
    threes = list(zip(words, words[1:], words[2:]))
    kinds = Counter(min(ord(c), 128) for c in text)  # characters beyond ASCII are one kind
    return {
        "log_chars": math.log(1 + n),
        "log_words": math.log(1 + len(words)),
        "log_lines": math.log(1 + len(lines)),
        "word_mean": mean,
        "word_sd": math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(words)),
        "word_max": math.log(1 + max(sizes)),
        "upper_share": share(lambda c: c.isascii() and c.isupper()),
        "digit_share": share(lambda c: c.isascii() and c.isdigit()),
        "space_share": share(lambda c: c.isascii() and c.isspace()),
        "letter_share": share(lambda c: not c.isascii() or c.isalpha()),
        "other_share": share(lambda c: not c.isascii()),
        "bang_share": share(lambda c: c == "!"),
        "pipe_share": share(lambda c: c == "|"),
        "comma_share": share(lambda c: c == ","),
        "quote_share": share(lambda c: c in "\"'"),
        "distinct_words": len(set(words)) / len(words),
        "top_word": max(words.count(w) for w in words) / len(words),
        "stutter": sum(a == b for a, b in zip(words, words[1:])) / len(words),
        "echo": sum(a == b for a, b in zip(words, words[2:])) / len(words),
        "capital_words": sum(w[0].isupper() for w in words) / len(words),
        "no_letter_words": sum(all(not c.isalpha() for c in w) for w in words) / len(words),
        "distinct_lines": len(set(lines)) / len(lines),
        "line_mean": math.log(1 + sum(map(len, lines)) / len(lines)),
        "short_lines": sum(len(x) < 30 for x in lines) / len(lines),
        "repeat_three": 1 - len(set(threes)) / max(1, len(threes)),
        "char_entropy": -sum(c / n * math.log2(c / n) for c in kinds.values()),
    }


@pytest.mark.parametrize("text", TEXTS)
def test_statistics_equal_plain_counts(text):
    got = dict(zip(FEATURES, statistics(text), strict=True))
    for name, want in plain_statistics(text).items():
        assert got[name] == pytest.approx(want, abs=1e-9), name


def test_fit_without_rows_or_with_one_class():
    none = fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    assert isinstance(none, Trees) and none.score(np.zeros((2, len(FEATURES)))).tolist() == [0.5, 0.5]
    assert (fit(np.ones((50, 3)), np.ones(50)).score(np.ones((1, 3))) > 0.9).all()
    assert np.isfinite(fit(np.ones((50, 3)), np.arange(50) % 2).score(np.ones((1, 3)))).all()


@pytest.mark.parametrize("text", ["", " \n", "a", "x" * 10_000, "\x00﻿🙂", "A B C!! " * 50])
def test_statistics_are_finite(text):
    found = statistics(text)
    assert len(found) == len(FEATURES) and np.isfinite(found).all()


def test_odd_rows(odd, empty, clash, labels):
    got = classify(odd, labels)
    assert got.count() == odd.count()
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert {r.held_out for r in got.filter("doc_id is null").collect()} == {False}
    assert sorted(map(str, classify(clash, labels).collect())) == sorted(map(str, got.collect()))
    assert classify(empty, labels).collect() == []
    none = classify(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_what_is_rejected_goes(odd, empty, clash, labels):
    bad = {(r.doc_id) for r in classify(odd, labels).collect() if not r.predicted}
    kept = keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(
        str(r.doc_id) for r in odd.collect() if r.doc_id not in bad
    )
    assert keep_good(clash, labels).columns == clash.columns
    assert keep_good(empty, labels).collect() == []
