import zlib

import numpy as np
import pytest

from tests.llm.conftest import DOCS
from tradewell.llm import queries, toxicity
from tradewell.llm.toxicity import BINS, LESS, calibrate, classify, dictionary, peculiar, sizes, train, windows


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_whole_table_and_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest table has few labels
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, sf).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert got.keys() == docs.keys()
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    known = [(got[i].predicted, y) for i, y in labels.items() if held(i)]
    clean = [p for p, y in known if not y]
    flagged = [y for p, y in known if p]
    assert len(known) > 80 and np.mean(clean) <= 0.03
    assert flagged and np.mean(flagged) >= 0.8


def test_labels_of_held_out_ids_do_not_matter(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    score = lambda y: {r.doc_id: r.score for r in classify(docs, y).collect()}
    assert score(labels) == score(labels.withColumn("toxic", other))


WORDS = "river stone cloud window garden letter music number summer winter paper table".split()
BAD = ("gruntlefop", "snarkwit", "blatherskite")


def made(rng, n, bad):
    words = rng.choice(WORDS, n).tolist()
    for at in range(5, n, 20) if bad else ():
        words[at] = BAD[int(rng.integers(3))]
    return " ".join(words)


def test_planted_words_are_learned_and_found(spark):
    rng = np.random.default_rng(3)
    rows = [(i, made(rng, 60, i % 4 == 0), "en", "s", 0) for i in range(600)]
    rows += [(1000 + i, made(rng, 400, i % 2 == 0), "en", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in classify(docs, labels).collect()}
    assert all(got[i] == int(i % 4 == 0) for i in range(600) if held(i))
    assert all(got[1000 + i] == int(i % 2 == 0) for i in range(40))  # texts without labels


def test_lengths_are_those_of_the_compressor():
    import zstandard

    samples = [f" the {w} of a {v} was here " .encode() for w in WORDS for v in WORDS]
    content = dictionary(samples, 1024)
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    plain = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)
    size = sizes(content)
    for w in (*samples[:20], b"", b" something else ", b"x" * 500):
        frame = plain.compress(w)
        back = zstandard.ZstdDecompressor(dict_data=raw).decompress(frame, max_output_size=1000)
        assert back == w and size(w) == len(frame)


def test_a_text_is_the_sum_of_its_windows():
    rng = np.random.default_rng(5)
    cut = lambda bad: [w for _ in range(200) for w in windows(made(rng, 40, bad))]
    distance = train(cut(True), cut(False))
    of = distance.histogram()
    toxic, ordinary = sizes(distance.toxic), sizes(distance.ordinary)
    for text in (made(rng, 100, True), made(rng, 7, False), "", None, "  \n", "y" * 1000):
        want = np.zeros(BINS, int)
        for w in windows(text):
            want[min(max(ordinary(w) - toxic(w), -LESS), BINS - 1 - LESS) + LESS] += 1
        assert of(text).tolist() == want.tolist()
    assert of(made(rng, 100, True))[LESS + 2 :].sum() >= 3
    assert of(made(rng, 100, False))[LESS + 2 :].sum() == 0


def test_windows_hold_every_byte_in_order():
    text = "Ärger IN the\tHouse " + "z" * 200 + " end\n" + " ".join(map(str, range(50)))
    cut = windows(text)
    flat = b"".join(b"".join(cut).split())
    assert flat == "".join(text.split()).replace("IN", "in").replace("H", "h").encode()
    assert all(len(w.split()) <= 8 and max(map(len, w.split())) <= 64 for w in cut)
    assert windows(None) == windows("") == windows(" \n") == []


def test_peculiar_words():
    own, other = [b" a bad word "] * 100, [b" a good word "] * 200
    assert set(peculiar(own, other)) == {b" bad "}
    assert peculiar(other, other) == [] and peculiar([], other) == []
    assert peculiar([b" rare "] * 3, other) == []  # three windows are no evidence


def plain_steps(total, y):
    """Non-decreasing chances by the max-min formula of isotonic regression."""
    order = sorted(zip(total, y))
    t, v = [a for a, _ in order], [b for _, b in order]
    n = len(v)
    mean = lambda i, j: sum(v[i : j + 1]) / (j - i + 1)
    return t, [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def test_calibration_is_the_isotonic_fit():
    rng = np.random.default_rng(8)
    h = rng.poisson(1.0, (60, BINS)).astype(float)
    y = (rng.random(60) < 1 / (1 + np.exp(3 - h[:, -1] * 2))).astype(int)
    made_of = calibrate(h, y, (1.0, 1.0))
    t, want = plain_steps((h @ made_of.weight).tolist(), y.tolist())
    steps = sorted(set(np.round(want, 9)))
    assert len(made_of.level) == 2 * len(steps)  # a block for each value of the fit
    for first, last, value in zip(made_of.level[::2], made_of.level[1::2], steps):
        block = [a for a, b in zip(t, want) if round(b, 9) == value]
        assert (first, last) == pytest.approx((min(block), max(block)))
    assert (np.diff(made_of.chance) >= 0).all()


def test_odd_rows(spark, odd, clash, empty, labels):
    got = classify(odd, labels).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r.doc_id for r in odd.collect())))
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1  # no window, no evidence
    assert {r.n_windows for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert all(not r.held_out for r in got if r.doc_id is None)
    assert sorted(map(str, classify(clash, labels).collect())) == sorted(map(str, got))
    assert classify(empty, labels).collect() == []
    assert {r.score for r in classify(odd, labels.limit(0)).collect()} == {0.5}
    only = labels.filter("toxic = 1")
    assert all(r.score >= 0.5 for r in classify(odd, only).collect())
