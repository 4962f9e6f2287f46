from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from tradewell.llm import pfair_mix
from tradewell.llm.pfair_mix import in_order, mix, slots

SCHEMA = "doc_id long, text string, source string"


def schedule(spark, weights, period):
    rows = spark.createDataFrame([(s, 10, w) for s, w in weights.items()], "source string, n long, w long")
    return slots(rows, period).orderBy("slot").collect()


@pytest.mark.parametrize(
    "weights",
    [{"a": 1}, {"a": 1, "b": 1}, {"a": 50, **{f"s{i}": 1 for i in range(50)}}, {"a": 7, "b": 5, "c": 3, None: 2}, {"a": 10**6, "b": 1}],
)
def test_no_source_is_a_block_away_from_its_weight(spark, weights):
    found = schedule(spark, weights, 400)
    period = found[0].p
    assert [r.slot for r in found] == list(range(period)) and period >= 10 * len(weights)
    share = {r.source: r.share for r in found}
    assert sum(share.values()) == period and share.keys() == weights.keys()
    total = sum(weights.values())
    for s, w in weights.items():
        assert abs(share[s] - Fraction(period * w, total)) <= 1 + Fraction(len(weights) * w, total) + 1
    done = dict.fromkeys(weights, 0)
    for t, r in enumerate(found):
        assert done[r.source] * period // r.share <= t < -(-(done[r.source] + 1) * period // r.share)
        assert r.k == done[r.source]
        done[r.source] += 1
        for s in weights:
            assert abs(done[s] - Fraction(share[s] * (t + 1), period)) < 1


def docs(spark, counts):
    rows = [(i, f"text {s} {k}", s) for s, n in counts.items() for i, k in zip(range(n), range(n), strict=True)]
    return spark.createDataFrame([(1000 * j + i, t, s) for j, (i, t, s) in enumerate(rows)], SCHEMA)


def test_whole_stream(spark, monkeypatch):
    """Every document once, blocks whole, and the weights kept until a source runs out."""
    monkeypatch.setattr(pfair_mix, "RANGE_DOCS", 40)
    df = docs(spark, {"hot": 700, "b": 300, None: 100, "c": 9})
    mixed = mix(df, weights={"hot": 2, "b": 1, None: 1}, block_docs=8, period=40).cache()
    assert mixed.count() == df.count() == mixed.select("row.doc_id").distinct().count()
    got = mixed.collect()
    assert {r.source for r in got if r.slot is None} == {"c"}
    placed = sorted((r.slot, r.place, r.source, r.number) for r in got if r.slot is not None)
    assert len({p[:2] for p in placed}) == len(placed)
    for s, n in (("hot", 700), ("b", 300), (None, 100)):
        assert [p[3] for p in placed if p[2] == s] == list(range(n))
    first_empty = next(t for t in range(10**6) if t not in {p[0] for p in placed})
    share = {r.source: Fraction(r.share, r.period) for r in got if r.share}
    for t in range(first_empty):
        for s, w in share.items():
            assert abs(len({p[0] for p in placed if p[2] == s and p[0] <= t}) - w * (t + 1)) < 1
    order = [r.doc_id for r in in_order(mixed).collect()]
    want = sorted(got, key=lambda r: (r.slot is None, r.slot or 0, r.number))
    assert order == [r.row.doc_id for r in want]
    mixed.unpersist()


@pytest.mark.parametrize("m, hot, n", [(20, 10, 900), (60, 30, 900), (3, 1.5, 500)])
def test_lag_from_the_weights_over_many_periods(spark, m, hot, n):
    """Over some tens of periods no source is a block away from the weight it was given."""
    weights = {"hot": hot, **{f"s{i}": 1 + i % 2 / 10 for i in range(m - 1)}}
    total = sum(Fraction(str(w)) for w in weights.values())
    counts = {s: int(n * Fraction(str(w)) / total * 10) for s, w in weights.items()}
    got = mix(docs(spark, counts), weights=weights, block_docs=1, period=100).select("source", "slot").collect()
    assert len(got) == len({r.slot for r in got}) == sum(counts.values())
    done, at = dict.fromkeys(weights, 0), {r.slot: r.source for r in got}
    first_empty = next(t for t in range(10**6) if t not in at)
    assert first_empty > 0.9 * len(got)
    for t in range(first_empty):
        done[at[t]] += 1
        for s, w in weights.items():
            assert abs(done[s] - Fraction(str(w)) * (t + 1) / total) < 1, (s, t)


def test_a_source_that_lasts_longest_keeps_its_weight(spark, monkeypatch):
    monkeypatch.setattr(pfair_mix, "JOB_ROUNDS", 2)
    weights, counts = {"a": 10**4, "b": 1, None: 2}, {"a": 300, "b": 40, None: 60}
    got = mix(docs(spark, counts), weights=weights, block_docs=1, period=50).collect()
    assert {s: sum(r.source == s for r in got) for s in counts} == counts
    total = sum(weights.values())
    for r in got:
        w = weights[r.source]
        assert r.number * total // w <= r.slot < -(-(r.number + 1) * total // w)
    assert len({r.slot for r in got}) == len(got)


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(map(str, con.execute(pfair_mix.SQL).fetchall()))


def test_odd_rows(spark, odd, empty, clash):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    found = mix(odd).select("row.doc_id", "source", "number", "block", "slot", "place")
    assert sorted(str(tuple(r)) for r in found.collect()) == by_sql(rows)
    assert in_order(mix(clash)).columns == clash.columns
    assert in_order(mix(clash)).count() == odd.count()
    assert mix(empty).collect() == []
    with pytest.raises(ValueError):
        mix(odd, weights={"a": 0})
    only = mix(odd, weights={"a": 1}).filter(F.col("slot").isNotNull())
    assert {r.source for r in only.collect()} == {"a"}
