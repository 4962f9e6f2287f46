import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tradewell.llm import url_graph
from tradewell.llm.url_graph import judge_pages

SCHEMA = "page_id long, url string, html string"


def linked_pages(seed=2, n=300):
    rng = random.Random(seed)
    hosts = [f"h{i}.example.{t}" for i in range(12) for t in ("com", "net", "org")]
    rows = []
    for k in range(n):
        host = rng.choice(hosts)
        links = "".join(
            f'<a href="{rng.choice(["https:", "", "HTTP:"])}//{rng.choice(hosts)}/q?z">' for _ in range(rng.randint(0, 3))
        )
        rows.append((k, f"http://{host.upper() if k % 7 == 0 else host}/{rng.choice(['en', 'de', 'fr'])}/x{k}", links))
    return rows


ODD = [
    (300, None, "<a href=//zzz.com>"), (301, "nohost", "x"), (302, "http://x.net", None), (302, "http://x.net", None),
    (None, "http://a.b.org/fr/?q", ""), (303, "HTTP://EXAMPLE.NET/en/a://b.org/fr/", "<img src='//É.net'>"), (304, "", ""),
    (305, "x://org?/fr/", ""), (306, "x://org/fr/#a", "<a href=//a//b>" * 3000), (307, "http://notexample.net/en/", ""),
]


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    return sorted(map(str, con.execute(url_graph.SQL).fetchall()))


def by_spark(df):
    return sorted(str(tuple(r)) for r in judge_pages(df).collect())


@pytest.mark.parametrize("seed", [2, 3])
def test_equals_sql_over_a_dense_graph(spark, seed):
    rows = linked_pages(seed) + ODD
    found = by_spark(spark.createDataFrame(rows, SCHEMA))
    assert found == by_sql(rows)
    free = [r for r in judge_pages(spark.createDataFrame(rows, SCHEMA)).collect() if r.rule is None]
    assert {"allow", "block"} == {r.verdict for r in free}


def test_rules(spark):
    rows = [
        ("http://a.net/x", "net/", "block"), ("http://example.net/en/1", "example.net/en/", "allow"),
        ("http://net", None, "block"), ("http://m.example.com/de/", "example.com/de/", "block"),
        ("http://example.com/en/de/", None, "allow"), ("http://q.org/fr/?a#b", "org/fr/", "allow"),
        ("http://org.com/fr/", None, "allow"), ("http://A.NET/en/", "net/", "block"),
    ]
    df = spark.createDataFrame([(i, u, "") for i, (u, _, _) in enumerate(rows)], SCHEMA)
    got = {r.page_id: (r.rule, r.verdict) for r in judge_pages(df).collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(rows)}


def test_distrust_goes_against_links_and_trust_along_them(spark):
    rows = [
        (1, "http://bad.net/x", ""), (2, "http://friend.com/", '<a href="http://bad.net/">'), (3, "http://other.com/", ""),
        (4, "http://good.org/fr/", '<a href="//praised.com">'), (5, "http://praised.com/", '<a href="http://bad.net/y">'),
    ]
    got = {r.page_id: r for r in judge_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2].verdict == "block" and got[2].distrust > 0 == got[2].trust
    assert got[3].verdict == "allow" and got[3].distrust == got[3].trust == 0
    assert got[5].verdict == "allow" and got[5].trust > got[5].distrust > 0


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert by_spark(df) == by_sql(ODD)
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("host", "path", "fit", "kind", "score", "src", "dst", "n", "trust")])
    assert by_spark(clash) == by_spark(df)
    assert judge_pages(df.limit(0)).collect() == []
