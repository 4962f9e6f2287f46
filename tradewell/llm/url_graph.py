"""URL filters: fixed rules first, then trust and distrust spread over links between hosts."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewell.sources.io import materialize

# Fixed values: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Scores are whole parts of this mass, so that sums don't depend on the order of rows.
MASS = 10**15
#: Percent of a score that goes on along links in a round; the rest stays with the seeds.
SPREAD = 85
ROUNDS = 16
#: A host is blocked if it has more distrust than trust, and at least one such part of what a
#: host has on average.
LEAST_PART = 10
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; of equally long ones the
    one listed first."""
    found = None
    for verdict, of, begin in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(begin))
        value = F.struct(F.lit(of + begin).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    if found is None:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages (host, html) of one host to another host, counted.

    Links without a host stay within their page's host and say nothing here.
    """
    to = F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))
    pairs = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(to).alias("dst"))
    return pairs.withColumn("dst", lowered(F.col("dst"))).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score) after ``rounds`` rounds of personalised PageRank.

    ``seeds`` has (kind, host): kind trust goes along links, kind distrust against them, to those
    that link to what is distrusted. A seed holds an equal part of its kind's mass; each round a
    score is dealt over a host's links by their number. Hosts without links pass nothing on. A
    round is a join and a sum over host edges; every fourth is written, so a lost executor costs
    few rounds.
    """
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    edges = materialize(both.join(total, ["kind", "src"]).withColumnRenamed("src", "host"), "hosts-edges")
    share = seeds.groupBy("kind").agg(F.count("*").alias("seeds"))
    start = seeds.join(share, "kind").select("kind", "host", F.expr(f"{MASS} div seeds").alias("score"))
    start = materialize(start, "hosts-seeds")
    if edges.isEmpty():
        return start
    rest = start.select("kind", "host", F.expr(f"score * {100 - SPREAD} div 100").alias("score"))
    score = start
    for k in range(rounds):
        sent = score.join(edges, ["kind", "host"]).select(
            "kind",
            F.col("dst").alias("host"),
            F.expr(f"cast(score as decimal(20,0)) * n * {SPREAD} div (total * 100)").alias("score"),
        )
        score = sent.unionByName(rest).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % 4 == 3 or k == rounds - 1:
            score = materialize(score, "hosts-scores")
    return score


def judge_pages(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: Sequence[tuple[str, str, str]] = RULES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row for each page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, and the
    host's ``trust`` and ``distrust`` in parts of ``MASS``.

    A page's verdict is that of its longest fitting rule, else that of its host. Distrust starts
    from hosts that a block rule with the path / fits as a whole, trust from other hosts with an
    allowed page. Hosts of links count, whether or not there are pages of them. A null url, or
    one without ``://``, has an empty host and path, fits no rule and is allowed; null html has
    no links. Repeated rows are kept; an empty table gives no rows.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"),
    )
    links = materialize(host_links(rows), "hosts-links")
    light = rows.drop("html").withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    allowed = light.filter("host <> ''").groupBy("host").agg(
        F.max((F.coalesce(F.col("fit.verdict"), F.lit("")) == "allow").cast("int")).alias("allowed")
    )
    linked = links.select(F.col("src").alias("host")).unionByName(links.select(F.col("dst").alias("host")))
    hosts = allowed.unionByName(linked.distinct().withColumn("allowed", F.lit(0)))
    hosts = hosts.groupBy("host").agg(F.max("allowed").alias("allowed"))
    whole = F.coalesce(fitting_rule(F.col("host"), F.lit("/"), [r for r in rules if r[2] == "/"])["verdict"], F.lit(""))
    kind = F.when(whole == "block", "distrust").when(F.col("allowed") == 1, "trust")
    hosts = materialize(hosts.select("host", kind.alias("kind")), "hosts-all")
    scores = spread(links, hosts.filter("kind is not null").select("kind", "host"), rounds)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0)).alias(k)
    known = materialize(scores.groupBy("host").agg(of("trust"), of("distrust")), "hosts-known")
    least = MASS // LEAST_PART // max(1, hosts.count())
    judged = light.join(known, "host", "left").withColumns(
        {k: F.coalesce(k, F.lit(0)).cast("long") for k in ("trust", "distrust")}
    )
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least)
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        "trust",
        "distrust",
    )


def _sql() -> str:
    """The same in SQL, a round of spreading after another."""
    fits = "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}:{h}{p}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    ) + " END"
    whole = " OR ".join(
        f"host = '{h}' OR ends_with(host, '.{h}')" for v, h, p in RULES if p == "/" and v == "block"
    )
    up, low = string.ascii_uppercase, string.ascii_lowercase
    quoted = LINK.replace("'", "''")
    rounds = "\n".join(
        f"""s{k + 1} AS (SELECT kind, host, CAST(sum(score) AS BIGINT) AS score FROM (
  SELECT e.kind, e.dst AS host, CAST(s.score AS HUGEINT) * e.n * {SPREAD} // (e.total * 100) AS score
  FROM s{k} s JOIN e ON s.kind = e.kind AND s.host = e.src
  UNION ALL SELECT kind, host, score * {100 - SPREAD} // 100 FROM s0) GROUP BY ALL),"""
        for k in range(ROUNDS)
    )
    return f"""
WITH u AS (SELECT page_id, coalesce(html, '') AS html,
  translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{up}', '{low}') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT page_id, host, path, {fits} AS fit FROM u),
l AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src,
  translate(unnest(list_distinct(regexp_extract_all(html, '{quoted}', 1))), '{up}', '{low}') AS dst
  FROM u WHERE host <> '') WHERE src <> dst GROUP BY ALL),
h AS (SELECT host, CASE WHEN {whole} THEN 'distrust' WHEN max(allowed) = 1 THEN 'trust' END AS kind FROM (
  SELECT host, CASE WHEN starts_with(fit, 'allow') THEN 1 ELSE 0 END AS allowed FROM f WHERE host <> ''
  UNION ALL SELECT src, 0 FROM l UNION ALL SELECT dst, 0 FROM l) GROUP BY host),
b AS (SELECT 'trust' AS kind, src, dst, n FROM l UNION ALL SELECT 'distrust', dst, src, n FROM l),
e AS (SELECT *, sum(n) OVER (PARTITION BY kind, src) AS total FROM b),
s0 AS (SELECT kind, host, {MASS} // count(*) OVER (PARTITION BY kind) AS score FROM h WHERE kind IS NOT NULL),
{rounds}
z AS (SELECT * FROM s{ROUNDS} WHERE (SELECT count(*) FROM l) > 0
  UNION ALL SELECT * FROM s0 WHERE (SELECT count(*) FROM l) = 0),
k AS (SELECT host, CAST(sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END) AS BIGINT) AS trust,
  CAST(sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) AS BIGINT) AS distrust FROM z GROUP BY host)
SELECT page_id, f.host, path, CASE WHEN fit IS NULL THEN NULL ELSE substr(fit, 7) END AS rule,
  CASE WHEN fit IS NOT NULL THEN substr(fit, 1, 5)
    WHEN coalesce(distrust, 0) > coalesce(trust, 0)
      AND distrust >= {MASS // LEAST_PART} // (SELECT greatest(1, count(*)) FROM h) THEN 'block'
    ELSE 'allow' END AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM f LEFT JOIN k ON f.host = k.host
"""


SQL = _sql()
