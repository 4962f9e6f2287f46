"""Quality rules whose cut-offs are chosen so that few good texts are rejected, with a proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradewell.llm.common import WHITE
from tradewell.sources.io import materialize

WINDOW = 5
MIN_WORDS = 10
#: Bound on the share of good texts of a stratum that the chosen cut-offs reject together, and
#: the chance, over all strata, rules and cut-offs, that any chosen one breaks its part of it.
MAX_REJECTED, CHANCE = 0.02, 0.05
#: A rejected good text counts as much as so many rejected bad ones when a cut-off is chosen.
GOOD_WORTH = 20

# Cut-offs that are tried; a text is rejected whose measure is above one.
CUTOFFS = {
    "symbols_per_word": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0),
    "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "repeat_word_share": (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18, 0.2),
    "long_words": (7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 14.0, 16.0, 20.0, 30.0),
    "short_words": (-5.0, -4.5, -4.0, -3.5, -3.0, -2.5, -2.0, -1.5),
}
SYMBOLS = "[#*$%&|<>]"


def measures(docs: DataFrame, text_col: str = "text", *keep: Column) -> DataFrame:
    """``keep``, then n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words.

    A window of five words is told from others of its text by a 64-bit hash of the hashes of its
    words. Only a text in which a window occurs twice has its windows sorted; the words of windows
    with an equal neighbour are counted once each.
    """
    rows = docs.select(*keep, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    bare = F.btrim("_text", F.lit(WHITE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    rows = rows.withColumn("_words", words)
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    spans = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    of = lambda i: F.xxhash64(*[F.col("_hashes")[i + k] for k in range(WINDOW)])
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("_windows", F.when(F.size("_words") >= WINDOW, F.transform(spans, of)).otherwise(none))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    covered = F.expr(f"""
        aggregate(
          transform(array(array_sort(transform(_windows, (h, i) -> struct(h AS h, i AS i)))),
            s -> array_sort(transform(
              filter(sequence(0, size(s) - 1),
                     k -> (k > 0 AND s[k - 1].h = s[k].h) OR (k + 1 < size(s) AND s[k + 1].h = s[k].h)),
              k -> s[k].i)))[0],
          struct(0L AS n, 0 AS last),
          (a, i) -> struct(a.n + i + {WINDOW} - greatest(i, a.last) AS n, i + {WINDOW} AS last),
          a -> a.n)
    """)
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    names = [c for c in rows.columns if not c.startswith("_")]
    rows = rows.withColumns({"_repeat": F.when(repeats, covered).otherwise(F.lit(0).cast("long")), "_lines": lines})
    return rows.select(
        *[F.col(f"`{c}`") for c in names],
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.col("_repeat").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    """What each rule compares with its cut-off; zero for a text without words or lines."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
        "long_words": per("word_chars", "n_words"),
        "short_words": -per("word_chars", "n_words"),
    }


def log_gamma(x: Column) -> Column:
    """Of x >= 1: Stirling's series at x + 9, less the logarithms of the factors between."""
    z = x + 9
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    shift = sum((F.log(x + k) for k in range(1, 9)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - shift


def chance_at_most(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial of n and p, one if k is above the mean n p.

    Sums terms downwards from k, each from the one above. Below the mean they shrink, and the
    sum stops where what is left can't change the 15th digit.
    """
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.least(k, F.ceil(12 * F.sqrt(n * p * (1 - p))) + 60).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(state: Column, i: Column) -> Column:
        below = state["term"] * (k - i + 1) / (n - k + i) * F.lit((1 - p) / p)
        return F.struct(below.alias("term"), (state["sum"] + below).alias("sum"))

    numbers = F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(numbers, start, add, lambda s: s["sum"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def choose_cutoffs(
    measured: DataFrame, max_rejected: float = MAX_REJECTED, chance: float = CHANCE
) -> DataFrame:
    """(stratum, rule, cutoff) from labelled rows: stratum, good (boolean) and the measures.

    For a cut-off, with n good rows in a stratum of which it rejects k, "more than the allowed
    share of good texts is rejected" is refuted if a binomial variable of n and that share is at
    most k with a chance of at most ``chance`` divided by the number of tests made, which is
    strata times cut-offs (exact tail, Bonferroni). Each rule may reject its part of
    ``max_rejected``, so all chosen cut-offs together keep it. Of the refuted ones the one is
    chosen that rejects most bad rows, less ``GOOD_WORTH`` for each good one (ties: the laxest),
    if that is above zero; else the stratum has no such rule. Strata with few labels have none.
    """
    cuts = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                value.alias("value"),
                F.array(*[F.lit(float(c)) for c in CUTOFFS[name]]).alias("cutoffs"),
            )
            for name, value in rule_values().items()
        ]
    )
    rows = measured.filter(~base_failed()).select("stratum", "good", F.explode(cuts).alias("r")).select("stratum", "good", "r.*")
    above = F.size(F.filter("cutoffs", lambda c: F.col("value") > c))  # ascending: it is above so many
    seen = rows.groupBy("stratum", "rule", "cutoffs", above.alias("above")).agg(
        F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")
    )
    cells = seen.groupBy("stratum", "rule", "cutoffs").agg(F.collect_list(F.struct("above", "good", "bad")).alias("cells"))
    counts = cells.select("stratum", "rule", "cells", F.posexplode("cutoffs").alias("at", "cutoff"))
    total = lambda field, hit: F.aggregate(
        "cells",
        F.lit(0).cast("long"),
        lambda a, c: a + F.when(hit(c), c[field]).otherwise(F.lit(0)),
    )
    rejected = lambda c: c["above"] > F.col("at")
    counts = counts.select(
        "stratum",
        "rule",
        "cutoff",
        total("good", lambda c: F.lit(True)).alias("n"),
        total("good", rejected).alias("k"),
        total("bad", rejected).alias("bad"),
    )
    counts = materialize(counts, "rules-counts")
    strata = counts.select(F.coalesce(F.col("stratum"), F.lit("")), F.col("stratum").isNull()).distinct().count()
    tests = max(1, strata) * sum(map(len, CUTOFFS.values()))
    share = max_rejected / len(CUTOFFS)
    sure = counts.filter((F.col("n") > 0) & (chance_at_most(F.col("k"), F.col("n"), share) <= chance / tests))
    sure = sure.withColumn("gain", F.col("bad") - GOOD_WORTH * F.col("k")).filter("gain > 0")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), F.desc("cutoff"))
    return sure.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("stratum", "rule", "cutoff")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    max_rejected: float = MAX_REJECTED,
    chance: float = CHANCE,
) -> DataFrame:
    """One row for each document: ``doc_id``, the measures, ``base_failed``, ``kept`` and
    ``broken``, the names of the chosen rules it breaks.

    ``labels`` has doc_id and quality (0 or 1; others and null ids are left out, of several the
    least counts). Strata are values of ``stratum_col``, null is one. Null and empty texts have
    measures of zero and fail the base rules. A stratum without a proven rule keeps all that the
    base rules keep. Repeated rows are kept; an empty table gives no rows.
    """
    found = measures(
        docs, text_col, F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{stratum_col}`").cast("string").alias("stratum")
    )
    found = materialize(found, "rules-measures")
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
    known = known.agg((F.min("quality") == 1).alias("good")).withColumnRenamed("doc_id", "of")
    labelled = found.join(known, found["doc_id"] == known["of"])
    chosen = choose_cutoffs(labelled, max_rejected, chance)
    rules = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))
    rules = materialize(rules.withColumnRenamed("stratum", "of"), "rules-chosen")
    joined = found.join(rules, found["stratum"].eqNullSafe(rules["of"]), "left")
    broken = F.array_compact(
        F.array(*[F.when(v > F.col("cut")[name], F.lit(name)) for name, v in rule_values().items()])
    )
    judged = joined.withColumn("broken", broken).withColumn("base_failed", base_failed())
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*names, (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken")


def sql(max_rejected: float = MAX_REJECTED, chance: float = CHANCE) -> str:
    """The same in SQL, windows of words compared as lists."""
    white, some = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    share = max_rejected / len(CUTOFFS)
    per = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"
    values = {
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
        "long_words": per("word_chars", "n_words"),
        "short_words": f"-({per('word_chars', 'n_words')})",
    }
    measured = " UNION ALL ".join(f"SELECT rid, '{n}' AS rule, {v} AS v FROM m" for n, v in values.items())
    cutoffs = ", ".join(f"('{n}', CAST({c} AS DOUBLE))" for n, cs in CUTOFFS.items() for c in cs)
    tests = sum(map(len, CUTOFFS.values()))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '{white}') AS words FROM documents),
w AS (SELECT rid, i, list_slice(words, i, i + {WINDOW - 1}) AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM w) WHERE n > 1),
p AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS at
  FROM (SELECT rid, i, unnest(range({WINDOW})) AS k FROM r)) GROUP BY rid),
m AS (SELECT d.rid, doc_id, stratum, len(words) AS n_words,
  CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
  coalesce(p.n, 0) AS n_repeat_words,
  len(words) < {MIN_WORDS} OR 100 * coalesce(p.n, 0) > 20 * len(words) AS base_failed
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{some}')) AS lines FROM d) d
  LEFT JOIN p ON p.rid = d.rid),
v AS ({measured}),
c(rule, cutoff) AS (VALUES {cutoffs}),
l AS (SELECT doc_id, min(quality) AS y FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY 1),
s AS (SELECT stratum, c.rule, cutoff, count(*) FILTER (y = 1) AS n,
  count(*) FILTER (y = 1 AND v > cutoff) AS k, count(*) FILTER (y = 0 AND v > cutoff) AS bad
  FROM m JOIN l ON m.doc_id = l.doc_id JOIN v ON v.rid = m.rid JOIN c ON c.rule = v.rule
  WHERE NOT base_failed GROUP BY ALL),
b AS (SELECT *, CASE WHEN k > n * {share!r} THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda i: exp(
    lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}) + (n - i) * ln(1 - {share!r})))) END AS tail,
  (SELECT count(*) FROM (SELECT DISTINCT stratum FROM s)) * {tests} AS tests FROM s WHERE n > 0),
x AS (SELECT stratum, rule, cutoff, row_number() OVER (
    PARTITION BY stratum, rule ORDER BY bad - {GOOD_WORTH} * k DESC, cutoff DESC) AS r
  FROM b WHERE tail <= {chance!r} / tests AND bad - {GOOD_WORTH} * k > 0),
o AS (SELECT DISTINCT m.rid FROM m JOIN x ON x.r = 1 AND m.stratum IS NOT DISTINCT FROM x.stratum
  JOIN v ON v.rid = m.rid AND v.rule = x.rule AND v.v > x.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND o.rid IS NULL AS kept
FROM m LEFT JOIN o ON o.rid = m.rid
"""


SQL = sql()
