"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradewell.llm.common import packed, small
from tradewell.sources.io import materialize

#: Documents of a block: what a source gives in one slot.
BLOCK_DOCS = 16
#: Slots of a round: sources that ran out are left out of the rounds that follow.
PERIOD = 5000
#: Rounds that one job gives out before it writes how far each source is.
JOB_ROUNDS = 20
#: Weights that are not small whole numbers, or multiples of such, are rounded to this many parts of the largest.
WEIGHT_PARTS = 10**9
#: Documents of a source that are numbered in one task.
RANGE_DOCS = 50_000


def source_weights(counts: DataFrame, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """``counts`` (source, n) with ``w``, a whole-number weight.

    Without given weights it is 1000 times the square root of the count, which draws large and
    small sources together. Given weights are relative; sources not named get none.
    """
    if weights is None:
        return counts.withColumn("w", F.floor(1000 * F.sqrt(F.col("n").cast("double"))).cast("long"))
    if any(v < 0 for v in weights.values()) or not any(weights.values()):
        raise ValueError("weights must not be negative, and one must be positive")
    given = counts.sparkSession.createDataFrame(list(_whole(weights).items()), "given string, w long")
    same = counts["source"].eqNullSafe(given["given"])
    return counts.join(given, same, "left").select("source", "n", F.coalesce("w", F.lit(0)).alias("w"))


def _whole(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in the given proportions, as written in decimals if they have few digits."""
    exact = {k: Fraction(str(v)) for k, v in weights.items()}
    unit = math.lcm(*[v.denominator for v in exact.values()])
    top = max(exact.values())
    if top * unit > WEIGHT_PARTS:
        return {k: max(round(WEIGHT_PARTS * v / top), int(v > 0)) for k, v in exact.items()}
    part = math.gcd(*[int(v * unit) for v in exact.values()])
    return {k: int(v * unit) // part for k, v in exact.items()}


def schedule(weighted: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, k, slot) of all blocks of ``weighted`` (source, w, blocks); ``k`` from 0.

    With W the sum of the weights, block k of a source of weight w is released at slot
    floor(k W / w) and due before slot ceil((k + 1) W / w). Slot by slot, the released block that
    is due first gets the slot (ties: the source that sorts first, null before all). The rates
    w / W add up to one, so all blocks are in time, and after any number of slots a source that
    has blocks left is less than one block from its weight's part, however long the stream is.

    A source that ran out keeps its slots, empty, to the end of the round of ``period`` slots
    given out; then it is left out, and slots for which no block is released are skipped. The
    schedule is made in order: what a source got is the only state, written after each job of
    ``JOB_ROUNDS`` rounds, so a task holds a bounded number of slots.
    """
    live = weighted.filter("w > 0").withColumn("total", F.sum("w").over(Window.partitionBy(F.lit(0))))
    live = live.withColumn("until", F.expr("(blocks * total + w - 1) div w"))
    state = live.agg(
        F.max("total").alias("total"),
        F.max("until").alias("until"),
        F.array_sort(F.collect_list(F.struct("source", "w", "blocks"))).alias("s"),
    )
    state = state.filter("size(s) > 0").selectExpr("*", "0L AS t", "transform(s, x -> 0L) AS done")
    parts = []
    while not parts or parts[-1].filter("size(filter(s, (x, i) -> done[i] < x.blocks)) > 0").count():
        state = state.withColumn("ran", F.expr(_rounds(period)))
        state = materialize(
            state.select("total", "until", "s", "ran.t", "ran.done", F.flatten("ran.out").alias("out")), "mix-state"
        )
        parts.append(state)
    given = [p.select("s", F.explode("out").alias("g")) for p in parts]
    given = reduce(DataFrame.unionByName, given)
    return given.select(F.col("s")[F.col("g.i")]["source"].alias("source"), "g.k", "g.slot")


def _rounds(period: int) -> str:
    """SQL of (t, done, out) after a job: the next slot, blocks given to each source, and for each
    round the blocks that there are, with their slots."""
    place = """
        array_min(transform(live, i -> struct(
            greatest(b.t, (b.done[i] * total) div s[i].w) AS slot,
            ((b.done[i] + 1) * total + s[i].w - 1) div s[i].w AS due,
            i AS i)))"""
    one = f"""
        transform(array({place}), c -> struct(
            c.slot + 1 AS t,
            transform(b.done, (d, i) -> IF(i = c.i, d + 1, d)) AS done,
            IF(b.done[c.i] < s[c.i].blocks,
               concat(b.out, array(struct(c.slot AS slot, c.i AS i, b.done[c.i] AS k))), b.out) AS out))[0]"""
    none = "cast(array() AS array<struct<slot:bigint,i:int,k:bigint>>)"
    turn = f"""
        transform(array(filter(sequence(0, size(s) - 1), i -> a.done[i] < s[i].blocks)), live ->
            IF(size(live) = 0, struct(a.t AS t, a.done AS done, {none} AS out), aggregate(
                sequence(1L, least({int(period)}L, greatest(until - a.t, 1L))),
                struct(a.t AS t, a.done AS done, {none} AS out),
                (b, x) -> {one})))[0]"""
    return f"""
        aggregate(
            sequence(1L, least({JOB_ROUNDS}L, greatest((until - t + {int(period) - 1}) div {int(period)}, 1L))),
            struct(t AS t, done AS done, cast(array() AS array<array<struct<slot:bigint,i:int,k:bigint>>>) AS out),
            (a, r) -> transform(array({turn}), e -> struct(
                e.t AS t, e.done AS done, concat(a.out, array(e.out)) AS out))[0])"""


def slots(weighted: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, n, share, p, k, slot): one period of whole slots, by weights rounded to it.

    Each weight above zero gets one slot and the rest is dealt in proportion, left-over slots to
    the largest remainders; if there are more sources than a tenth of ``period``, the period is
    ten times their number. ``SQL`` repeats such a period. ``mix`` does not: a rounded share is up
    to a block off in every period, which adds up.
    """
    live = weighted.filter("w > 0")
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = live.select(
        "source", "n", "w", F.sum("w").over(every).alias("total"), F.count("*").over(every).alias("m")
    ).withColumn("p", F.greatest(F.lit(period).cast("long"), 10 * F.col("m")))
    dealt = sized.select(
        "source",
        "n",
        "p",
        F.expr("1 + (w * (p - m)) div total").alias("base"),
        F.expr("(w * (p - m)) % total").alias("rest"),
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), F.asc_nulls_first("source"))
    over = F.col("p") - F.sum("base").over(every)
    shares = dealt.select(
        "source", "n", "p", (F.col("base") + (F.row_number().over(order) <= over).cast("long")).alias("share")
    )
    shares = materialize(shares, "mix-shares")
    placed = schedule(shares.select("source", F.col("share").alias("w"), F.col("share").alias("blocks")), period)
    placed = placed.withColumnRenamed("source", "of")
    met = shares["source"].eqNullSafe(placed["of"])
    return shares.join(placed, met).select("source", "n", "share", "p", "k", "slot")


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Mapping[str | None, float] | None = None,
    block_docs: int = BLOCK_DOCS,
    period: int = PERIOD,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Every document with its place in the mix: ``row`` (its columns, or those named), ``source``,
    ``number`` in its source (from 0), ``block`` of its source, ``slot`` of the mix, ``place`` in
    the block, and its source's weight: ``share`` slots of each ``period`` slots. Ordered by (slot, place) the rows are the mixed stream.

    Documents of a source come in the order of a digest of id and text, rows equal in both in any
    order. Nothing is dropped: when a source has no blocks left its slots stay empty. At any slot
    each source that has blocks left is less than a block from its weight; see ``schedule``.
    Sources of weight zero have no slot (null) and come last. A null source is a source. A null id
    or text counts as empty. An empty table gives no rows.

    A source is numbered in ranges of the digest, as many as its count asks for, so a source with
    a third of all rows is many tasks; the schedule, a row for each block, is made in order.
    """
    rows = docs.select(
        packed(docs.select(*columns) if columns else docs, "row"),
        _named(source_col).cast("string").alias("source"),
        F.md5(
            F.concat(
                F.coalesce(_named(id_col).cast("string"), F.lit("")),
                F.lit("|"),
                F.coalesce(_named(text_col), F.lit("")),
            )
        ).alias("digest"),
    )
    counts = materialize(rows.groupBy("source").agg(F.count("*").alias("n")), "mix-counts")
    weighted = materialize(source_weights(counts, weights), "mix-weights")
    blocks = F.ceil(F.col("n") / F.lit(int(block_docs))).cast("long").alias("blocks")
    plan = materialize(schedule(weighted.select("source", "w", blocks), period), "mix-slots")

    ranges = F.ceil(F.col("n") / F.lit(RANGE_DOCS)).cast("long")
    per = counts.select(F.col("source").alias("of"), ranges.alias("ranges"))
    head = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    dealt = rows.join(F.broadcast(per), rows["source"].eqNullSafe(per["of"])).drop("of")
    dealt = dealt.withColumn("range", F.shiftright(head * F.col("ranges"), 32)).drop("ranges")
    sizes = materialize(dealt.groupBy("source", "range").agg(F.count("*").alias("n")), "mix-ranges")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")
    sizes = sizes.select(F.col("source").alias("of"), F.col("range").alias("part"), before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("source", "range").orderBy("digest")) - 1
    numbered = dealt.withColumn("inside", inside)
    same = numbered["source"].eqNullSafe(sizes["of"]) & (numbered["range"] == sizes["part"])
    numbered = numbered.join(sizes, same).select("row", "source", (F.col("inside") + F.col("before")).alias("number"))
    numbered = numbered.withColumn("block", F.expr(f"number div {int(block_docs)}"))

    live = weighted.filter("w > 0")
    shares = live.crossJoin(live.agg(F.sum("w").alias("period"))).select(
        F.col("source").alias("of"), F.col("w").alias("share"), "period"
    )
    shared = numbered.join(F.broadcast(shares), numbered["source"].eqNullSafe(shares["of"]), "left").drop("of")
    times = small(plan.select(F.col("source").alias("of"), F.col("k").alias("nth"), "slot"))
    met = shared["source"].eqNullSafe(times["of"]) & (shared["block"] == times["nth"])
    return shared.join(times, met, "left").select(
        "row",
        "source",
        "number",
        "block",
        "slot",
        F.expr(f"number % {int(block_docs)}").alias("place"),
        "share",
        "period",
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of a mix as documents, sorted into the mixed stream over all partitions."""
    return mixed.orderBy(F.asc_nulls_last("slot"), "source", "number").select("row.*")


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS digest
  FROM documents),
c AS (SELECT source, CAST(floor(1000 * sqrt(count(*))) AS BIGINT) AS w FROM d GROUP BY source),
t AS (SELECT source, w, sum(w) OVER () AS total, count(*) OVER () AS m,
  greatest({PERIOD}, 10 * count(*) OVER ()) AS p FROM c),
b AS (SELECT source, p, 1 + (w * (p - m)) // total AS base, (w * (p - m)) % total AS rest FROM t),
q AS (SELECT source, CAST(p AS BIGINT) AS p, CAST(base AS BIGINT) + CAST(
  row_number() OVER (ORDER BY rest DESC, source ASC NULLS FIRST) <= p - sum(base) OVER () AS BIGINT) AS share FROM b),
l AS (SELECT max(p) AS p, list(source ORDER BY source NULLS FIRST) AS s,
  list(share ORDER BY source NULLS FIRST) AS q FROM q),
e AS (
  SELECT CAST(-1 AS BIGINT) AS slot, list_transform(q, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM l
  UNION ALL
  SELECT slot, list_transform(done, lambda x, i: CASE WHEN i = pick THEN x + 1 ELSE x END), pick FROM (
    SELECT e.slot + 1 AS slot, e.done, list_min(list_transform(
      list_filter(range(1, len(q) + 1), lambda i: e.done[i] < q[i] AND (e.done[i] * p) // q[i] <= e.slot + 1),
      lambda i: (((e.done[i] + 1) * p + q[i] - 1) // q[i]) * 1000000 + i)) % 1000000 AS pick
    FROM e, l WHERE e.slot + 1 < p)),
k AS (SELECT l.s[e.pick] AS source, l.q[e.pick] AS share, l.p AS p, e.slot,
  row_number() OVER (PARTITION BY e.pick ORDER BY e.slot) - 1 AS k FROM e, l WHERE e.slot >= 0),
n AS (SELECT doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY digest) - 1 AS number, share, p
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT n.doc_id, n.source, n.number, n.number // {BLOCK_DOCS} AS block,
  (n.number // {BLOCK_DOCS} // n.share) * n.p + k.slot AS slot, n.number % {BLOCK_DOCS} AS place
FROM n JOIN k ON n.source IS NOT DISTINCT FROM k.source AND (n.number // {BLOCK_DOCS}) % n.share = k.k
"""
