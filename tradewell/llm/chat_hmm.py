"""Chat transcripts to canonical turns: a hidden Markov model recovers who speaks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradewell.sources.io import materialize

ROLES = ("system", "user", "assistant")
#: States: the line that opens a turn of a role, then a line that goes on with it.
STATES = tuple((r, opens) for opens in (True, False) for r in range(len(ROLES)))
N = len(STATES)
# Names that speakers go by.
NAMES = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "client", "question", "q", "you", "prompter"),
    "assistant": ("assistant", "ai", "bot", "model", "agent", "answer", "a", "gpt", "chatgpt", "response"),
}
_WORD = "|".join(sorted((n for v in NAMES.values() for n in v), key=lambda n: (-len(n), n)))
#: A speaker marker at the start of a line: ``User:``, ``**Bot**:``, ``[SYSTEM]``, ``### Human:``.
MARKER = rf"^\s*(?:[#>*_\[(<|]+\s*)?({_WORD})(?:\s*[\])>|*_]+\s*:?|\s*:)\s*"
#: Share of turns that are taken to open without a marker, whatever the fitted table shows.
UNMARKED = 0.1
FEATURES = {"marker": 4, "question": 2, "size": 4, "item": 2, "blank": 2}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def role_of(name: Column) -> Column:
    """Number of the role a speaker's name stands for, null for others."""
    low = F.lower(F.trim(name))
    found = None
    for k, role in enumerate(ROLES):
        hit = low.isin(*NAMES[role])
        found = F.when(hit, F.lit(k)) if found is None else found.when(hit, F.lit(k))
    return found


def transcript_lines(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, line, text): turns as a transcript shows them, with the name of the
    speaker, where there is one, before the first line. A null text is one empty line."""
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.col(f"`{role}`").alias("_role"),
        F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n").alias("_lines"),
    )
    lines = rows.select("conv_id", "turn", "_role", F.posexplode("_lines").alias("line", "text"))
    named = F.when((F.col("line") == 0) & F.col("_role").isNotNull(), F.concat("_role", F.lit(": "), "text"))
    return lines.select("conv_id", "turn", "line", F.coalesce(named, F.col("text")).alias("text"))


def features(text: Column) -> dict[str, Column]:
    """What the model sees of a line, as small numbers."""
    body = F.regexp_replace(text, f"(?i){MARKER}", "")
    size = F.char_length(body)
    return {
        "marker": F.coalesce(role_of(F.regexp_extract(text, f"(?i){MARKER}", 1)) + 1, F.lit(0)),
        "question": F.rtrim(body).endswith("?").cast("int"),
        "size": (size > 40).cast("int") + (size > 120).cast("int") + (size > 400).cast("int"),
        "item": body.rlike(r"^\s*(?:[-*•]|\d+[.)]|```|[|])").cast("int"),
        "blank": (F.trim(body) == "").cast("int"),
    }


@dataclass(frozen=True)
class Model:
    """Logarithms: ``start`` by state, ``move`` from state to state, and for each feature a table
    by (state, value)."""

    start: np.ndarray
    move: np.ndarray
    see: dict[str, np.ndarray]

    def emissions(self, table: pa.Table) -> np.ndarray:
        return sum(self.see[f][:, table[f].to_numpy()].T for f in FEATURES)


def fit(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Counts over all turns whose speaker has a known name, each with half a row more.

    A turn follows another if its number is the next one of the conversation. Of the counts,
    ``UNMARKED`` of the opening lines are taken to have no marker. Without any turns all
    possible steps are equally likely.
    """
    known = turns.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        role_of(F.col(f"`{role}`")).alias("r"),
        F.size(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n")).alias("n"),
    ).filter("r is not null and conv_id is not null and turn is not null")
    known = materialize(known.withColumn("last", F.col("r") + F.when(F.col("n") > 1, len(ROLES)).otherwise(0)), "chat-known")
    after = known.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("r").alias("next"))
    steps = known.join(after, ["conv_id", "turn"]).groupBy("last", "next").count().collect()
    before = known.select("conv_id", (F.col("turn") + 1).alias("turn")).distinct()
    starts = known.join(before, ["conv_id", "turn"], "left_anti").groupBy("r").count().collect()
    inside = known.filter("n > 1").groupBy("r").agg(F.count("*"), F.sum(F.col("n") - 2)).collect()

    start = np.array([0.5 if opens else 0.0 for _, opens in STATES])
    move = np.array([[0.5 if opens or a == b else 0.0 for b, opens in STATES] for a, _ in STATES])
    for r, n in starts:
        start[r] += n
    for last, following, n in steps:
        move[last, following] += n
    for r, first, rest in inside:
        move[r, r + len(ROLES)] += first
        move[r + len(ROLES), r + len(ROLES)] += rest

    first = F.when(F.col("line") == 0, 0).otherwise(len(ROLES))
    lines = turns.select(
        role_of(F.col(f"`{role}`")).alias("r"),
        F.col(f"`{role}`").alias("name"),
        F.posexplode(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n")).alias("line", "text"),
    ).filter("r is not null")
    shown = F.when(F.col("line") == 0, F.concat("name", F.lit(": "), "text")).otherwise(F.col("text"))
    seen = lines.select((F.col("r") + first).alias("state"), shown.alias("text"))
    seen = seen.select("state", *[c.alias(f) for f, c in features(F.col("text")).items()])
    see = {f: np.full((N, size), 0.5) for f, size in FEATURES.items()}
    for row in seen.groupBy("state", *FEATURES).count().collect():  # at most the product of the sizes
        for f in FEATURES:
            see[f][row["state"], row[f]] += row["count"]
    see = {f: t / t.sum(1, keepdims=True) for f, t in see.items()}
    opening = see["marker"][: len(ROLES)]
    opening[:] = (1 - UNMARKED) * opening
    opening[:, 0] += UNMARKED
    with np.errstate(divide="ignore"):
        return Model(
            np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), {f: np.log(t) for f, t in see.items()}
        )


def through(see: np.ndarray, move: np.ndarray) -> np.ndarray:
    """(before, last): the best score of the lines, from each state of the line before them to
    each state of the last; scores add and the largest is taken, so parts can be joined."""
    best = move + see[0]
    for row in see[1:]:
        best = (best[:, :, None] + move[None]).max(1) + row
    return best


def viterbi(see: np.ndarray, move: np.ndarray, first: np.ndarray, last: int | None = None) -> np.ndarray:
    """The best states of the lines; ``first`` has the scores of coming to each state of the
    first line, ``last`` fixes the state of the last."""
    score = first + see[0]
    back = np.zeros((len(see), N), np.int8)
    for t in range(1, len(see)):
        ways = score[:, None] + move
        back[t] = ways.argmax(0)
        score = ways.max(0) + see[t]
    states = np.zeros(len(see), np.int64)
    states[-1] = int(score.argmax()) if last is None else last
    for t in range(len(see) - 1, 0, -1):
        states[t - 1] = back[t, states[t]]
    return states


def _parts(table: pa.Table) -> list[tuple[str, int, int]]:
    """(conversation, begin, end) of the runs of a sorted block."""
    keys = np.asarray(table["key"].to_pylist(), dtype=object)
    cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist(), len(keys)]
    return [(keys[a], a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _edges(table: pa.Table, model: Model) -> pa.Table:
    """Of the conversations that a block begins and ends with, which may reach beyond it: the
    scores through the block's part, from each state before it and as a beginning."""
    table = table.sort_by("seq")
    parts = _parts(table)
    see = model.emissions(table)
    out = []
    for key, a, b in {parts[0], parts[-1]}:
        best = through(see[a:b], model.move)
        alone = (model.start + see[a])[None]
        for row in see[a + 1 : b]:
            alone = (alone[:, :, None] + model.move[None]).max(1) + row
        out.append((table["block"][0].as_py(), key, best.ravel().tolist(), alone.ravel().tolist()))
    names = ["block", "key", "best", "alone"]
    return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _EDGES, strict=True)], names)


_EDGES = [pa.field(n, t) for n, t in (("block", pa.int32()), ("key", pa.string()), ("best", pa.list_(pa.float64())), ("alone", pa.list_(pa.float64())))]


def _tie(parts: pd.DataFrame) -> pd.DataFrame:
    """Viterbi over the blocks of one conversation, a number for each state and block: the state
    before each block's part (-1 for none) and the state it ends with."""
    parts = parts.sort_values("block")
    best = [np.array(b).reshape(N, N) for b in parts["best"]]
    score, backs = np.array(parts["alone"].iloc[0]), []
    for b in best[1:]:
        ways = score[:, None] + b
        backs.append(ways.argmax(0))
        score = ways.max(0)
    ends = [int(score.argmax())]
    for back in reversed(backs):
        ends.insert(0, int(back[ends[0]]))
    return pd.DataFrame({"block": parts["block"], "key": parts["key"], "before": [-1, *ends[:-1]], "last": ends})


def _decode(table: pa.Table, ties: pa.Table, model: Model) -> pa.Table:
    table = table.sort_by("seq")
    see = model.emissions(table)
    tied = {r["key"]: r for r in ties.to_pylist()}
    states, change = np.zeros(len(see), np.int64), np.zeros(len(see), bool)
    for key, a, b in _parts(table):
        tie = tied.get(key)
        first = model.start if tie is None or tie["before"] < 0 else model.move[tie["before"]]
        states[a:b] = viterbi(see[a:b], model.move, first, tie["last"] if tie else None)
        change[a] = True
    opens = states < len(ROLES)
    role = pa.array([ROLES[s % len(ROLES)] for s in states])
    closes = pa.array([*(opens | change)[1:].tolist(), None], pa.bool_())  # of the last, the next block tells
    names = ["conv_id", "turn", "line", "text"]
    return pa.table(
        [table["block"], table["seq"], table["key"], *[table[n] for n in names], role, pa.array(opens), closes],
        ["block", "seq", "key", *names, "role", "opens", "closes"],
    )


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """One row for each line of the transcripts: ``conv_id``, ``turn``, ``line``, ``role``,
    ``opens`` and ``closes`` (whether a turn begins or ends with it) and ``rendered``, its piece
    of the canonical text. The pieces of a conversation in order of (turn, line) are that text:
    ``<|im_start|>role``, a new line, the turn without its speaker marker, ``<|im_end|>``.

    ``lines`` has conv_id, turn, line and text; null ids are one conversation, null numbers come
    first, lines equal in both numbers are ordered by their text, a null text is empty. Rows equal
    in all are lines one after another. An empty table gives no rows.

    Lines are cut into sorted ranges of like size, so that a conversation of any length is many
    tasks. The best path through a range is known for each state before and after it; a second
    step goes over these few numbers for conversations that reach over ranges, and a third finds
    the states within each range, given those around it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    rows = lines.select(
        "conv_id", "turn", "line", F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("key"),
    )
    order = ["key", "turn", "line", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("*", *[c.cast("int").alias(f) for f, c in features(F.col("text")).items()])
    rows = rows.withColumns({"block": F.spark_partition_id(), "seq": F.monotonically_increasing_id()})
    rows = materialize(rows, "chat-lines")

    light = rows.select("block", "seq", "key", *FEATURES)
    edges = light.groupBy("block").applyInArrow(
        lambda t: _edges(t, model), "block int, key string, best array<double>, alone array<double>"
    )
    edges = materialize(edges, "chat-edges")
    several = edges.groupBy("key").count().filter("count > 1").select("key")
    ties = edges.join(several, "key").groupBy("key").applyInPandas(_tie, "block int, key string, before int, last int")
    ties = materialize(ties, "chat-ties")
    found = rows.groupBy("block").cogroup(ties.groupBy("block")).applyInArrow(
        lambda t, e: _decode(t, e, model),
        f"block int, seq long, key string, conv_id {kinds['conv_id']}, turn {kinds['turn']}, line {kinds['line']}, "
        "text string, role string, opens boolean, closes boolean",
    )
    found = materialize(found, "chat-states")
    heads = found.groupBy("block").agg(F.min_by("key", "seq").alias("k"), F.min_by("opens", "seq").alias("o"))
    every = Window.partitionBy(F.lit(0)).orderBy("block")  # a row for each block
    heads = heads.select("block", F.lead("k").over(every).alias("next_key"), F.lead("o").over(every).alias("next_opens"))
    last = F.col("next_key").isNull() | (F.col("next_key") != F.col("key")) | F.col("next_opens")
    ready = found.join(heads, "block").withColumn("closes", F.coalesce("closes", last))
    body = F.when(F.col("opens"), F.regexp_replace("text", f"(?i){MARKER}", "")).otherwise(F.col("text"))
    head = F.when(F.col("opens"), F.concat(F.lit(OPEN), "role", F.lit("\n"))).otherwise("")
    tail = F.when(F.col("closes"), F.lit(CLOSE + "\n")).otherwise("\n")
    return ready.select("conv_id", "turn", "line", "role", "opens", "closes", F.concat(head, body, tail).alias("rendered"))
