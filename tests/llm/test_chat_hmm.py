import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewell.llm import chat_hmm as ch
from tradewell.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def turns(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet")


@pytest.fixture(scope="module")
def model(turns):
    return ch.fit(turns)


def by_conversation(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.conv_id].append(r)
    for found in out.values():
        found.sort(key=lambda r: (-1 if r.turn is None else r.turn, -1 if r.line is None else r.line))
    return out


def test_query_renders_every_conversation(spark, sf, turns):
    want = defaultdict(str)
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        want[r.conv_id] += f"<|im_start|>{r.role}\n{r.text}<|im_end|>\n"
    got = by_conversation(queries.op8_chat_hmm(spark, sf).collect())
    assert {c: "".join(r.rendered for r in rows) for c, rows in got.items()} == want


def unmarked(turns, every=4):
    """Transcripts in which a quarter of the turns have lost their marker."""
    lines = ch.transcript_lines(turns)
    lost = F.crc32(F.concat_ws("/", "conv_id", "turn").cast("binary")) % every == 0
    bare = F.regexp_replace("text", r"^\w+: ", "")
    return lines.withColumn("text", F.when(lost & (F.col("line") == 0), bare).otherwise(F.col("text")))


def test_roles_come_back_without_markers(turns, model):
    """Far better than taking every unmarked line as the turn before it."""
    truth = {(r.conv_id, r.turn): r.role for r in turns.collect()}
    got = ch.parse(unmarked(turns), model).collect()
    assert np.mean([truth[r.conv_id, r.turn] == r.role for r in got]) > 0.8


@pytest.mark.parametrize("one", [False, True])
def test_ranges_give_the_best_path(spark, turns, model, one):
    """Also where one conversation reaches over all ranges of the table."""
    lines = unmarked(turns)
    if one:
        lines = lines.select(F.lit(1).cast("long").alias("conv_id"), F.xxhash64("conv_id", "turn").alias("turn"), "line", "text")
    seen = lines.select("*", *[c.alias(f) for f, c in ch.features(F.col("text")).items()]).collect()
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = by_conversation(ch.parse(lines, model).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    for conv, rows in by_conversation(seen).items():
        see = np.stack([sum(model.see[f][:, r[f]] for f in ch.FEATURES) for r in rows])

        def score(path, see=see):
            steps = zip(path, path[1:], strict=False)
            return model.start[path[0]] + see[range(len(path)), path].sum() + sum(model.move[a, b] for a, b in steps)

        best = ch.viterbi(see, model.move, model.start)
        mine = [ch.STATES.index((ch.ROLES.index(r.role), r.opens)) for r in got[conv]]
        assert score(mine) == pytest.approx(score(best))
        opens = [r.opens for r in got[conv]]
        assert [r.closes for r in got[conv]] == [*opens[1:], True]


@pytest.mark.parametrize("n", [1, 2, 5])
@pytest.mark.parametrize("whole", [False, True])
def test_best_path_is_best_of_all_sequences(n, whole):
    """Every sequence of states is scored; whole numbers make ties, and some moves are forbidden."""
    rng = np.random.default_rng(n)
    draw = lambda *size: rng.integers(-3, 1, size).astype(float) if whole else rng.normal(size=size)
    see, move, first = draw(n, ch.N), draw(ch.N, ch.N), draw(ch.N)
    move[0, 3:] = -np.inf
    score = {
        path: first[path[0]] + sum(see[t, k] for t, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))
        for path in itertools.product(range(ch.N), repeat=n)
    }
    assert score[tuple(ch.viterbi(see, move, first).tolist())] == pytest.approx(max(score.values()))
    for last in range(ch.N):
        path = tuple(ch.viterbi(see, move, first, last).tolist())
        assert path[-1] == last and score[path] == pytest.approx(max(v for k, v in score.items() if k[-1] == last))
    # A block alone: the best way to each last state from each state before it.
    best = ch.through(see, move)
    for before, last in itertools.product(range(ch.N), repeat=2):
        ways = [v - first[k[0]] + move[before, k[0]] for k, v in score.items() if k[-1] == last]
        assert best[before, last] == pytest.approx(max(ways))


@pytest.mark.parametrize(
    ("line", "role"),
    [("User: hi", 2), ("**Bot**: hi", 3), ("### Human: hi", 2), ("[SYSTEM] hi", 1), ("Q: hi", 2), ("users: hi", 0), ("time: hi", 0)],
)
def test_markers(spark, line, role):
    df = spark.createDataFrame([(line,)], "text string")
    assert df.select(ch.features(F.col("text"))["marker"]).first()[0] == role


def test_odd_rows(spark, model):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (1, 2, "narrator", "x\n\ny"), (None, 0, "assistant", "z"),
        (None, None, "user", ""), (2, None, None, "word " * 20_000), (3, 5, "SYSTEM", "User: not\nBot: these"),
    ]
    turns = spark.createDataFrame(rows, SCHEMA)
    got = ch.parse(ch.transcript_lines(turns), model)
    assert got.count() == 11 and got.filter("role is null or rendered is null").count() == 0
    firsts = [r.opens for rs in by_conversation(got.collect()).values() for r in rs[:1]]
    assert all(firsts)
    clash = turns.select("*", *[F.lit(1).alias(c) for c in ("key", "block", "seq", "line", "marker", "r", "n", "next", "last")])
    same = ch.parse(ch.transcript_lines(clash), ch.fit(turns))
    assert sorted(map(str, same.collect())) == sorted(map(str, ch.parse(ch.transcript_lines(turns), ch.fit(clash)).collect()))
    empty = turns.limit(0)
    nothing = ch.fit(empty)
    assert ch.parse(ch.transcript_lines(empty), nothing).collect() == []
    assert ch.parse(ch.transcript_lines(turns), nothing).count() == 11
