"""Toxic texts by compression distance: each window of a text is compressed with a dictionary
trained on toxic text and with one trained on ordinary text, and the lengths are compared."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewell.llm.common import map_texts
from tradewell.sources.io import materialize

#: Labelled documents of each class that are looked at, and windows of each class that the
#: dictionaries are trained on, those that hash least; the bounds on what is collected.
MAX_TRAIN, MAX_WINDOWS = 10_000, 60_000
THRESHOLD = 0.7
#: A window is so many words; a longer word is cut into pieces of so many bytes.
WINDOW_WORDS, PIECE_BYTES = 8, 64
#: Bytes of the dictionary both classes share, and of each class's own.
SHARED_BYTES, OWN_BYTES = 65_536, 4_096
LEVEL = 5
#: Differences of compressed lengths are counted from -LESS to MORE bytes, larger ones at the ends.
LESS, MORE = 4, 8
BINS = LESS + MORE + 1
#: A word is peculiar to a class if it is so many times as frequent there, with at least this
#: logarithm of the likelihood ratio.
TIMES, EVIDENCE = 8, 15.0
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MARKS = b".,;:!?\"'()"


def windows(text: str | None) -> list[bytes]:
    """The text in disjoint windows, A-Z lower-cased, words one blank apart; none if it has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if any(len(w) > PIECE_BYTES for w in words):
        words = [w[i : i + PIECE_BYTES] for w in words for i in range(0, len(w), PIECE_BYTES)]
    return [b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]


def peculiar(own: Sequence[bytes], other: Sequence[bytes]) -> list[bytes]:
    """What is left of the windows ``own`` when only words peculiar to them against ``other``
    stay; windows without any are left out."""
    count = lambda ws: Counter(x for w in ws for x in {y.strip(_MARKS) for y in w.split()})
    here, there = count(own), count(other)
    n, m = len(own), max(1, len(other))

    def counts(x: bytes) -> bool:
        a, b = here[x], there[x]
        even = (a + b) / (n + m)
        ratio = a * math.log(a / (n * even)) + (b * math.log(b / (m * even)) if b else 0)
        return ratio >= EVIDENCE and a / n >= TIMES * (b + 0.5) / m

    keep = {x for x in here if x and counts(x)}
    left = ([x for x in w.split() if x.strip(_MARKS) in keep] for w in own)
    return [b" " + b" ".join(x) + b" " for x in left if x]


def dictionary(samples: Sequence[bytes], size: int) -> bytes:
    """The bytes of a dictionary trained on the samples. Samples too few or too much alike for
    training are their own dictionary, the last ``size`` bytes of them."""
    try:
        return zstandard.train_dictionary(size, list(samples)).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def sizes(content: bytes) -> Callable[[bytes], int]:
    """The compressed length of a window with these bytes as dictionary."""
    made = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    press = zstandard.ZstdCompressor(
        level=LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False
    ).compress
    return lambda window: len(press(window))


@dataclass(frozen=True)
class Distance:
    """The dictionaries of the two classes. They end with the same bytes, which stand nearest to
    the window, so that a window of what both classes use has nearly the same length with each."""

    toxic: bytes
    ordinary: bytes

    def histogram(self) -> Callable[[str | None], np.ndarray]:
        """For a text, the number of its windows by how many bytes the toxic dictionary saves."""
        toxic, ordinary = sizes(self.toxic), sizes(self.ordinary)

        def of(text: str | None) -> np.ndarray:
            saved = [ordinary(w) - toxic(w) for w in windows(text)]
            return np.bincount(np.clip(saved, -LESS, MORE).astype(np.int64) + LESS, minlength=BINS)

        return of


def train(toxic: Sequence[bytes], ordinary: Sequence[bytes]) -> Distance:
    """Dictionaries from windows of both classes: a shared part from ordinary text, and before
    it a part of each class from the words peculiar to it."""
    shared = dictionary(ordinary, SHARED_BYTES)
    own = [dictionary(peculiar(a, b), OWN_BYTES) for a, b in ((toxic, ordinary), (ordinary, toxic))]
    return Distance(own[0] + shared, own[1] + shared)


@dataclass(frozen=True)
class Calibration:
    """``weight`` is the evidence of a window in each bin; ``level`` and ``chance`` are the ends of
    the non-decreasing steps from a text's summed evidence to the chance of label 1."""

    weight: np.ndarray
    level: np.ndarray
    chance: np.ndarray

    def score(self, histograms: np.ndarray) -> np.ndarray:
        return np.interp(histograms @ self.weight, self.level, self.chance)


def calibrate(histograms: np.ndarray, y: np.ndarray, weight: tuple[float, float]) -> Calibration:
    """From labelled texts that the dictionaries were not trained on; ``weight`` says for how
    many labelled texts one of label 0 and one of label 1 stands.

    The evidence of a bin is the logarithm of how much likelier its windows are in toxic texts.
    Chances are the least-squares non-decreasing fit (pool adjacent violators) over the summed
    evidence, with one half of a text of each label added to every step.
    """
    of = [histograms[y == k].sum(0) + 0.5 for k in (0, 1)]
    evidence = np.log(of[1] / of[1].sum()) - np.log(of[0] / of[0].sum())
    total = histograms @ evidence
    steps: list[list[float]] = []  # least and largest evidence, weight, weight of label 1
    for t, label in sorted(zip(total.tolist(), y.tolist(), strict=True)):
        w = weight[int(label)]
        steps.append([t, t, w, w * label])
        while len(steps) > 1 and steps[-2][3] * steps[-1][2] >= steps[-1][3] * steps[-2][2]:
            _, last, more, ones = steps.pop()
            steps[-1] = [steps[-1][0], last, steps[-1][2] + more, steps[-1][3] + ones]
    if not steps:
        return Calibration(np.zeros(BINS), np.zeros(1), np.full(1, 0.5))
    chance = np.maximum.accumulate([(ones + 0.5) / (n + 1) for _, _, n, ones in steps])
    return Calibration(evidence, np.array([s[:2] for s in steps]).ravel(), np.repeat(chance, 2))


def _of_class(known: DataFrame, max_rows: int) -> tuple[DataFrame, tuple[float, float]]:
    """At most about ``max_rows`` labelled ids of each class, chosen by a hash of the id, and for
    how many labelled ids of its class each stands."""
    known = materialize(known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))), "toxicity-labels")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two numbers
    share = [min(1.0, max_rows / max(1, counts.get(k, 0))) for k in (0, 1)]
    limit = F.when(F.col("y") == 1, int(share[1] * (1 << 40))).otherwise(int(share[0] * (1 << 40)))
    return known.filter(F.col("h") <= limit), (1 / share[0], 1 / share[1])


def fit(docs: DataFrame, known: DataFrame, max_rows: int, max_windows: int) -> tuple[Distance, Calibration]:
    """Dictionaries and calibration from ``docs`` (doc_id, text) that ``known`` (doc_id, y) names.

    One half of the ids, by hash, gives windows to the dictionaries, equal windows once; the
    other half calibrates.
    """
    chosen, weight = _of_class(known, max_rows)
    half = F.shiftright(F.xxhash64(F.lit(5), "doc_id"), 20) % 2 == 0
    # At most twice max_rows ids; a table of that proven size.
    picked = docs.join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")
    picked = materialize(picked.select("doc_id", "y", "text", half.alias("half")), "toxicity-picked")
    keyed = picked.select(F.struct("doc_id", "y").alias("doc_id"), "text", "half")

    cut = map_texts(keyed.filter("half"), "doc_id", "text", lambda: lambda texts: [[windows(t) for t in texts]], "w array<binary>")
    cut = materialize(cut.select("doc_id.y", F.explode("w").alias("w")).distinct(), "toxicity-windows")
    samples = []
    for k in (1, 0):
        some = cut.filter(F.col("y") == k).select("w", F.xxhash64("w").alias("h"))
        samples.append([bytes(r["w"]) for r in some.orderBy("h", "w").limit(max_windows).collect()])
    distance = train(*samples)

    counts = map_texts(keyed.filter("not half"), "doc_id", "text", lambda: _counting(distance), "n array<int>")
    rows = counts.select("doc_id.y", "n").toArrow()  # a few numbers for each of the picked ids
    n = np.asarray(rows["n"].combine_chunks().flatten() if rows.num_rows else [], np.float64).reshape(-1, BINS)
    y = np.asarray(rows["y"], np.int64) if rows.num_rows else np.zeros(0, np.int64)
    order = np.lexsort((*n.T, y))
    return distance, calibrate(n[order], y[order], weight)


def _counting(distance: Distance) -> Callable[[list[str]], list[list]]:
    of = distance.histogram()
    return lambda texts: [[of(t).tolist() for t in texts]]


def held_out(doc_id: str = "doc_id") -> Column:
    """The third of the ids that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    max_rows: int = MAX_TRAIN,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """One row for each document: ``doc_id``, ``held_out``, ``score``, ``predicted``, and
    ``n_windows``, the number of its windows.

    ``labels`` has doc_id and toxic; those of held-out ids, of null ids and other than 0 and 1 are
    not learned from, of several labels of an id the largest counts. A score depends on the text
    alone: windows of the whole text are compressed with both dictionaries, and each gives
    evidence by the difference of its lengths. Null texts, empty ones and ones of blanks have no
    window and the score of no evidence. Repeated rows and null ids are kept (a null id is not
    held out); an empty table gives no rows. Without labels every score is one half.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    known = labels.select("doc_id", F.col("toxic").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(~held_out()).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    distance, calibration = fit(rows, known, max_rows, max_windows)

    def work() -> Callable[[list[str]], list[list]]:
        of = distance.histogram()

        def score(texts: list[str]) -> list[list]:
            n = np.array([of(t) for t in texts]).reshape(-1, BINS)
            return [calibration.score(n).tolist(), n.sum(1).tolist()]

        return score

    found = map_texts(rows, "doc_id", "text", work, "score double, n_windows long")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return found.select("doc_id", held_out().alias("held_out"), "score", predicted, "n_windows")
