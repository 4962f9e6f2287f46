"""A quality classifier: histogram gradient-boosted trees over statistics of a document."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewell.llm.common import map_texts
from tradewell.sources.io import materialize

#: Labelled rows that are fitted, those whose id hashes least; the bound on what is collected.
MAX_TRAIN = 40_000
THRESHOLD = 0.7
#: Texts that are scored as one matrix.
_SCORE_ROWS = 1024
FEATURES = (
    "log_chars log_words log_lines word_mean word_sd word_max upper_share digit_share space_share "
    "letter_share other_share bang_share pipe_share stop_share comma_share symbol_share quote_share "
    "distinct_words top_word stutter echo upper_words capital_words no_letter_words distinct_lines "
    "line_mean short_lines ended_lines sentence_mean repeat_three packed_size char_entropy"
).split()
_CLASSES = np.full(128, 4, np.int64)  # 0 letters, 1 digits, 2 blanks, 3 upper-case letters, 4 others
_CLASSES[[c for c in range(128) if chr(c).islower()]] = 0
_CLASSES[[c for c in range(128) if chr(c).isdigit()]] = 1
_CLASSES[[c for c in range(128) if chr(c).isspace()]] = 2
_CLASSES[[c for c in range(128) if chr(c).isupper()]] = 3
_SENTENCE = re.compile(r"[.!?]+")


def statistics(text: str) -> list[float]:
    """The features of one text, in the order of ``FEATURES``; zeros for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(np.minimum(codes, 128), minlength=129)
    kind = np.bincount(_CLASSES, counts[:128], 5)
    share = lambda chars: sum(int(counts[ord(c)]) for c in chars) / n
    seen = counts[counts > 0] / n
    words = text.split()
    total = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    if not total:
        return [math.log1p(n), *[0.0] * (len(FEATURES) - 1)]
    sizes = np.fromiter(map(len, words), np.int64, total)
    times = Counter(words)
    pairs = sum(map(str.__eq__, words, words[1:]))
    echo = sum(map(str.__eq__, words, words[2:]))
    upper = sum(map(str.isupper, words))
    hashes = np.fromiter(map(hash, words), np.int64, total)
    threes = hashes[:-2] * 3 + hashes[1:-1] * 7 + hashes[2:] * 11 if total > 2 else hashes[:0]
    lengths = [len(x) for x in lines]
    return [
        math.log1p(n),
        math.log1p(total),
        math.log1p(len(lines)),
        float(sizes.mean()),
        float(sizes.std()),
        math.log1p(int(sizes.max())),
        kind[3] / n,
        kind[1] / n,
        kind[2] / n,
        (kind[0] + kind[3] + counts[128]) / n,
        float(counts[128]) / n,
        share("!"),
        share("|"),
        share("."),
        share(","),
        share("#*$%&<>{}[]=_~^\\/@+"),
        share("\"'"),
        len(times) / total,
        max(times.values()) / total,
        pairs / total,
        echo / total,
        upper / total,
        sum(w[0].isupper() for w in words) / total,
        sum(not any(map(str.isalpha, w)) for w in words if not w.isalpha()) / total,
        len(set(lines)) / len(lines),
        math.log1p(sum(lengths) / len(lines)),
        sum(x < 30 for x in lengths) / len(lines),
        sum(x.rstrip()[-1] in ".!?:" for x in lines) / len(lines),
        math.log1p(total / (1 + len(_SENTENCE.findall(text)))),
        1 - len(np.unique(threes)) / max(1, len(threes)),
        len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1)) / n,
        float(-(seen * np.log2(seen)).sum()),
    ]


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``x``, the features of each document as an array of floats."""

    def work():
        return lambda texts: [[statistics(t) for t in texts]]

    return map_texts(docs, id_col, text_col, work, "x array<float>")


@dataclass(frozen=True)
class Trees:
    """Trees flattened into arrays: node k of a tree has the children 2k + 1 and 2k + 2.

    ``feature`` and ``cut`` are of inner nodes, (trees, 2 ** depth - 1); ``leaf`` of leaves,
    (trees, 2 ** depth). A node without a split has an infinite cut, so all rows go left.
    """

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: all rows go down a level of a tree at once."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(math.log2(self.leaf.shape[1]))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (leaf.size - 1)]
        return 1 / (1 + np.exp(-total))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.12,
    bins: int = 64,
    penalty: float = 2.0,
    least_rows: int = 20,
) -> Trees:
    """Newton boosting of the logistic loss on histograms of at most ``bins`` quantile bins.

    A level of a tree is one histogram of gradients over (node, feature, bin). Rows of one class
    only, or no rows, give trees that return the share of label 1 (one half without rows).
    """
    inner, leaves = 2**depth - 1, 2**depth
    n, width = (len(y), x.shape[1]) if len(y) else (0, len(FEATURES))
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    start = math.log(share / (1 - share))
    feature = np.zeros((trees, inner), np.int64)
    cut = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if not n or y.min() == y.max():
        return Trees(feature[:0], cut[:0], leaf[:0] if n else leaf[:0], start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    flat = code + np.arange(width) * bins
    total = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            count, first = 2**level, 2**level - 1
            cells = (node[:, None] * (width * bins) + flat).ravel()
            table = [
                np.bincount(cells, np.repeat(w, width), count * width * bins).reshape(count, width, bins).cumsum(2)
                for w in (g, h, np.ones(n))
            ]
            gl, hl, nl = table
            ga, ha, na = (w[:, :, -1:] for w in table)
            gain = gl**2 / (hl + penalty) + (ga - gl) ** 2 / (ha - hl + penalty) - ga**2 / (ha + penalty)
            gain[(nl < least_rows) | (na - nl < least_rows)] = 0
            gain = gain.reshape(count, -1)
            best = gain.argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, best[k]] > 1e-6 and b < len(edges[f]):
                    feature[t, first + k], cut[t, first + k] = f, edges[f][b]
            at = first + node
            node = 2 * node + (x[np.arange(n), feature[t, at]] > cut[t, at])
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[t] = rate * gs / (hs + penalty)
        total += leaf[t][node]
    return Trees(feature, cut, leaf, start)


def label_sample(labels: DataFrame, max_rows: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, y, h) of the labelled ids to learn from, those with the least hash ``h``; some more
    than ``max_rows`` at most, since not every id need have a document.

    ``labels`` is (doc_id, y). Other labels than 0 and 1 and null ids are left out; of several
    labels of an id the least counts.
    """
    y = labels.filter("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    y = materialize(y.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))), "quality-labels")
    share = min(1.0, 1.2 * max_rows / max(1, y.count()))  # what sorts to the driver is bounded too
    return y.filter(F.col("h") <= int(share * (1 << 40)))


def fit_sample(features: DataFrame, sample: DataFrame, max_rows: int = MAX_TRAIN) -> Trees:
    """Fit on the rows of ``features`` (doc_id, x) that ``sample`` names; at most ``max_rows`` rows
    reach the driver, chosen by the hash of the id."""
    rows = features.join(sample, "doc_id").orderBy("h", F.xxhash64("x")).limit(max_rows)
    rows = rows.select("x", "y").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    return fit(x.astype(np.float64), rows["y"].to_numpy().astype(np.float64))


def train(features: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Trees:
    """Fit on the rows of ``features`` (doc_id, x) that ``labels`` (doc_id, y of 0 or 1) names."""
    return fit_sample(features, label_sample(labels, max_rows), max_rows)


def score(features: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``features`` with score and predicted in place of x; the trees' size is fixed."""
    kind = features.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            s = trees.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return features.select("doc_id", "x").mapInArrow(each, f"doc_id {kind}, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    """The quarter of the ids that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    max_rows: int = MAX_TRAIN,
) -> DataFrame:
    """One row for each document: ``doc_id``, ``held_out``, ``score`` and ``predicted``.

    ``labels`` has doc_id and quality; those of held-out ids are not learned from. A score
    depends on the text alone. Null and empty texts have features of zero and a score like any
    other. Without labels every score is one half. Repeated rows and null ids are kept (a null id
    is not held out); an empty table gives no rows. Texts are read once: their statistics, some
    hundred bytes each, are written and used for fitting and scoring.
    """
    features = materialize(statistics_table(docs, id_col, text_col), "quality-features")
    known = labels.select(F.col("doc_id"), F.col("quality").alias("y")).filter(~held_out())
    found = score(features, train(features, known, max_rows), threshold)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    max_rows: int = MAX_TRAIN,
) -> DataFrame:
    """The documents that ``classify`` does not reject, with all their columns.

    The trees are fitted on the statistics of labelled documents alone, found through at most some
    ``max_rows`` ids; then every text is scored and kept or dropped where it is read, so no text and
    no decision is shuffled, whatever the size. Nulls, empty texts, repeated rows and empty tables
    are as in ``classify``.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    known = labels.select(F.col("doc_id"), F.col("quality").alias("y")).filter(~held_out())
    asked = label_sample(known, max_rows)
    taught = rows.join(F.broadcast(asked.select("doc_id")), "doc_id", "left_semi")
    trees = fit_sample(statistics_table(taught), asked, max_rows)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        found = np.zeros(len(texts), bool)
        for first in range(0, len(texts), _SCORE_ROWS):
            part = texts.slice(first, _SCORE_ROWS).to_pylist()
            x = np.array([statistics(t or "") for t in part], np.float32).astype(np.float64)
            found[first : first + len(part)] = trees.score(x) >= threshold
        return pa.array(found)

    return docs.filter(good(F.col(f"`{text_col}`")))
