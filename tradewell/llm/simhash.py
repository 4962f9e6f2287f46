"""SimHash near-duplicates: fingerprints linked through BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewell.llm.common import Forest, components, map_texts, on_blocks, packed
from tradewell.sources.io import materialize

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Rows of a tree; a shard with more is cut into several trees, which are all searched.
TREE_ROWS = 2048


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits: each set if it is set in over half of the hashes of the text's shingles.

    Words are runs of other than ASCII white space with A-Z lowered. A text with fewer words
    than a shingle has one shingle of all of them, a text without words the fingerprint zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1]
        ends = ends[shingle - 1 :] - 1
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
    set_in = np.zeros(64, np.int64)
    rows = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for k in range(0, len(rows), 1 << 16):  # a long text does not become 64 bytes a shingle at once
        set_in += np.unpackbits(rows[k : k + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(rows), bitorder="little").view("<u8")[0])


class BKTree:
    """Integers under Hamming distance; a child hangs on the edge of its distance."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.child: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Position of the new value; positions count from zero in order of insertion."""
        at = len(self.value)
        self.value.append(value)
        self.child.append({})
        node = 0
        while at:
            d = (value ^ self.value[node]).bit_count()
            below = self.child[node].get(d)
            if below is None:
                self.child[node][d] = at
                break
            node = below
        return at

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Positions of the values at most ``radius`` away: by the triangle inequality only
        edges whose distance differs by at most the radius lead to any."""
        todo = [0] if self.value else []
        while todo:
            node = todo.pop()
            d = (value ^ self.value[node]).bit_count()
            if d <= radius:
                yield node
            todo += [c for edge, c in self.child[node].items() if d - radius <= edge <= d + radius]


def _links(run: pd.DataFrame, radius: int) -> pd.DataFrame | None:
    """Links that connect what is connected within a block; as few as do that."""
    values = [int(v) & 0xFFFFFFFFFFFFFFFF for v in run["fp"]]
    tree, forest, found = BKTree(), Forest(len(values)), []
    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            if forest.join(i, j):
                found.append((run["fp"].iat[i], run["fp"].iat[j]))
        tree.add(v)
    return pd.DataFrame(found, columns=["a", "b"]) if found else None


def link_fingerprints(prints: DataFrame, radius: int = MAX_BITS, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(a, b) links between distinct fingerprints (column ``fp``, 64 bits as a long) that
    connect exactly those connected by links of at most ``radius`` bits.

    Cut into radius + 2 ranges of bits, two fingerprints at most ``radius`` bits apart agree in
    two ranges at least, so they share the shard of that pair of ranges. A shard is a tree; one
    that holds many fingerprints is cut into trees of bounded size, each pair of which meets in
    a task. Nothing is broadcast, as no bound holds for what a shard tree may weigh.
    """
    n = radius + 2
    cuts = [round(64 * k / n) for k in range(n + 1)]
    part = [
        F.shiftrightunsigned(F.col("fp"), cuts[k]).bitwiseAND((1 << (cuts[k + 1] - cuts[k])) - 1)
        for k in range(n)
    ]
    keys = [F.xxhash64(F.lit(i), F.lit(j), part[i], part[j]) for i, j in combinations(range(n), 2)]
    members = prints.select("fp", F.explode(F.array(*keys)).alias("shard"))
    return on_blocks(members, "shard", "fp", tree_rows, lambda run: _links(run, radius), "a long, b long")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> DataFrame:
    """doc_id, tag (hash of the text), fp, group (least fingerprint) and component_id."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    keyed = rows.select(F.struct("doc_id", F.xxhash64("text").alias("tag")).alias("key"), "text")

    def work():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    prints = map_texts(keyed, "key", "text", work, "fp long").select("doc_id.*", "fp")
    prints = materialize(prints, "simhash-prints")
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(link_fingerprints(points.select("fp"), radius), "a", "b", "simhash-links")
    linked = points.join(roots, points["fp"] == roots["node"], "left")
    linked = linked.select("fp", "least", F.coalesce("root", "fp").alias("group"))
    linked = materialize(linked, "simhash-points")
    least = linked.groupBy("group").agg(F.min("least").alias("component_id"))
    return prints.join(linked.select("fp", "group").join(least, "group"), "fp")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = MAX_BITS,
) -> DataFrame:
    """One row for each document: ``doc_id``, ``fp`` (the fingerprint as a signed long),
    ``component_id``, the least id reachable over links of at most ``radius`` bits, and
    ``group``, the least fingerprint of the component.

    Texts are read once; equal fingerprints are one point from there on, so copies form no
    pairs. Null and empty texts have the fingerprint zero, which links like any other. A null id
    counts as the greatest: only a component of null ids has a null id. Repeated rows are kept.
    An empty table gives no rows. The id is taken as a long.
    """
    found = _classes(docs, id_col, text_col, shingle, radius)
    return found.select("doc_id", "fp", "component_id", "group")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = MAX_BITS,
) -> DataFrame:
    """The documents without those near another one: of each component one row of its least id
    stays, with all columns of ``docs``; of several rows with that id, one of least fingerprint,
    and of rows equal in id and text the one whose columns hash least.
    """
    classes = _classes(docs, id_col, text_col, shingle, radius)
    first = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = first.groupBy("group").agg(
        F.min(F.struct("fp", "tag", "doc_id")).alias("one"),
    )
    one = materialize(one.select("one.doc_id", "one.tag"), "simhash-kept")
    key = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tag"]
    rows = docs.select(packed(docs), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("tag"))
    rows = rows.select("_row", *key).join(one.select(*key).distinct(), ["no_id", "id", "tag"])
    repeated = classes.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = materialize(repeated.distinct(), "simhash-repeated")
    if repeated.isEmpty():
        return rows.select("_row.*")
    names = ["no_id", "id", "tag"]
    alone = rows.join(repeated, names, "left_anti").select("_row.*")
    several = rows.join(repeated, names).groupBy(*names)
    least = several.agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return alone.unionByName(least.select("_row.*"))
