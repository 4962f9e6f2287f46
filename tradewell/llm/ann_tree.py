"""Approximate nearest neighbours by a hierarchical k-means tree."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradewell.sources.io import materialize

#: Vectors that the tree is fitted on and queries that the recall is measured with, those whose
#: id hashes least; the bounds on what is collected.
MAX_FIT, MAX_CALIBRATE = 32_768, 256
BRANCHES, LEAF_FIT, ROUNDS = 8, 64, 8
TARGET = 0.95
#: Vectors and queries that meet in one task, queries that are routed in one, and the most tasks.
SHARD_ROWS, QUERY_ROWS, ROUTE_ROWS, MOST_TASKS = 4_096, 4_096, 256, 20_000
#: By how much a matrix product of unit vectors may differ from the sum in order.
SLACK = 1e-9


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays: the children of node i are ``first[i] .. first[i] + count[i] - 1``; a node
    without children is a leaf and has a number in ``leaf``."""

    center: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray
    longest: float

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with one more coordinate that makes all as long as the longest, so that the
        largest inner product with a query is the least distance to it."""
        rest = np.maximum(self.longest**2 - (x * x).sum(1), 0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], 1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down to the nearest child, level by level."""
        x = self.lifted(x)
        node = np.zeros(len(x), np.int64)
        while len(inner := np.unique(node[self.count[node] > 0])):
            for i in inner:
                rows = np.nonzero(node == i)[0]
                lo, hi = self.first[i], self.first[i] + self.count[i]
                node[rows] = lo + _nearest(x[rows], self.center[lo:hi])
        return self.leaf[node]

    def far(self, queries: np.ndarray) -> np.ndarray:
        """The squared distance of each query to the centre of each node, less its own square."""
        q = np.concatenate([queries, np.zeros((len(queries), 1))], 1)
        return (self.center * self.center).sum(1) - 2 * (q @ self.center.T)

    def visits(self, far: np.ndarray) -> Iterator[int]:
        """Leaves in the order of best-bin-first: the queue gives the node whose centre is
        nearest to the query, of all that hang on nodes opened so far."""
        near, first, count, leaf = far.tolist(), self.first.tolist(), self.count.tolist(), self.leaf.tolist()
        queue = [(0.0, 0)]
        while queue:
            _, i = heapq.heappop(queue)
            if not count[i]:
                yield leaf[i]
                continue
            for k in range(first[i], first[i] + count[i]):
                heapq.heappush(queue, (near[k], k))


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(1) - 2 * (x @ centers.T)).argmin(1)


def grow(x: np.ndarray, longest: float, seed: int = 7) -> Tree:
    """K-means of the sample into ``BRANCHES`` parts, and of each part again, down to parts of at
    most ``LEAF_FIT`` vectors or of equal ones."""
    rng = np.random.default_rng(seed)
    start = Tree(np.zeros((1, x.shape[1] + 1)), *[np.zeros(1, np.int64)] * 3, longest)
    x = start.lifted(x)
    center, first, count, leaf = [np.zeros(x.shape[1])], [0], [0], [-1]
    todo, leaves = [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        parts: list[np.ndarray] = []
        if len(rows) > LEAF_FIT:
            means = x[rng.choice(rows, BRANCHES, replace=False)]
            for _ in range(ROUNDS):
                of = _nearest(x[rows], means)
                means = np.stack([x[rows[of == k]].mean(0) if (of == k).any() else means[k] for k in range(BRANCHES)])
            of = _nearest(x[rows], means)
            parts = [rows[of == k] for k in range(BRANCHES) if (of == k).any()]
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        first[node], count[node] = len(center), len(parts)
        for part in parts:
            todo.append((len(center), part))
            center.append(x[part].mean(0))
            first.append(0)
            count.append(0)
            leaf.append(-1)
    return Tree(np.stack(center), np.array(first), np.array(count), np.array(leaf), longest)


def products(queries: np.ndarray, vectors: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of queries and vectors at the given places in double precision, summed in
    the order of the coordinates, so that equal vectors have equal ones wherever computed."""
    total = np.zeros(len(rows))
    for q, v in zip(queries.T, vectors.T, strict=True):
        total += q[rows] * v[at]
    return total


def best(
    near: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the ``k`` largest products of each query, ties to smaller ids.

    ``near`` holds matrix products, -inf where a vector is not to be taken. They only choose what
    may be among the best; the scores are summed in order.
    """
    most = np.sqrt((queries * queries).sum(1)) * np.sqrt((vectors * vectors).sum(1).max(initial=0))
    least = np.full(len(queries), -np.inf)
    if near.shape[1] > k:
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
    least = np.nan_to_num(least - SLACK * most, nan=-np.inf, neginf=-np.inf)
    rows, at = np.nonzero((near >= least[:, None]) & (near > -np.inf))
    score = products(queries, vectors, rows, at)
    order = np.lexsort((ids[at], -score, rows))
    rows, at, score = rows[order], at[order], score[order]
    turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[turn < k], at[turn < k], score[turn < k]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of vectors that take part: with an id, not null, without null or non-finite
    components, not zero, and of the most frequent length (ties: the shorter)."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = rows.filter("id is not null and v is not null").filter(
        ~F.exists("v", bad) & F.exists("v", lambda c: c != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["d"] if sizes else 0))


def _chosen(rows: DataFrame, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most ``most`` of ``n`` rows, those whose id hashes least."""
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    share = min(1.0, 1.2 * most / max(1, n))
    got = rows.filter(h <= int(share * (1 << 40))).orderBy(h, "id").limit(most).select("id", "v").toArrow()
    ids = got["id"].to_numpy()
    return ids, _matrix(got["v"].combine_chunks(), len(ids))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def _exact(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query, id, leaf, score): the true neighbours of a bounded number of queries."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, leaf, v = np.asarray(batch["id"]), np.asarray(batch["leaf"]), _matrix(batch["v"], batch.num_rows)
            near = queries @ v.T
            near[ids[:, None] == own[None, :]] = -np.inf
            q, at, score = best(near, queries, v, own, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[q]), pa.array(own[at]), pa.array(leaf[at]), pa.array(score)], ["query", "id", "leaf", "score"]
            )

    found = rows.select("id", "v", "leaf").mapInArrow(each, "query long, id long, leaf int, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)


def calibrate(tree: Tree, truth: pd.DataFrame, ids: np.ndarray, queries: np.ndarray, target: float) -> int:
    """The least number of leaves whose visit finds ``target`` of the true neighbours."""
    if not len(truth):
        return 1
    needed = []
    leaves = truth.groupby("query")["leaf"].agg(list).to_dict()
    for i, far in zip(ids.tolist(), tree.far(queries), strict=True):
        turn = {leaf: n + 1 for n, leaf in enumerate(tree.visits(far))}
        needed += [turn[leaf] for leaf in leaves.get(i, [])]
    return int(np.quantile(needed, target, method="higher"))


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    target: float = TARGET,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` (a condition on ``id``)
    names, the ``k`` rows of other ids with the largest inner product that a search finds,
    nearest first, ties to smaller ids; fewer if there are fewer.

    See ``usable`` for rows that take no part. Repeated rows of one id are candidates one by one;
    as queries, rows of one id are one (the one whose vector sorts first). No rows give no rows.

    The tree is fitted on a bounded sample; every vector is put into a leaf of it. The number of
    leaves that a query visits is the least that finds ``target`` of the true neighbours of a
    bounded sample of the queries, and more if these hold few vectors. Leaves are packed into
    shards of bounded size, a leaf larger than that is several; queries meet a shard in blocks of
    bounded size, once for all leaves that they visit in it.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vec_col), "ann-vectors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    n, longest = rows.agg(F.count("*"), F.max(length)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    tree = grow(_chosen(rows, n, MAX_FIT)[1], longest)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(_matrix(batch["v"], batch.num_rows)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(leaf)], ["id", "v", "leaf"])

    placed = materialize(rows.mapInArrow(put, "id long, v array<double>, leaf int"), "ann-placed")
    asked = placed.filter(queries).groupBy("id").agg(F.min("v").alias("v"))
    asked = materialize(asked, "ann-queries")
    many = asked.count()
    ids, some = _chosen(asked, many, MAX_CALIBRATE)
    truth = _exact(placed, ids, some, k).toPandas() if len(ids) else pd.DataFrame()
    wide = calibrate(tree, truth, ids, some, target)
    held = np.zeros(tree.leaves, np.int64)  # as many numbers as leaves, bounded by the sample
    for leaf, count in placed.groupBy("leaf").count().collect():
        held[leaf] = count
    shard, parts = _shards(held)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            vectors = _matrix(batch["v"], batch.num_rows)
            for i, q, far in zip(batch["id"].to_pylist(), vectors, tree.far(vectors), strict=True):
                to: dict[int, list[int]] = {}
                seen = 0
                for turn, leaf in enumerate(tree.visits(far)):
                    if turn >= wide and seen >= 4 * k:
                        break
                    seen += held[leaf]
                    if held[leaf]:
                        to.setdefault(int(shard[leaf]), []).append(leaf)
                out += [(i, q, s, part, leaves) for s, leaves in to.items() for part in range(parts.get(s, 1))]
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(out, columns=["query", "v", "shard", "part", "leaves"]), schema=routed, preserve_index=False
            )

    routed = pa.schema(
        [("query", pa.int64()), ("v", pa.list_(pa.float64())), ("shard", pa.int32()), ("part", pa.int32()), ("leaves", pa.list_(pa.int32()))]
    )
    spread = asked.repartition(min(MOST_TASKS, -(-many // ROUTE_ROWS)) or 1, "id")
    sent = spread.mapInArrow(route, "query long, v array<double>, shard int, part int, leaves array<int>")
    sent = materialize(sent, "ann-visits")
    blocks = sent.groupBy("shard", "part").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    blocks = materialize(blocks, "ann-blocks")
    tasks = min(MOST_TASKS, blocks.agg(F.sum("blocks")).first()[0] or 1)
    blocks = F.broadcast(blocks)  # a row for each part of a shard at most

    packing = pd.DataFrame({"leaf": range(len(shard)), "shard": shard, "parts": [parts.get(int(x), 1) for x in shard]})
    packing = spark.createDataFrame(packing, "leaf int, shard int, parts int")
    there = placed.join(F.broadcast(packing), "leaf")  # a row for each leaf
    there = there.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).join(blocks, ["shard", "part"])
    there = there.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    here = sent.join(blocks, ["shard", "part"]).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "query"), "blocks").cast("int"))
    keys = ["shard", "part", "block"]

    def meet(there: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        return _search(there, here, k)

    there = there.select(*keys, "id", "v", "leaf").repartition(tasks, *keys)
    here = here.select(*keys, "query", "v", "leaves").repartition(tasks, *keys)
    found = there.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _shards(held: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
    """The shard of each leaf, and the parts of shards of one large leaf each."""
    large = held > SHARD_ROWS
    small = np.where(large, 0, held)
    shard = (small.cumsum() - small) // SHARD_ROWS
    after = int(shard.max(initial=0)) + 1
    parts = {}
    for leaf in np.nonzero(large)[0].tolist():
        shard[leaf] = after
        parts[after] = int(-(-held[leaf] // SHARD_ROWS))
        after += 1
    return shard, parts


def _search(there: pd.DataFrame, here: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best rows of a shard for each query, among the leaves that the query visits: one
    matrix product for each leaf and the queries that visit it."""
    out: list[pd.DataFrame] = []
    if len(there) and len(here):
        there = there.sort_values("leaf", kind="stable")
        ids, leaf = there["id"].to_numpy(), there["leaf"].to_numpy()
        v = np.stack(there["v"].to_numpy())
        for lo in range(0, len(here), 256):
            some = here.iloc[lo : lo + 256]
            names, q = some["query"].to_numpy(), np.stack(some["v"].to_numpy())
            near = np.full((len(some), len(ids)), -np.inf)
            asking = np.repeat(np.arange(len(some)), some["leaves"].map(len))
            visited = np.concatenate(some["leaves"].to_numpy())
            order = np.argsort(visited, kind="stable")
            asking, visited = asking[order], visited[order]
            for x in np.unique(visited):
                (a, b), (c, d) = np.searchsorted(leaf, [x, x + 1]), np.searchsorted(visited, [x, x + 1])
                near[asking[c:d], a:b] = q[asking[c:d]] @ v[a:b].T
            near[names[:, None] == ids[None, :]] = -np.inf
            row, at, score = best(near, q, v, ids, k)
            out.append(pd.DataFrame({"query_id": names[row], "vec_id": ids[at], "score": score}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
