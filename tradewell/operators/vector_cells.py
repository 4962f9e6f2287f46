"""Exact nearest vectors that skip far cells, with pivots of pivots.

Every document belongs to the cell of its nearest pivot, a handful of documents picked
by the hash of their id; a cell with too many documents is split in the same way by pivots
of its own, level by level. On unit vectors cosine falls as distance grows, so the triangle
inequality bounds it: with the distances of the k documents next to each pivot a
question knows a distance that k documents do not exceed, and a cell whose pivot is
farther than that plus the radius of the cell holds none of its k best, nor does any cell
inside it. Cells that remain are scored block against block, so a cell with a third of all
documents is many blocks. Where vectors have no clusters every cell is visited and the result
is the same as that of ``retrieval.vector_topk``, which is then the cheaper choice.

The cells of a level are a table, and below the first level documents and questions meet the
pivots of their cell in groups of bounded size. Only the first level, at most ``N_CELLS`` pivots
whatever the table, comes to the driver and goes out with the tasks.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewell import fixed_values as fv
from tradewell.operators.block_topk import (
    DOCS_PER_BLOCK,
    QUESTIONS_PER_BLOCK,
    best_of_blocks,
    block_count,
    cosine_scorer,
    unit_rows,
)
from tradewell.sources.io import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pivots that split a cell, documents beyond which a cell is split, and documents that meet the
#: pivots of their cell in one group.
N_CELLS, ROWS_PER_CELL, PLACED_ROWS = 64, 65_536, 16_384
_ROWS = 1024
# Squared distance that a difference in the last rounded digit of a score can hide.
_SLACK = 4e-6
# Documents of a cell with a smaller radius are copies of each other, which no pivot tells apart.
_COPIES = 1e-6


@dataclass(frozen=True)
class Cells:
    """``docs`` (doc_id, vec, cell), each in its last cell, and for every level a table of its cells.

    A level has (parent, cell, pivot, n, radius, nearest, leaf): ``n`` documents at most ``radius``
    from the pivot, the distances of the k + 1 ``nearest`` of them, infinite where there are fewer,
    and whether the cell is not split further. Cell 0 is the whole table, the parent of the first
    level.
    """

    docs: DataFrame
    levels: list[DataFrame]


@dataclass(frozen=True)
class Pivots:
    """The cells of one parent as arrays."""

    cells: np.ndarray
    pivots: np.ndarray
    radius: np.ndarray
    nearest: np.ndarray

    def reach(self, unit: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Least distance of each vector to the documents of each cell, and a distance that
        ``wanted`` documents do not exceed."""
        d = np.sqrt(np.maximum(2 - 2 * unit @ self.pivots.T, 0))
        # Cells hold k + 1 distances each, so there are as many as are wanted.
        within = (d[:, :, None] + self.nearest).reshape(len(d), -1)
        return np.maximum(d - self.radius, 0), np.partition(within, wanted - 1, axis=1)[:, wanted - 1]


def _units(vectors: pa.ChunkedArray) -> np.ndarray:
    rows = vectors.combine_chunks()
    return unit_rows(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))


def _pivots_of(nodes: pa.Table) -> Pivots:
    """The cells of a table of one parent, by their number."""
    nodes = nodes.sort_by("cell")
    matrix = lambda c: nodes[c].combine_chunks().flatten().to_numpy().reshape(nodes.num_rows, -1)
    return Pivots(nodes["cell"].to_numpy(), matrix("pivot"), nodes["radius"].to_numpy(), matrix("nearest"))


def _nearest_pivot(unit: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and distance of each vector's nearest pivot, the first of equal ones."""
    d = np.sqrt(np.maximum(2 - 2 * unit @ pivots.T, 0))
    at = d.argmin(axis=1)
    return at, d[np.arange(len(d)), at]


def _pick(rows: DataFrame, n_cells: int) -> DataFrame:
    """(parent, cell, pivot) of ``n_cells`` documents of every cell, those whose id hashes least."""
    by_hash = W.partitionBy("cell").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = rows.withColumn("i", F.row_number().over(by_hash)).filter(F.col("i") <= n_cells)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit = F.transform("vec", lambda v: v.cast("double") / F.col("length"))
    return picked.withColumn("length", length).select(
        F.col("cell").alias("parent"), (F.col("cell") * n_cells + F.col("i")).alias("cell"), unit.alias("pivot")
    )


def _describe(placed: DataFrame, pivots: DataFrame, k: int, rows_per_cell: int, last: bool) -> DataFrame:
    """The cells that hold documents, with their size, radius and nearest distances."""
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"))
    near = W.partitionBy("cell").orderBy("dist")
    ranked = placed.select("cell", "dist", F.row_number().over(near).alias("r")).filter(F.col("r") <= k + 1)
    nearest = ranked.groupBy("cell").agg(F.collect_list("dist").alias("d"))
    filled = F.concat("d", F.array_repeat(F.lit(float("inf")), k + 1 - F.size("d")))
    split = (F.col("n") > rows_per_cell) & (F.col("radius") > _COPIES)
    found = pivots.join(sizes, "cell").join(nearest, "cell")
    return found.select(
        "parent", "cell", "pivot", "n", "radius", filled.alias("nearest"), (F.lit(last) | ~split).alias("leaf")
    )


def _place_first(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Documents with the nearest of the first pivots, which go with the tasks: no shuffle."""
    first = pivots.orderBy("cell").collect()
    cells = np.array([r.cell for r in first], np.int64)
    units = np.array([r.pivot for r in first])

    @F.pandas_udf("cell long, dist double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        at, dist = _nearest_pivot(unit_rows(np.stack(vectors.to_numpy())), units)
        return pd.DataFrame({"cell": cells[at], "dist": dist})

    return rows.select("doc_id", "vec", nearest("vec").alias("at")).select("doc_id", "vec", "at.cell", "at.dist")


def _place(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Documents (doc_id, vec, cell, n) with the nearest pivot of their cell, in groups of bounded
    size: a cell is dealt by hash into as many as its ``n`` documents ask for."""
    parts = F.ceil(F.col("n") / F.lit(PLACED_ROWS)).cast("int")
    left = rows.select("doc_id", "vec", "cell", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"))
    right = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")

    def nearest(docs: pa.Table, near: pa.Table) -> pa.Table:
        near = near.sort_by("cell")
        units = near["pivot"].combine_chunks().flatten().to_numpy().reshape(near.num_rows, -1)
        at, dist = _nearest_pivot(_units(docs["vec"]), units) if docs.num_rows else (np.empty(0, int), np.empty(0))
        cells = pa.array(near["cell"].to_numpy()[at], pa.int64())
        return pa.table({"doc_id": docs["doc_id"], "vec": docs["vec"], "cell": cells, "dist": pa.array(dist)})

    kind = dict(rows.dtypes)
    return (
        left.groupBy("cell", "part")
        .cogroup(right.groupBy("parent", "part"))
        .applyInArrow(nearest, f"doc_id {kind['doc_id']}, vec {kind['vec']}, cell long, dist double")
    )


def build_cells(docs: DataFrame, k: int, n_cells: int | None = None, rows_per_cell: int | None = None) -> Cells:
    """Deal ``(doc_id, vec)`` to cells of at most about ``rows_per_cell`` documents.

    A cell with more is split by ``n_cells`` pivots, on as many levels as that many documents need
    if they split evenly; what is larger after the last level stays one cell, which is scored in
    blocks. A level is written once. Vectors of zeros are in no cell; an empty table has none.
    """
    n_cells, rows_per_cell = n_cells or N_CELLS, rows_per_cell or ROWS_PER_CELL
    rows = docs.filter(F.exists("vec", lambda v: v != 0)).select("doc_id", "vec")
    rows = rows.withColumn("cell", F.lit(0).cast("long"))
    count, depth = rows.count(), 1
    while n_cells > 1 and n_cells**depth * rows_per_cell < count:
        depth += 1
    if not count:
        return Cells(materialize(rows, "vector_cells"), [])
    done, levels = [], []
    for level in range(depth):
        pivots = materialize(_pick(rows, n_cells), "vector_pivots")
        if level:
            placed = _place(rows, pivots.join(open_cells.withColumnRenamed("cell", "parent"), "parent"))
        else:
            placed = _place_first(rows, pivots)
        placed = materialize(placed, "vector_cells")
        last = level == depth - 1
        nodes = materialize(_describe(placed, pivots, k, rows_per_cell, last), "vector_nodes")
        levels.append(nodes)
        open_cells = nodes.filter("not leaf").select("cell", "n")
        if last or open_cells.isEmpty():
            done.append(placed.select("doc_id", "vec", "cell"))
            break
        done.append(placed.join(open_cells, "cell", "left_anti").select("doc_id", "vec", "cell"))
        rows = placed.join(open_cells, "cell").select("doc_id", "vec", "cell", "n")
    return Cells(functools.reduce(DataFrame.unionByName, done), levels)


def _reach_first(questions: DataFrame, nodes: DataFrame, wanted: int) -> DataFrame:
    """Cells of the first level that can hold one of the best documents of each question."""
    first = _pivots_of(nodes.drop("parent", "n", "leaf").toArrow())

    @F.arrow_udf("array<struct<cell:long,low:double,reach:double>>")
    def reachable(vectors: pa.Array) -> pa.Array:
        counts, columns = [np.zeros(1, np.int64)], [[np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)]]
        for start in range(0, len(vectors), _ROWS):
            low, limit = first.reach(_units(pa.chunked_array([vectors.slice(start, _ROWS)])), wanted)
            near = low**2 <= limit[:, None] ** 2 + _SLACK
            q, c = np.nonzero(near)
            counts.append(near.sum(axis=1))
            for column, values in zip(columns, (first.cells[c], low[q, c], limit[q]), strict=True):
                column.append(values)
        ends = np.concatenate(counts).cumsum().astype(np.int32)
        found = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["cell", "low", "reach"])
        return pa.ListArray.from_arrays(pa.array(ends), found)

    return questions.select("question_id", "vec", F.explode(reachable("vec")).alias("at")).select(
        "question_id", "vec", "at.cell", "at.low", "at.reach"
    )


def _reach(asked: DataFrame, nodes: DataFrame, blocks: Column, wanted: int) -> DataFrame:
    """The same one level down: questions (question_id, vec, cell, low, reach) meet the cells inside
    theirs, at most a block of questions in a group."""
    left = asked.withColumn("part", F.pmod(F.xxhash64("question_id"), blocks).cast("int"))
    right = nodes.withColumn("part", F.explode(F.sequence(F.lit(0), blocks - 1)))

    def inside(questions: pa.Table, near: pa.Table) -> pa.Table:
        q, c = np.empty(0, int), np.empty(0, int)
        low, limit, cells = np.empty((0, 0)), np.empty(0), np.empty(0, np.int64)
        if questions.num_rows and near.num_rows:
            at = _pivots_of(near)
            low, limit = at.reach(_units(questions["vec"]), wanted)
            limit = np.minimum(limit, questions["reach"].to_numpy())
            q, c = np.nonzero(low**2 <= limit[:, None] ** 2 + _SLACK)
            cells = at.cells
        take = questions.take(pa.array(q, pa.int64()))
        return pa.table(
            {
                "question_id": take["question_id"],
                "vec": take["vec"],
                "cell": pa.array(cells[c], pa.int64()),
                "low": pa.array(low[q, c]),
                "reach": pa.array(limit[q]),
            }
        )

    kind = dict(asked.dtypes)
    schema = f"question_id {kind['question_id']}, vec {kind['vec']}, cell long, low double, reach double"
    return left.groupBy("cell", "part").cogroup(right.groupBy("parent", "part")).applyInArrow(inside, schema)


def visited(questions: DataFrame, cells: Cells, k: int, skip_same: bool = False) -> DataFrame:
    """``(question_id, vec, cell)`` of the last cells that can hold one of the k best.

    A question goes down into the cells it can't rule out. The distance to which it looks is the
    least that any level and any cell of it proved, so cells kept on a higher level are checked
    again when a lower one brings it down.
    """
    wanted = k + 1 if skip_same else k
    nonzero = questions.filter(F.exists("vec", lambda v: v != 0)).select("question_id", "vec")
    if not cells.levels:
        return nonzero.limit(0).withColumn("cell", F.lit(0).cast("long"))
    found = _reach_first(nonzero, cells.levels[0], wanted)
    blocks = block_count(questions, QUESTIONS_PER_BLOCK)
    for nodes in cells.levels[1:]:
        found = materialize(found, "vector_reach")
        inner = nodes.select(F.col("parent").alias("cell")).distinct()
        below = _reach(found.join(inner, "cell", "left_semi"), nodes, blocks, wanted)
        every = materialize(found.join(inner, "cell", "left_anti").unionByName(below), "vector_reach")
        least = every.groupBy("question_id").agg(F.min("reach").alias("least"))
        # Rows without an id keep the distance of their own.
        found = every.join(least, "question_id", "left").withColumn("reach", F.coalesce("least", "reach"))
        found = found.filter(F.col("low") * F.col("low") <= F.col("reach") * F.col("reach") + _SLACK).drop("least")
    return found.select("question_id", "vec", "cell")


def vector_topk_cells(
    questions: DataFrame,
    docs: DataFrame,
    k: int = fv.TOP_K,
    skip_same: bool = False,
    n_cells: int | None = None,
) -> DataFrame:
    """``(question_id, doc_id, score, rank)`` by cosine of ``vec``, exact."""
    cells = build_cells(docs, k, n_cells)
    leaves = [n.filter("leaf").select("cell", "n") for n in cells.levels]
    leaves = functools.reduce(DataFrame.unionByName, leaves or [cells.docs.groupBy("cell").agg(F.count("*").alias("n"))])
    dealt = leaves.select("cell", F.ceil(F.col("n") / F.lit(DOCS_PER_BLOCK)).cast("int").alias("_blocks"))
    question_blocks = block_count(questions, QUESTIONS_PER_BLOCK)
    left = cells.docs.join(dealt, "cell").withColumn("_n", question_blocks).select(
        "doc_id",
        "vec",
        "cell",
        F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int").alias("_d"),
        F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_q"),
    )
    right = visited(questions, cells, k, skip_same).join(dealt, "cell").withColumn("_n", question_blocks)
    right = right.select(
        "question_id",
        "vec",
        "cell",
        F.pmod(F.xxhash64("question_id"), F.col("_n")).cast("int").alias("_q"),
        F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_d"),
    )
    scorer = cosine_scorer("doc_id", "question_id", skip_same=skip_same)
    return best_of_blocks(left, right, ["cell", "_d", "_q"], scorer, k, "doc_id", "question_id")
