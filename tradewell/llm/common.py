"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tradewell.sources.io import materialize

WHITE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of fixed-width numbers that may be sent to every executor: 16 bytes each, 32 MB in all.
SMALL_ROWS = 2_000_000


def small(written: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table of one or two numbers a row, marked to be broadcast if it is small.

    Its rows are counted (from the files' footers); of a table of lists ``rows`` is the number of
    their elements. Beyond the bound the join shuffles.
    """
    rows = written.count() if rows is None else rows
    return F.broadcast(written) if rows <= SMALL_ROWS else written


def map_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    work: Callable[[], Callable[[list[str]], list[list]]],
    schema: str,
) -> DataFrame:
    """``doc_id`` as it is, and the columns of ``schema`` that a function makes from the texts.

    ``work`` is called once in each task and returns the function, which gets a list of texts
    (null as empty) and returns a list for each column. No other column is read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.limit(0).select(F.lit(None).cast(f"struct<{schema}>").alias("s")).schema["s"].dataType
    kinds = to_arrow_schema(out)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = work()
        for batch in batches:
            made = of([t or "" for t in batch.column(1).to_pylist()])
            columns = [pa.array(c, type=f.type) for c, f in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *kinds.names])

    return rows.mapInArrow(each, f"doc_id {kind}, {schema}")


def components(edges: DataFrame, a: str, b: str, stem: str) -> DataFrame:
    """(node, root) of every node of an undirected graph; ``root`` is the least node of its
    component, the node itself included.

    Large-star and small-star rounds turn every component into a star at its least node in a
    number of rounds that grows with the logarithm of its size. A round is joins and grouped
    minima, so no component is gathered anywhere, and its result is written to the shared folder.
    Self-loops and repeated edges are allowed; no edges give no rows.
    """
    kind = edges.schema[a].dataType
    pairs = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
    pairs = materialize(pairs.filter("v > u").distinct(), stem)
    state = _digest(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select("v", F.col("m").alias("u"))
        large = large.distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").filter("u <> m").select(F.col("u").alias("v"), "m")
        small = small.unionByName(least).select("v", F.col("m").alias("u")).distinct()
        pairs = materialize(small, stem)
        now = _digest(pairs)
        if now == state:
            break
        state = now
    roots = pairs.select(F.col("u").alias("node")).distinct()
    stars = pairs.select(F.col("v").alias("node"), F.col("u").alias("root"))
    found = stars.unionByName(roots.select("node", F.col("node").alias("root")))
    return found.select(F.col("node").cast(kind), F.col("root").cast(kind))


def _digest(pairs: DataFrame) -> tuple:
    """Count and order-free checksum of the edges."""
    h = F.xxhash64("v", "u")
    row = pairs.agg(
        F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 32)), F.sum(F.hash("u", "v"))
    ).first()
    return tuple(row)


def block_runs(members: DataFrame, key: str, member: str, chunk: int) -> DataFrame:
    """Members of every key that has two or more, dealt into blocks of bounded size.

    Adds ``part_i`` and ``part_j``. A key with at most ``chunk`` members is one block. A larger
    one is cut by hash into chunks, and every pair of chunks is a block, so that each two members
    of a key meet in a block of at most about twice ``chunk`` rows, whatever the key holds.
    """
    counts = members.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1")
    rows = members.join(counts, key)
    parts = F.ceil(F.col("_n") / F.lit(chunk)).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(17), F.col(member)), F.col("_parts")).cast("int")
    rows = rows.withColumn("_parts", parts).withColumn("_mine", mine)
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return rows.select(
        *members.columns,
        F.least("_mine", "_other").alias("part_i"),
        F.greatest("_mine", "_other").alias("part_j"),
    )


def runs_of(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Cut a stream of batches sorted by ``keys`` into one frame for each key."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = (batch[list(keys)] != batch[list(keys)].shift()).any(axis=1).to_numpy().nonzero()[0]
        cuts = [int(c) for c in change if c]
        first = batch.iloc[: cuts[0]] if cuts else batch
        if rest and (rest[-1][list(keys)].iloc[-1] == batch[list(keys)].iloc[0]).all():
            rest.append(first)
        else:
            if rest:
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = [first]
        for lo, hi in zip(cuts, [*cuts[1:], len(batch)], strict=True):
            yield pd.concat(rest) if len(rest) > 1 else rest[0]
            rest = [batch.iloc[lo:hi]]
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def on_blocks(
    members: DataFrame,
    key: str,
    member: str,
    chunk: int,
    work: Callable[[pd.DataFrame], pd.DataFrame | None],
    schema: str,
) -> DataFrame:
    """Run ``work`` on every block of ``block_runs``; a task holds one block at a time."""
    keys = [key, "part_i", "part_j"]
    dealt = block_runs(members, key, member, chunk).repartition(*keys).sortWithinPartitions(*keys)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in runs_of(batches, keys):
            if len(run) > 1 and (out := work(run)) is not None and len(out):
                yield out

    return dealt.mapInPandas(each, schema)


class Forest:
    """Union-find over the positions of one block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """True if the two were apart."""
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def packed(docs: DataFrame, name: str = "_row") -> Column:
    """All columns of ``docs`` as one struct, so that added columns clash with none."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)
