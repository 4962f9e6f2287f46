"""JSON arrays in files of any size, read by many tasks.

A file is cut at every ``}``, which the text source does in byte ranges, without knowing whether
a cut lies in a string or how deep it is. Both follow from sums over what stands before it in the
file: the number of quotes says whether a cut lies in a string, and the number of opened less
closed brackets how deep it is. A range adds up its own cuts, the sums of the ranges before it are
added, and the cuts between two returns to the depth of the array are one record.

The text is shuffled once, each range to one task, and records within a range are put together
there. What leaves a range is one row for its quotes, one for each depth at which an object ends in
it, and the pieces of the records that cross its borders.

Compressed files can't be cut: each is one range.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tradewell.sources.io import CORRUPT

# Tasks get these functions with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PLACE = ["_file", "_range"]
#: Files of a task at most.
PARTS_OF_A_TASK = 2**24
#: Names of files whose size says nothing about their text.
COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"


# A run without brackets of the structure, with the strings in it.
_NO_BRACKETS = r'(?:[^"{\[\]]++|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\z))++'


def _count(text: Column, sign: str) -> Column:
    """How many of the sign, of one byte, a text holds."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))


def _starts(read: DataFrame) -> DataFrame:
    """A row for each range: the quotes before it in its file, and the place of the last cut of the
    file if no } ends it. Only the bytes say so; a byte-order mark may be left out. A compressed file
    is taken as one that no } ends: it ends with the array.
    """
    ranges = read.groupBy(*_PLACE).agg(
        F.sum("_quotes").alias("_quotes"),
        F.max("_at").alias("_end"),
        F.sum(F.octet_length("_text") + 1).alias("_bytes"),
        F.max("_size").alias("_size"),
    )
    file = W.partitionBy("_file")
    earlier = file.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = (F.max("_size").over(file) - F.sum("_bytes").over(file)).isin(0, 3) & ~F.col("_file").rlike(COMPRESSED)
    last = F.col("_range") == F.max("_range").over(file)
    return ranges.select(
        *_PLACE,
        F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)).alias("_quotes_before"),
        F.when(last & ~whole, F.col("_end")).alias("_open_end"),
    )


def _marks(cuts: DataFrame) -> DataFrame:
    """A row for each range: its depth at the start, the records closed before it in its file, and how
    many it closes, with the places of the first and the last cut that does.

    How often an object ends at a depth, counted from the start of the range, is known before the
    depth at the start; the ends at the depth of the array are picked when it is.
    """
    depths = cuts.groupBy(*_PLACE, F.when(F.col("_ends"), F.col("_depth")).alias("_level")).agg(
        F.sum("_deeper").alias("_deeper"),
        F.count("*").alias("_ends"),
        F.min("_at").alias("_min"),
        F.max("_at").alias("_max"),
    )
    before = W.partitionBy("_file").orderBy("_range").rangeBetween(W.unboundedPreceding, -1)
    known = depths.withColumn("_start", F.coalesce(F.sum("_deeper").over(before), F.lit(0)))
    at_array = lambda c: F.when(F.col("_start") + F.col("_level") == 1, F.col(c))
    ranges = known.groupBy(*_PLACE).agg(
        F.max("_start").alias("_start"),
        F.coalesce(F.max(at_array("_ends")), F.lit(0)).alias("_closes"),
        F.max(at_array("_min")).alias("_first"),
        F.max(at_array("_max")).alias("_last"),
    )
    return ranges.withColumn("_number", F.coalesce(F.sum("_closes").over(before), F.lit(0)))


def _joined(cuts: DataFrame, keys: list[str], closed: Column) -> DataFrame:
    """``(file, number, text, closed)``: the cuts of each key in one text."""
    whole = F.transform(F.sort_array(F.collect_list(F.struct("_range", "_at", "_text"))), lambda c: c["_text"])
    records = cuts.groupBy(*keys).agg(F.array_join(whole, "}").alias("text"), closed.alias("closed"))
    return records.select(F.col("_file").alias("file"), F.col("_number").alias("number"), "text", "closed")


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, number, text)`` of the objects in files that hold one JSON array of objects each,
    pretty-printed or not. Text after the last whole object, but the end of the array, is a record
    of its own, so that a file cut off in the middle loses only its last object, and says so.
    """
    text = F.col("_text")
    # A backslash stands only in strings, where it takes the next sign with it.
    plain = F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\.", "")).otherwise(text)
    read = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_range"),
        F.monotonically_increasing_id().alias("_at"),  # the order within a range
        F.col("value").alias("_text"),
        F.col("_metadata.file_size").alias("_size"),
    )
    read = read.withColumn("_quotes", _count(plain, '"'))
    # One row for each range, so both tables stay small.
    starts = F.broadcast(_starts(read))
    here = W.partitionBy(*_PLACE).orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    cuts = read.drop("_size").withColumn("_upto", F.sum("_quotes").over(here)).join(starts, _PLACE)
    upto = F.col("_quotes_before") + F.col("_upto")
    opened = F.when((upto - F.col("_quotes")) % 2 == 1, F.concat(F.lit('"'), text)).otherwise(text)
    shut = ~F.col("_at").eqNullSafe(F.col("_open_end"))
    cuts = cuts.select(
        *_PLACE,
        "_at",
        "_text",
        F.regexp_replace(opened, _NO_BRACKETS, "").alias("_bare"),
        (shut & (upto % 2 == 0)).alias("_ends"),  # a } of the structure
    )
    bare = F.col("_bare")
    deeper = _count(bare, "{") + _count(bare, "[") - _count(bare, "]") - F.col("_ends").cast("int")
    cuts = cuts.withColumn("_deeper", deeper).drop("_bare").withColumn("_depth", F.sum("_deeper").over(here))
    marks = F.broadcast(_marks(cuts))
    at, first, last = F.col("_at"), F.col("_first"), F.col("_last")
    # Records that lie within a range are put together in its task.
    closes = (F.col("_ends") & (F.col("_start") + F.col("_depth") == 1)).cast("int")
    within = cuts.join(marks, _PLACE).filter((at > first) & (at <= last)).withColumn("_closes", closes)
    number = F.col("_number") + 1 + F.sum("_closes").over(here) - F.col("_closes")
    within = within.select(*_PLACE, "_at", "_text", number.alias("_number"))
    # The others begin or end outside of it: of a range, what stands up to its first or after its last end.
    border = read.join(marks, _PLACE).filter(first.isNull() | (at <= first) | (at > last))
    border = border.withColumn("_number", F.col("_number") + F.when(at > last, F.col("_closes")).otherwise(0))
    records = _joined(within, [*_PLACE, "_number"], F.lit(True)).union(
        _joined(border, ["_file", "_number"], F.max(at.eqNullSafe(first)))
    )
    # What stands between two objects is before the second.
    text = F.regexp_replace("text", r"^[\s\x{FEFF}]*[\[,]?\s*", "")
    text = F.when(F.col("closed"), F.concat(text, F.lit("}"))).otherwise(F.regexp_replace(text, r"^\]?\s*$", ""))
    return records.select("file", "number", text.alias("text")).filter("text <> ''")


def read_json_array(spark: SparkSession, path: str, schema: StructType, keep_corrupt: bool = False) -> DataFrame:
    """Scan files of one JSON array each as ``read_raw_json`` does, a row for each object; a large
    file is read by many tasks, each a range of its bytes.

    An object that can't be parsed is a row of NULLs; ``keep_corrupt`` keeps its text for
    quarantine (see ``split_corrupt``). Empty files and empty arrays give no rows.
    """
    fields = StructType([*schema.fields, StructField(CORRUPT, StringType())]) if keep_corrupt else schema
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    # A generator's row is made once; a column of a projection, again for each field used after it.
    return array_records(spark, path).select(F.inline(F.array(F.from_json("text", fields, options))))


def _as_arrays(most: int | None):
    """Lines of arrays, in order: ``(part, _at, value)`` of rows ``(_json, part)``, another part when one
    holds ``most`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, size, opened, last = 0, 0, 0, False, None

        def lines(values: pa.Array) -> pa.RecordBatch:
            nonlocal at
            at += len(values)
            part = pa.array([last * PARTS_OF_A_TASK + number] * len(values), pa.int64())
            return pa.RecordBatch.from_arrays([part, pa.array(range(at - len(values), at), pa.int64()), values], ["part", "_at", "value"])

        for batch in batches:
            while batch.num_rows:
                last = batch["part"][0].as_py()
                sizes = np.cumsum(pc.binary_length(batch["_json"]).to_numpy()) + size
                n = batch.num_rows if most is None else min(batch.num_rows, int(np.searchsorted(sizes, most)) + 1)
                json = batch["_json"].slice(0, n)
                before = pa.array(["[\n  "] * (not opened) + [",\n  "] * (n - (not opened)))
                yield lines(pc.binary_join_element_wise(before, json, ""))
                batch, size, opened = batch.slice(n), int(sizes[n - 1]), True
                if most is not None and size >= most:
                    yield lines(pa.array(["]"]))
                    number, size, opened = number + 1, 0, False
        if opened:
            yield lines(pa.array(["]"]))

    return run


def write_json_arrays(df: DataFrame, path: str, compression: str | None = None, most: int | None = None) -> None:
    """Write a file for each partition, in a folder of its own: a JSON array of the rows in it. ``most``
    bounds the bytes of a file before they are compressed, but for its last row; a partition is several
    files then. No row leaves its partition."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("_json"), F.spark_partition_id().cast("bigint").alias("part"))
    lines = rows.mapInArrow(_as_arrays(most), "part bigint, _at bigint, value string")
    lines = lines.sortWithinPartitions("part", "_at").select("part", "value")
    lines.write.partitionBy("part").text(path, compression=compression)
