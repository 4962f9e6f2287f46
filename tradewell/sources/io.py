"""Raw JSON scans, named tables, SQL and the spreadsheet export."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tradewell import fixed_values as fv
from tradewell.config import scratch_root
from tradewell.functions.ptbr import decimal_comma, slug

CORRUPT = "_corrupt_record"


def read_raw_json(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    multiline: bool = True,
    keep_corrupt: bool = False,
) -> DataFrame:
    """Scan JSON files. A multi-line file is one task, so split large inputs into many
    files or write them as JSON lines and pass ``multiline=False``.

    Without a schema Spark infers one, which reads the input twice. A file that cannot
    be parsed gives one record of NULLs; ``keep_corrupt`` keeps its text for quarantine.
    """
    reader = spark.read.option("multiline", multiline)
    if schema is not None:
        if keep_corrupt:
            schema = StructType([*schema.fields, StructField(CORRUPT, StringType())])
            reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        reader = reader.schema(schema)
    return reader.json(path)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) rows of a scan made with ``keep_corrupt``."""
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull())


def add_ingestion_metadata(df: DataFrame, source: str | Column) -> DataFrame:
    """Stamp the load time and the source name (a text, or ``_metadata.file_path``)."""
    name = F.lit(source) if isinstance(source, str) else source
    return df.withColumns({"_ingestion_timestamp": F.current_timestamp(), "_source_file": name})


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a scan of fewer files than cores over all cores.

    For texts, where the work per row is large and a file of one row group can't be split. The
    result is the same either way; many files, and files so large that they are read in twice as many
    parts as there are cores, are left as they are, so texts are shuffled only when there is little
    of them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    many = len(scan.inputFiles()) >= cores or scan.rdd.getNumPartitions() >= 2 * cores
    return scan if many else scan.repartition(cores, key)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def write_table(
    df: DataFrame,
    name: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    fmt: str = "parquet",
    path: str | None = None,
) -> DataFrame:
    """Write a named table and return the written table.

    Counting or reading the result therefore reads the files, not the whole lineage
    again. Before a partitioned write the rows are rebalanced by the partition columns:
    few files per value, and a hot value is split over several tasks at run time.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def replace_partitions(df: DataFrame, name: str, partition_by: Sequence[str]) -> None:
    """Overwrite the partitions of a named table that ``df`` has rows of, and no other.

    ``df`` must not read the table itself (see ``materialize``). The new files are put in place
    when all are written. An insert takes the mode from the session only, so it is set there for
    the time of the write.
    """
    spark = df.sparkSession
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    rows = df.hint("rebalance", *partition_by).select(*spark.table(name).columns)
    spark.conf.set(setting, "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(setting, before)
    spark.catalog.refreshTable(name)


def drop_partitions(spark: SparkSession, name: str, partition: str, values: Sequence[Any]) -> None:
    """Drop partitions with their files (of a managed table); one that is not there is no error."""
    for value in values:
        text = str(value).replace("\\", "\\\\").replace("'", "\\'")
        spec = "NULL" if value is None else f"'{text}'"
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({partition} = {spec})")


def at_least_partitions(scan: DataFrame, least: int) -> DataFrame:
    """A scan, dealt out by its rows if it has fewer partitions than that."""
    return scan if scan.rdd.getNumPartitions() >= least else scan.repartition(least)


def materialize(df: DataFrame, stem: str, compression: str | None = None) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it from there.

    For a result that costs much to make and is read several times by what follows. It
    is computed once, later readers prune its columns, and a lost executor costs a read
    of the files, not the lineage.
    """
    path = f"{scratch_root(df.sparkSession)}/{stem}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_sql(
    spark: SparkSession, query: str, args: dict[str, Any] | None = None, **frames: DataFrame
) -> DataFrame:
    """Typed rows of a parameterised statement over named DataFrames (``{name}``)."""
    return spark.sql(query, args=args, **frames)


def _csv_text(x: Column) -> Column:
    """A quoted value: inner quotes doubled, a missing value as the text ``null``."""
    text = F.replace(F.coalesce(x.cast("string"), F.lit("null")), F.lit('"'), F.lit('""'))
    return F.concat(F.lit('"'), text, F.lit('"'))


def csv_lines(series: DataFrame, x: str, y: str) -> DataFrame:
    """The body lines of the spreadsheet export of an ``(x, y)`` series."""
    return series.withColumn(
        "line", F.concat(_csv_text(F.col(x)), F.lit(";"), _csv_text(decimal_comma(F.col(y))))
    )


def export_ptbr_csv(
    series: DataFrame,
    folder: str,
    title: str | None = None,
    x: str = "x",
    y: str = "y",
    x_title: str = "",
    y_title: str = "",
) -> str:
    """Write the ``x;y`` file of one chart that a pt-BR spreadsheet opens, named by the slug of
    its title, and return its path.

    The file starts with the byte-order mark and the unquoted header; values are quoted, with a
    decimal comma. A chart is what a person looks at, so its points are one file; ``series`` may
    be ordered.
    """
    spark = series.sparkSession
    header = f"\ufeff{x_title or fv.CSV_X_HEADER};{y_title or fv.CSV_Y_HEADER}"
    body = csv_lines(series, x, y).select(F.monotonically_increasing_id().alias("_n"), "line")
    top = spark.createDataFrame([(-1, header)], "_n bigint, line string")
    part = f"{folder}/.{uuid.uuid4().hex}"
    top.unionByName(body).coalesce(1).sortWithinPartitions("_n").select("line").write.text(part)
    name = spark.range(1).select(slug(F.lit(title or ""), fv.CSV_FILE_NAME)).first()[0]
    target = f"{folder}/{name}.csv"
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    there = files.Path(part)
    system = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = next(f.getPath() for f in system.listStatus(there) if f.getPath().getName().startswith("part-"))
    system.delete(files.Path(target), False)
    system.rename(written, files.Path(target))
    system.delete(there, True)
    return target
