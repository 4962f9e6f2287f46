"""De-duplication, data-quality checks, table profiles and layer status."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewell import fixed_values as fv
from tradewell.config import LayerStep
from tradewell.functions.text import ts_text


def dedupe_latest(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order_by``, ties broken by the row's content.

    Spark limits each key to one row before the shuffle as well as after it, so a key
    that holds a large share of the rows sends one row per input partition.
    """
    content = F.xxhash64(*[F.col(c) for c in df.columns])
    newest_first = W.partitionBy(*keys).orderBy(*order_by, content)
    return (
        df.withColumn("_n", F.row_number().over(newest_first)).filter("_n = 1").drop("_n")
    )


def _check(table: str, check: str, column: str, observed: Column, expected: Column, ok: Column):
    return [
        F.lit(table).alias("table_name"),
        F.lit(check).alias("check_name"),
        F.lit(column).alias("column_name"),
        observed.cast("bigint").alias("observed"),
        expected.cast("bigint").alias("expected"),
        ok.alias("passed"),
    ]


def validate_no_duplicates(df: DataFrame, key_columns: Sequence[str], table: str) -> DataFrame:
    """Rows beyond one per key; NULL keys compare equal."""
    per_key = df.groupBy(*key_columns).agg(F.count("*").alias("n"))
    extra = F.coalesce(F.col("total") - F.col("keys"), F.lit(0))
    return per_key.agg(F.sum("n").alias("total"), F.count("*").alias("keys")).select(
        *_check(table, "duplicates", ",".join(key_columns), extra, F.lit(0), extra == 0)
    )


def validate_no_nulls(df: DataFrame, columns: Sequence[str], table: str) -> DataFrame:
    """NULLs per mandatory column, all columns counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot([], list(columns), "column_name", "observed")
    return long.select(
        F.lit(table).alias("table_name"),
        F.lit("nulls").alias("check_name"),
        "column_name",
        "observed",
        F.lit(0).cast("bigint").alias("expected"),
        (F.col("observed") == 0).alias("passed"),
    )


def validate_record_count(df: DataFrame, table: str, expected_min: int = 1) -> DataFrame:
    n = F.col("n")
    return df.agg(F.count("*").alias("n")).select(
        *_check(table, "min_records", "*", n, F.lit(expected_min), n >= expected_min)
    )


def check_types(df: DataFrame, expected: Mapping[str, str], table: str) -> DataFrame:
    """Declared against actual column types, with the rows that carry a value."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    present = [c for c in expected if c in actual]
    counts = df.agg(
        *[
            F.struct(
                F.lit(actual[c]).alias("actual_type"),
                F.lit(expected[c]).alias("expected_type"),
                F.count(c).alias("filled"),
            ).alias(c)
            for c in present
        ],
        *[
            F.struct(
                F.lit("missing").alias("actual_type"),
                F.lit(expected[c]).alias("expected_type"),
                F.lit(0).cast("bigint").alias("filled"),
            ).alias(c)
            for c in expected
            if c not in actual
        ],
    )
    return counts.unpivot([], list(expected), "column_name", "c").select(
        F.lit(table).alias("table_name"),
        "column_name",
        "c.actual_type",
        "c.expected_type",
        "c.filled",
        (F.col("c.actual_type") == F.col("c.expected_type")).alias("passed"),
    )


def table_profile(df: DataFrame, table: str) -> DataFrame:
    """One row per column: position, type, filled rows, rows and columns of the table."""
    fields = df.schema.fields
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.count(f.name).alias("filled"),
            ).alias(f.name)
            for i, f in enumerate(fields)
        ],
    )
    return counts.unpivot(["_rows"], [f.name for f in fields], "column_name", "c").select(
        F.lit(table).alias("table_name"),
        "column_name",
        "c.position",
        "c.type",
        "c.filled",
        F.col("_rows").alias("records"),
        F.lit(len(fields)).alias("columns"),
    )


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def standardize_column_names(df: DataFrame) -> DataFrame:
    """Lower-case ``a-z0-9_`` names; two columns that end up alike are an error."""
    names = []
    for name in df.columns:
        spaced = name[:1] + re.sub("[A-Z]", lambda capital: f"_{capital[0]}", name[1:])
        names.append(re.sub("[^a-z0-9]+", "_", spaced.lower()).strip("_"))
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"columns with the same standard name: {clash}")
    return df.toDF(*names)


_TIMESTAMPS = ("_processed_timestamp", "_ingestion_timestamp", "_created_timestamp")


def _table_state(spark: SparkSession, name: str) -> tuple[int, object, bool]:
    """(records, latest load, broken) of one table; one that can't be found or read is broken."""
    try:
        df = spark.table(name)
        stamp = next((c for c in _TIMESTAMPS if c in df.columns), None)
        last = ts_text(F.max(stamp)) if stamp else F.lit(None).cast("string")
        records, when = df.agg(F.count("*"), last).first()
        return records, when, False
    except (PySparkException, Py4JJavaError):
        return 0, None, True


def layer_status(
    spark: SparkSession, steps: Sequence[LayerStep], index_ready: bool = False
) -> DataFrame:
    """Per step: status, records (NULL when none) and latest load time.

    A step without tables stands for the search index. Each table is counted by a job of its
    own, so one that can't be found or read makes its step an error and the others still count.
    One row of counts per table comes back.
    """
    rows = []
    for position, step in enumerate(steps):
        states = [_table_state(spark, name) for name in step.tables]
        records = sum(n for n, _, _ in states)
        last = max((when for _, when, _ in states if when), default=fv.NOT_RUN)
        if not step.tables:
            status = "success" if index_ready else "warning"
            last = "Endpoint ativo" if index_ready else "Endpoint não verificado"
        else:
            status = "error" if any(broken for _, _, broken in states) else "success"
        rows.append((position, step.name, step.description, status, records or None, last))
    return spark.createDataFrame(
        rows, "position int, name string, description string, status string, records bigint, last_run string"
    )
