"""Row-count and key audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit_counts(tables: Mapping[str, DataFrame], expected: Mapping[str, int] | None = None) -> DataFrame:
    """One row per table: counted rows, expected rows and whether they agree."""
    expected = expected or {}
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            "n_rows",
            F.lit(expected.get(name)).cast("long").alias("expected_rows"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).withColumn(
        "ok", F.col("expected_rows").isNull() | (F.col("n_rows") == F.col("expected_rows"))
    )


def audit_unique(df: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Keys that occur more than once (or are null in part), with their number of rows."""
    rows = df if where is None else df.where(where)
    incomplete = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) | incomplete)


def audit_key_summary(name: str, df: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """One row for one declared key: how many key values break it, and in how many rows."""
    return audit_unique(df, keys, where).agg(
        F.lit(name).alias("key_name"),
        F.count("*").alias("n_bad_keys"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("n_bad_rows"),
    )
