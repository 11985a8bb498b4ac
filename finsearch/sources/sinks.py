"""Writing tables: clustered builds, hot subsets, appended trades, deletions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsearch.schemas import TRADES
from finsearch.session import scratch, written
from finsearch.sources.snapshots import claim_part, complete_parts


def build_clustered(
    df: DataFrame, path: str, cluster_cols: Sequence[str], partition_cols: Sequence[str] = ()
) -> DataFrame:
    """Write ``df`` partitioned and clustered, and return a reader on the result.

    Rows are ranged over partition columns, cluster columns and a hash of the whole row, so
    neither a partition value nor a cluster key that holds most rows ends up in one task;
    sorting inside each file gives tight row-group statistics on the cluster columns.
    """
    order = [*partition_cols, *cluster_cols]
    ranged = df.repartitionByRange(*order, F.xxhash64(*[F.col(c) for c in df.columns]))
    writer = ranged.sortWithinPartitions(*order).write.mode("errorifexists")
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path).select(df.columns)


def hot_subset(df: DataFrame, predicate: Column, key: str, path: str, partition_cols: Sequence[str] = ("fy", "fp")) -> DataFrame:
    """Materialize the rows that hot lookups need, clustered by their key."""
    return build_clustered(df.where(predicate), path, [key], partition_cols)


def checked_trades(df: DataFrame, now: datetime) -> DataFrame:
    """Cast trades to the table's types; a ticker or price that does not fit fails the write."""
    fits = F.length("ticker") <= 10
    price = F.col("price").try_cast("decimal(10,2)") if hasattr(Column, "try_cast") else F.col("price").cast("decimal(10,2)")
    executed = F.col("executed_at") if "executed_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    return df.select(
        F.when(fits | F.col("ticker").isNull(), F.col("ticker"))
        .otherwise(F.raise_error(F.concat(F.lit("ticker longer than 10: "), F.col("ticker"))))
        .alias("ticker"),
        F.col("shares").cast("int").alias("shares"),
        F.when(price.isNotNull() | F.col("price").isNull(), price)
        .otherwise(F.raise_error(F.concat(F.lit("price out of range: "), F.col("price").cast("string"))).cast("decimal(10,2)"))
        .alias("price"),
        F.coalesce(executed.cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz")).alias("executed_at"),
    )


MAX_TRADES_PER_PART = 1 << 32


def numbered_trades(df: DataFrame, part: int, now: datetime) -> DataFrame:
    """Checked trades with ids ``part * 2**32 + position``; a part holds up to 2**32 trades.

    Positions are dense: the rows are written once, then counted per partition, so they are the same when
    a task runs again, and 2**31 parts have room.
    """
    rows = written(checked_trades(df, now).withColumn("_at", F.monotonically_increasing_id()), "trades")
    rows = rows.withColumn("_task", F.shiftright("_at", 33).cast("int"))
    counts = rows.groupBy("_task").count().collect()  # a number per task
    starts, total = [], 0
    for task, n in sorted((r["_task"], r["count"]) for r in counts):
        starts.append((task, total))
        total += n
    if total > MAX_TRADES_PER_PART:
        raise ValueError(f"{total} trades in one append")
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts or [(0, 0)], "_task int, _start long"))
    place = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.join(offsets, "_task").withColumn("trade_id", F.lit(part).cast("long") * MAX_TRADES_PER_PART + place).select(TRADES.names)


def read_trades(spark: SparkSession, path: str, key: str = "append") -> DataFrame:
    """All trades of complete parts."""
    parts = complete_parts(spark, path, key)
    return spark.read.schema(TRADES).parquet(*parts) if parts else spark.createDataFrame([], TRADES)


def append_trades(df: DataFrame, path: str, now: datetime) -> DataFrame:
    """Append trades under generated ids: unique and growing over appends, gaps allowed.

    Every append claims a number and fills a folder of its own, from which its ids follow, so appends may
    run at once. One that failed half way is not read, and its repetition claims another number.
    """
    spark = df.sparkSession
    part = claim_part(spark, path, "append")
    with scratch(spark):
        numbered_trades(df, part, now).write.mode("overwrite").parquet(f"{path}/append={part}")
    return read_trades(spark, path)


def delete_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """All rows whose key is not listed; Spark broadcasts the list when it is small enough."""
    return df.join(keys, on, "left_anti")
