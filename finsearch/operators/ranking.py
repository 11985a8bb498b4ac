"""Top-k per key, size-checked broadcasts and late joins of payload columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_BYTES = 64 << 20


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first k rows of every key.

    The filter on the row number lets Spark cut each partition to k rows per key before
    the shuffle, so a key that holds most rows still sends k rows per task.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    numbered = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
    return numbered.withColumn(rank, F.col(rank).cast("long"))


def _row_bytes(kind: T.DataType) -> int:
    """What a value takes in memory: its size if that is fixed, a guess for texts and arrays otherwise."""
    if isinstance(kind, T.StructType):
        return 16 + sum(_row_bytes(f.dataType) for f in kind.fields)
    return {T.StringType: 256, T.ArrayType: 16_384, T.BinaryType: 16_384, T.MapType: 16_384}.get(type(kind), 16)


def small_side(df: DataFrame, max_rows: int, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast a side whose number of rows is known and whose rows take ``limit`` bytes at most; Spark decides on others."""
    return F.broadcast(df) if max_rows * _row_bytes(df.schema) <= limit else df


def with_payload(hits: DataFrame, corpus: DataFrame, columns: Sequence[str], max_hits: int) -> DataFrame:
    """Fetch wide columns for a narrow result: the wide table is scanned once, never shuffled."""
    wide = corpus.select("id", *columns)
    return wide.join(small_side(hits, max_hits), "id")
