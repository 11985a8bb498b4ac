"""Load share of a primary and its read pool from a table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F


def load_counts(requests: DataFrame | GroupedData) -> DataFrame:
    """Counts of reads, writes, forwarded and disqualified reads.

    ``kind`` is ``read``, ``forwarded`` (a read served by the pool), ``write`` or ``disqualified``.
    """

    def n(*kinds: str):
        return F.count(F.when(F.col("kind").isin(*kinds), 1))

    return requests.agg(
        n("read", "forwarded").alias("n_reads"),
        n("write").alias("n_writes"),
        n("forwarded").alias("n_forwarded"),
        n("disqualified").alias("n_disqualified"),
    )


def load_percentages(counts: DataFrame) -> DataFrame:
    """Share of the primary and of the pool; forwarded reads are capped at the reads, 5 and 0 without load."""
    forwarded = F.least("n_reads", "n_forwarded")
    primary = F.col("n_writes") + F.col("n_reads") - forwarded
    total = primary + forwarded
    return counts.withColumn(
        "primary_load", F.when(total > 0, F.round(primary * 100.0 / total, 6)).otherwise(F.lit(5.0))
    ).withColumn("pool_load", F.when(total > 0, F.round(forwarded * 100.0 / total, 6)).otherwise(F.lit(0.0)))
