"""Small helpers of the text operators."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsearch.session import written

_STORE = "_finsearch_llm_worker"


def worker_memo(key, build):
    """``build()`` once per worker process: task code is unpickled per task, this outlives it."""
    memo = sys.__dict__.setdefault(_STORE, {})
    if key not in memo:
        memo[key] = build()
    return memo[key]


def text_of(name: str) -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def in_order(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Rows with ``part`` and ``place``: ordered by (part, place), numbered from 0 in each part.

    A range shuffle, a sort inside the ranges and one written table; no task sees more than its
    range, and the numbers stay as they are when tasks run again.
    """
    number = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", number)
    return written(
        ranged.select(
            "*", F.shiftright("_n", 33).cast("int").alias("part"), F.col("_n").bitwiseAND((1 << 33) - 1).alias("place")
        ).drop("_n"),
        label,
    )


def ranked(df: DataFrame, order: list[Column], label: str) -> tuple[DataFrame, int]:
    """Rows with a dense ``rank`` from 0 in the given order, and their number.

    Only one count per range partition comes to the driver.
    """
    placed = in_order(df, order, label)
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    total, starts = 0, []
    for part, count in counts:
        starts.append((part, total))
        total += count
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "part int, first long")
    rows = placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("first") + F.col("place"))
    return rows.drop("part", "place", "first"), total


BLOCK = 4096


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out a single time, where it is used more than once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks_of(text: Column) -> Column:
    """The text in blocks of equal numbers of code points: a span then costs its own length and not that of the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def span_of(blocks: Column, start: Column, size: Column) -> Column:
    """``size`` code points from ``start`` (from 0) of a text in blocks; what lies beyond the end is missing."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((start + size - 1) / BLOCK).cast("int")
    text = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return text.substr((start % BLOCK + 1).cast("int"), size.cast("int"))


SCAN = 128


def scan(items: Column, state: Column, step, empty: Column) -> Column:
    """``step(state, item)`` over an array, left to right; the arrays that it emits, one after the other.

    ``step`` gives a struct of ``state`` and ``out``, an array; ``empty`` is one without elements. What
    is emitted is gathered in blocks, so that a long array costs little more than its length.
    """

    def block(held: Column, part: Column) -> Column:
        def one(own: Column, item: Column) -> Column:
            return once(step(own["state"], item), lambda r: F.struct(r["state"].alias("state"), F.concat(own["out"], r["out"]).alias("out")))

        run = F.aggregate(part, F.struct(held["state"].alias("state"), empty.alias("out")), one)
        return once(run, lambda r: F.struct(r["state"].alias("state"), F.concat(held["out"], F.array(r["out"])).alias("out")))

    def parts(held: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / SCAN).cast("int"))
        return F.when(F.size(held) > 0, F.transform(starts, lambda i: F.slice(held, i * SCAN + 1, F.lit(SCAN)))).otherwise(F.array(held))

    return F.flatten(F.aggregate(once(items, parts), F.struct(state.alias("state"), F.array(empty).alias("out")), block)["out"])
