"""Structured Streaming forms: scoring, newest rows, load share, trades."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from finsearch.functions.vectors import distances, nearest_places, unit_rows
from finsearch.operators.load import load_counts, load_percentages
from finsearch.plans.fraud import distance_units, mean_columns
from finsearch.session import scratch
from finsearch.sources.sinks import numbered_trades
from finsearch.sources.snapshots import read_snapshot, refresh_snapshot, snapshot_versions


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def score_stream(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Score every batch with ``score`` and store the result.

    Each batch owns one folder and overwrites it, so a repeated batch leaves no duplicates. What the
    scoring writes in between is removed with the batch.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        with scratch(df.sparkSession):
            score(df).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class EarlierNeighbours(StatefulProcessor):
    """State of one part of the history of some clients, and the k nearest earlier rows in it of every arriving row.

    A batch adds one entry of clients, numbers, dates, flags and vectors; what has arrived is neither sent
    nor joined again. ``keep_ms`` lets entries expire so long after their arrival. An arrival's neighbours
    come as lists in one row.
    """

    def __init__(self, k: int, keep_ms: int | None):
        self.k, self.keep_ms = k, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        entry = T.StructType([T.StructField(n, T.BinaryType()) for n in ("clients", "ids", "times", "known", "vectors")])
        self.history = handle.getListState("history", entry, self.keep_ms) if self.keep_ms else handle.getListState("history", entry)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        columns = [new["client"].to_numpy(np.int64), new["id"].to_numpy(np.int64), new["date"].to_numpy("datetime64[us]").astype(np.int64), new["known"].to_numpy(bool)]
        columns.append(np.stack(new["embedding"].to_numpy()).astype(np.float32))
        here = new["here"].to_numpy(bool)
        held = [[c[here] for c in columns]] if here.any() else []
        for entry in self.history.get():
            own = [np.frombuffer(e, t) for e, t in zip(entry, (np.int64, np.int64, np.int64, bool, np.float32))]
            held.append([*own[:4], own[4].reshape(len(own[0]), -1)])
        if here.any():
            self.history.appendValue(tuple(np.ascontiguousarray(c).tobytes() for c in held[0]))
        clients, ids, times, _, vectors = columns
        lists = {name: [[] for _ in ids] for name in ("ids", "distances", "known")}
        if held:
            old_clients, old_ids, old_times, old_known, old = (np.concatenate(c) for c in zip(*held))
            ours, theirs = np.argsort(clients, kind="stable"), np.argsort(old_clients, kind="stable")
            starts = np.flatnonzero(np.diff(clients[ours], prepend=clients[ours[0]] - 1))
            asking = clients[ours[starts]]
            lows, highs = (np.searchsorted(old_clients[theirs], asking, side=side) for side in ("left", "right"))
            for a, b, low, high in zip(starts, np.append(starts[1:], len(ours)), lows, highs):
                some = theirs[low:high]
                for begin in range(a, b, BLOCK_ROWS) if low < high else ():
                    mine = ours[begin : min(b, begin + BLOCK_ROWS)]
                    dist = distances(unit_rows(vectors[mine].astype(np.float64)), unit_rows(old[some].astype(np.float64)))
                    dist[~(old_times[some][None, :] < times[mine][:, None])] = np.inf
                    dist[ids[mine][:, None] == old_ids[some][None, :]] = np.inf
                    for row, line in zip(mine.tolist(), dist):
                        best = nearest_places(line, old_ids[some], self.k)
                        lists["ids"][row], lists["distances"][row], lists["known"][row] = old_ids[some[best]], line[best], old_known[some[best]]
        own = [any_here or len(found) > 0 for any_here, found in zip(here, lists["ids"])]  # every arrival has a result in its own part
        yield pd.DataFrame({"scored_id": ids, "here": here, **lists})[own]

    def close(self) -> None:
        pass


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PARTS = 4  # of a client's history; every arriving row meets all of them
STATE_BUCKETS = 512  # of clients: each is a state per part, since a state costs more to open than a client's rows to compare
BLOCK_ROWS = 4096  # arrivals of one client that are compared at once


def score_state_stream(
    stream: DataFrame, cards: DataFrame, mcc_codes: DataFrame, threshold: float, out: str, checkpoint: str, k: int = 10, parts: int = STATE_PARTS, keep_ms: int | None = None, buckets: int = STATE_BUCKETS
) -> StreamingQuery:
    """Score transactions as they arrive against the earlier ones, which are kept as state by client.

    ``stream`` has the columns of transactions, with whole-numbered ids. Arrivals in order of time give the
    scores of ``score_transactions(as_of=True)``; a late row is scored against what is earlier than it
    and counts from then on, but rows that were scored before stay as they are. Rows without a client, date or vector
    have no neighbours and are not kept. Clients are dealt to ``buckets``, so a batch reads the states of its clients'
    buckets; a bucket's history is dealt to ``parts`` states, so that a busy client is neither one key nor one value. With ``keep_ms`` the history is forgotten so long after its arrival.
    Each batch owns one folder and overwrites it.
    """
    spark = stream.sparkSession
    card = cards.select(F.col("id").alias("card_id"), F.lit(True).alias("_card"))
    code = mcc_codes.select(F.col("mcc").cast("int").alias("mcc"), F.lit(True).alias("_code"))
    rows = stream.withColumns({"card_id": F.col("card_id").cast("long"), "mcc": F.col("mcc").cast("int")}).join(card, "card_id", "left").join(code, "mcc", "left")
    usable = F.col("client_id").isNotNull() & F.col("date").isNotNull() & F.col("embedding").isNotNull()
    own = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    whole = rows.schema["client_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    client = F.col("client_id").cast("long") if whole else F.xxhash64("client_id")
    rows = rows.where(usable).select(
        client.alias("client"), "id", F.col("date").cast("timestamp_ntz").alias("date"), "embedding", (F.coalesce("_card", F.lit(False)) & F.coalesce("_code", F.lit(False))).alias("known"),
        F.pmod(F.xxhash64("client_id"), F.lit(buckets)).cast("int").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), own.alias("_own"),
    )
    rows = rows.withColumn("here", F.col("part") == F.col("_own")).drop("_own")
    schema = "scored_id long, here boolean, ids array<long>, distances array<double>, known array<boolean>"
    near = rows.groupBy("bucket", "part").transformWithStateInPandas(EarlierNeighbours(k, keep_ms), schema, "Append", "ProcessingTime" if keep_ms else "None")

    def batch(df: DataFrame, batch_id: int) -> None:
        # lists meet by arrival, and are read once: the states are not gone through again
        met = df.select("scored_id", F.col("here").cast("int").alias("here"), F.arrays_zip("distances", "ids", "known").alias("near"))
        met = met.repartition("scored_id").groupBy("scored_id").agg(F.sum("here").alias("rows"), F.flatten(F.collect_list("near")).alias("near"))
        best = F.filter(F.slice(F.array_sort("near"), 1, k), lambda n: n["known"])
        units = F.aggregate(best, F.lit(0).cast("long"), lambda total, n: total + distance_units(n["distances"]))
        scores = met.select(F.col("scored_id").alias("id"), "rows", units.alias("units"), F.size(best).alias("n"))
        scores = scores.select("id", *mean_columns(F.col("units"), F.col("n"), threshold), F.explode(F.sequence(F.lit(1), "rows")).alias("row")).drop("row")
        scores.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)  # the one that holds lists; a started query keeps its own settings
    try:
        return near.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def latest_stream(stream: DataFrame, order: str, tie: str, base: str, checkpoint: str, n: int = 50) -> StreamingQuery:
    """Keep the newest n rows seen so far; the stored table never holds more.

    Merging a batch twice gives the same rows, since a row replaces its own copy.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        newest = df.orderBy(F.desc(order), F.desc(tie)).limit(n)
        if snapshot_versions(spark, base):
            newest = newest.unionByName(read_snapshot(spark, base)).dropDuplicates([tie])
        refresh_snapshot(newest.orderBy(F.desc(order), F.desc(tie)).limit(n), base)

    return (
        stream.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def load_share_stream(
    stream: DataFrame, time: str, window: str, delay: str, out: str, checkpoint: str
) -> StreamingQuery:
    """Load share per interval; rows later than ``delay`` are dropped, an interval is written once closed.

    ``stream`` holds the time column as a timestamp with time zone and a ``kind`` column, see ``load_counts``.
    """
    counted = load_counts(stream.withWatermark(time, delay).groupBy(F.window(time, window)))
    shares = load_percentages(counted).withColumn("window_start", F.col("window.start")).drop("window")
    return (
        shares.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def trade_stream(stream: DataFrame, out: str, checkpoint: str, now: datetime) -> StreamingQuery:
    """Append trades with the casts, checks and generated ids of the batch append.

    Ids follow from the number of the batch, so a repeated batch gets the same range again.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        with scratch(df.sparkSession):
            numbered_trades(df, batch_id, now).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
