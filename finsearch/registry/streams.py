"""Streaming forms over the events table, run until all available files are read."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsearch.plans import fraud
from finsearch.registry import query
from finsearch.registry.fraud import scores_sql
from finsearch.registry.roles import THRESHOLD, Roles, request_kind, with_roles
from finsearch.registry.tables import LOAD, SHARE
from finsearch.session import work_dir
from finsearch.sources.sinks import build_clustered, read_trades
from finsearch.sources.snapshots import complete_parts, read_snapshot
from finsearch.streaming import streams


def _events(r: Roles) -> DataFrame:
    return streams.file_stream(r.spark, r.folder, r.table("events").schema, "events.parquet")


@query(
    "stream_scores",
    with_roles("known", "apart", more=scores_sql("transactions", True), body="SELECT id, avg_distance, n_neighbours, is_anomalous FROM scores"),
)
def stream_scores(r: Roles) -> DataFrame:
    """Arriving transactions scored against the stored history, earlier rows only.

    The history is stored by client once, not put together again for every batch.
    """
    base = work_dir(r.spark, "stream-scores")
    history = build_clustered(r.transactions(), f"{base}/history", ["client_id"])

    def score(batch: DataFrame) -> DataFrame:
        return fraud.score_transactions(r.transactions_of(batch), history, r.cards(), r.mcc_codes(), THRESHOLD, as_of=True)

    streams.score_stream(_events(r), score, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return r.spark.read.parquet(*complete_parts(r.spark, f"{base}/out", "batch_id"))


@query(
    "stream_scores_state",
    with_roles("known", "apart", more=scores_sql("transactions", True), body="SELECT id, avg_distance, n_neighbours, is_anomalous FROM scores"),
)
def stream_scores_state(r: Roles) -> DataFrame:
    """Transactions arrive in three files, in order of time, and are scored against the state that the earlier ones left."""
    base = work_dir(r.spark, "stream-state")
    events = r.table("events")
    cuts = events.select(F.percentile_approx("ts", F.array(F.lit(0.4), F.lit(0.7)), 1000).alias("cuts")).first()["cuts"]
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = events if low is None else events.where(F.col("ts") >= F.lit(low))
        (part if high is None else part.where(F.col("ts") < F.lit(high))).repartition(1).write.mode("append").parquet(f"{base}/in")
    arriving = streams.file_stream(r.spark, f"{base}/in", events.schema, files_per_batch=1)
    arriving = arriving.repartition(int(r.spark.conf.get("spark.sql.shuffle.partitions")))  # a batch is one file
    query = streams.score_state_stream(r.transactions_of(arriving), r.cards(), r.mcc_codes(), THRESHOLD, f"{base}/out", f"{base}/checkpoint")
    query.awaitTermination()
    return r.spark.read.parquet(*complete_parts(r.spark, f"{base}/out", "batch_id"))


@query("stream_latest50", "SELECT event_id, ts, user_id, event_type, value, props FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def stream_latest50(r: Roles) -> DataFrame:
    base = work_dir(r.spark, "stream-latest")
    streams.latest_stream(_events(r), "ts", "event_id", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return read_snapshot(r.spark, f"{base}/out")


@query(
    "stream_load_share",
    with_roles(
        "requests",
        body=f"""SELECT *, {SHARE} FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, {LOAD} FROM requests GROUP BY 1)
        WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM requests)""",
    ),
)
def stream_load_share(r: Roles) -> DataFrame:
    base = work_dir(r.spark, "stream-load")
    stream = _events(r).select(F.col("ts").cast("timestamp").alias("ts"), request_kind().alias("kind"))
    streams.load_share_stream(stream, "ts", "6 hours", "1 hour", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return r.spark.read.parquet(f"{base}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "stream_trades",
    """SELECT event_type AS ticker, count(*) AS n_trades, count(*) AS n_ids, CAST(sum(user_id) AS BIGINT) AS shares,
    CAST(sum(CAST(value AS DECIMAL(10,2))) AS DOUBLE) AS total, max(ts) AS last_at FROM events GROUP BY event_type""",
)
def stream_trades(r: Roles) -> DataFrame:
    base = work_dir(r.spark, "stream-trades")
    arriving = _events(r).select(
        F.col("event_type").alias("ticker"), F.col("user_id").alias("shares"), F.col("value").alias("price"), F.col("ts").alias("executed_at")
    )
    streams.trade_stream(arriving, f"{base}/out", f"{base}/checkpoint", datetime(2024, 2, 1)).awaitTermination()
    return (
        read_trades(r.spark, f"{base}/out", "batch_id")
        .groupBy("ticker")
        .agg(
            F.count("*").alias("n_trades"),
            F.countDistinct("trade_id").alias("n_ids"),
            F.sum("shares").alias("shares"),
            F.sum("price").cast("double").alias("total"),
            F.max("executed_at").alias("last_at"),
        )
    )
