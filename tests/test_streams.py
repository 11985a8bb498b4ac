"""Streams over several files: repeated runs, late rows, bounded results."""

import os
from datetime import datetime, timedelta
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from finsearch.plans import fraud
from finsearch.session import work_dir, written
from finsearch.sources.snapshots import read_snapshot
from finsearch.streaming import streams

SCHEMA = "id long, ts timestamp_ntz, kind string, shares int, price double"
START = datetime(2024, 1, 1)


def add_file(spark, folder, ids, minutes=None):
    rows = [(i, START + timedelta(minutes=i if minutes is None else minutes), ["read", "forwarded", "write"][i % 3], 1, 2.5) for i in ids]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def folder(spark):
    path = work_dir(spark, "arriving")
    add_file(spark, path, range(0, 60))
    return path


def read(spark, folder, schema=SCHEMA):
    return streams.file_stream(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)


def test_newest_rows(spark, folder):
    base = work_dir(spark, "latest")

    def run():
        streams.latest_stream(read(spark, folder), "ts", "id", f"{base}/out", f"{base}/checkpoint", 50).awaitTermination()
        return sorted(r.id for r in read_snapshot(spark, f"{base}/out").collect())

    assert run() == list(range(10, 60))
    add_file(spark, folder, range(100, 120))
    assert run() == list(range(30, 60)) + list(range(100, 120))
    add_file(spark, folder, range(0, 5))  # old rows change nothing
    assert run() == list(range(30, 60)) + list(range(100, 120))


def test_scores_are_written_once(spark, folder):
    base = work_dir(spark, "scores")

    def run():
        score = lambda df: df.select("id", (F.col("price") * 2).alias("score"))
        streams.score_stream(read(spark, folder), score, f"{base}/out", f"{base}/checkpoint").awaitTermination()
        return sorted(r.id for r in spark.read.parquet(f"{base}/out").collect())

    assert run() == list(range(60))
    add_file(spark, folder, range(60, 70))
    assert run() == run() == list(range(70))


def test_batches_leave_no_intermediates(spark, folder):
    base, held = work_dir(spark, "scores"), []

    def score(df):
        kept = written(df.select("id"), "in-between")
        held.extend(kept.inputFiles())
        return kept

    streams.score_stream(read(spark, folder), score, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{base}/out").count() == 60
    assert held and not any(os.path.exists(urlparse(f).path) for f in held)


def test_arrivals_that_history_does_not_have_are_scored(spark):
    history = [(1, START, 7, 1, 1.0, 1, "c", "t", [1.0, 0.0]), (2, START + timedelta(days=1), 7, 1, 1.0, 1, "c", "t", [0.0, 1.0])]
    schema = "id long, date timestamp_ntz, client_id long, card_id long, amount double, mcc int, merchant_city string, transaction_description string, embedding array<float>"
    stored = spark.createDataFrame(history, schema)
    cards, codes = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1, "x")], "mcc short, description string")
    path = work_dir(spark, "new-arrivals")
    new = [(3, START + timedelta(days=2), 7, 1, 1.0, 1, "c", "t", [1.0, 0.0]), (4, START, 8, 1, 1.0, 1, "c", "t", [1.0, 0.0])]
    spark.createDataFrame(new, schema).write.parquet(path)
    base = work_dir(spark, "scores")
    score = lambda df: fraud.score_transactions(df, stored, cards, codes, 0.1, as_of=True)
    streams.score_stream(read(spark, path, schema), score, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    rows = {r.id: (r.avg_distance, r.n_neighbours) for r in spark.read.parquet(f"{base}/out").collect()}
    assert rows == {3: (0.5, 2), 4: (0.0, 0)}


def test_trades(spark, folder):
    base = work_dir(spark, "trades")

    def run():
        trades = read(spark, folder).select(F.lit("AAPL").alias("ticker"), "shares", "price")
        streams.trade_stream(trades, f"{base}/out", f"{base}/checkpoint", START).awaitTermination()
        return spark.read.parquet(f"{base}/out")

    run()
    add_file(spark, folder, range(60, 70))
    stored = run()
    assert stored.count() == 70 == stored.select("trade_id").distinct().count()
    assert dict(stored.dtypes)["price"] == "decimal(10,2)" and {r.executed_at for r in stored.collect()} == {START}


def test_load_share_closes_windows_and_drops_late_rows(spark, folder):
    base = work_dir(spark, "share")

    def run():
        stream = read(spark, folder).select(F.col("ts").cast("timestamp").alias("ts"), "kind")
        streams.load_share_stream(stream, "ts", "10 minutes", "5 minutes", f"{base}/out", f"{base}/checkpoint").awaitTermination()
        rows = spark.read.parquet(f"{base}/out").orderBy("window_start").collect()
        return [(r.window_start.hour * 60 + r.window_start.minute, r.n_reads, r.n_writes) for r in rows]

    first = run()
    assert [w for w, _, _ in first] == [0, 10, 20, 30, 40]  # the last window stays open
    assert first[0] == (0, 7, 3)
    add_file(spark, folder, range(60, 90))
    add_file(spark, folder, [3], minutes=1)  # long after its window was closed
    later = run()
    assert later[: len(first)] == first
    assert [w for w, _, _ in later] == [0, 10, 20, 30, 40, 50, 60, 70]


TRANSACTIONS = "id long, date timestamp_ntz, client_id long, card_id long, mcc int, embedding array<float>"


def add_transactions(spark, folder, numbers, minutes=None):
    """Client 1 has most of them; card 3 and code 4 are not known."""
    rows = []
    for i in numbers:
        vector = [float((i * 7919 + j * 104729) % 101 - 50) for j in range(6)]
        rows.append((i, START + timedelta(minutes=i if minutes is None else minutes), 1 if i % 4 else i % 3, i % 4, i % 5, vector))
    spark.createDataFrame(rows, TRANSACTIONS).coalesce(1).write.mode("append").parquet(folder)


def test_state_gives_the_scores_of_the_batch_and_survives_a_restart(spark):
    base = work_dir(spark, "state")
    cards, codes = spark.createDataFrame([(0,), (1,), (2,)], "id long"), spark.createDataFrame([(0,), (1,), (2,), (3,)], "mcc short")

    def run():
        arriving = read(spark, f"{base}/in", TRANSACTIONS)
        streams.score_state_stream(arriving, cards, codes, 0.5, f"{base}/out", f"{base}/checkpoint", k=4, parts=3).awaitTermination()
        return {r["id"]: tuple(r)[1:4] for r in spark.read.parquet(f"{base}/out").select("id", "avg_distance", "n_neighbours", "is_anomalous").collect()}

    def expected(ids):
        known = spark.read.parquet(f"{base}/in")
        rows = fraud.score_transactions(known.where(F.col("id").isin(ids)), known, cards, codes, 0.5, k=4, as_of=True)
        return {r["id"]: tuple(r)[1:4] for r in rows.collect()}

    add_transactions(spark, f"{base}/in", range(0, 40))
    add_transactions(spark, f"{base}/in", range(40, 70))
    first = run()
    assert first == expected(list(range(70))) and any(n for _, n, _ in first.values())
    add_transactions(spark, f"{base}/in", range(70, 90))
    second = run()  # a new query goes on with the stored state
    assert second == expected(list(range(90))) and {i: second[i] for i in first} == first
    add_transactions(spark, f"{base}/in", range(200, 203), minutes=20)  # late: scored against what is earlier, and kept
    third = run()
    assert {i: third[i] for i in range(200, 203)} == expected([200, 201, 202])
    assert {i: third[i] for i in second} == second
    add_transactions(spark, f"{base}/in", range(300, 310))
    assert {i: v for i, v in run().items() if i >= 300} == expected(list(range(300, 310)))


def test_clients_of_a_bucket_keep_apart_and_open_few_states(spark, monkeypatch):
    """400 clients and 3 buckets of 2 parts: a batch opens 6 states, not 800."""
    base, opened = work_dir(spark, "buckets"), spark.sparkContext.accumulator(0)
    plain = streams.EarlierNeighbours.handleInputRows

    def counting(self, key, rows, timers):
        opened.add(1)
        yield from plain(self, key, rows, timers)

    rows = [(i, START + timedelta(minutes=i), i % 400, 1, 1, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(1600)]
    for part in (rows[:1000], rows[1000:]):
        spark.createDataFrame(part, TRANSACTIONS).coalesce(1).write.mode("append").parquet(f"{base}/in")
    cards, codes = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1,)], "mcc short")
    monkeypatch.setattr(streams.EarlierNeighbours, "handleInputRows", counting)
    streams.score_state_stream(read(spark, f"{base}/in", TRANSACTIONS), cards, codes, 0.01, f"{base}/out", f"{base}/checkpoint", k=2, parts=2, buckets=3).awaitTermination()
    columns = ["id", "avg_distance", "n_neighbours", "is_anomalous"]
    found = sorted(map(tuple, spark.read.parquet(f"{base}/out").select(columns).collect()))
    known = spark.read.parquet(f"{base}/in")
    wanted = sorted(map(tuple, fraud.score_transactions(known, known, cards, codes, 0.01, k=2, as_of=True).select(columns).collect()))
    assert found == wanted and any(w[2] for w in wanted)
    assert 0 < opened.value <= 12
