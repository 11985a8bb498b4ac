"""Scores, questions, routing, verdicts, sweep and feed on small frames."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from finsearch.plans import fraud
from finsearch.session import work_dir

TX = "id long, date timestamp_ntz, client_id long, card_id long, amount double, mcc int, merchant_city string, transaction_description string, embedding array<float>"


def tx(i, client, vector, day=1, amount=10.0, mcc=1, card=None):
    return (i, datetime(2024, 1, day), client, client if card is None else card, amount, mcc, "c", f"t{i}", vector)


@pytest.fixture(scope="module")
def world(spark):
    rows = [
        tx(1, 1, [1.0, 0.0], 1),
        tx(2, 1, [0.0, 1.0], 2),
        tx(3, 1, [0.6, 0.8], 3, mcc=9),  # unknown merchant code
        tx(4, 2, [1.0, 0.0], 1),  # no other transaction
    ]
    history = spark.createDataFrame(rows, TX)
    cards = spark.createDataFrame([(1, "VISA", "Credit", False), (2, "AMEX", "Debit", True)], "id long, card_brand string, card_type string, card_on_dark_web boolean")
    codes = spark.createDataFrame([(1, "Shop")], "mcc short, description string")
    return history, cards, codes


def test_scores(world):
    history, cards, codes = world
    rows = {r.id: r for r in fraud.score_transactions(history, history, cards, codes, threshold=1.0).collect()}
    assert rows[1].avg_distance == 1.0 and rows[1].n_neighbours == 1  # 3 does not count
    assert not rows[1].is_anomalous  # strictly greater
    assert rows[3].avg_distance == pytest.approx((0.4 + 0.2) / 2, abs=1e-6) and rows[3].n_neighbours == 2
    flagged = fraud.score_transactions(history, history, cards, codes, threshold=0.999)
    assert {r.id for r in flagged.where("is_anomalous").collect()} == {1, 2}
    assert rows[4].avg_distance == 0.0 and rows[4].n_neighbours == 0 and not rows[4].is_anomalous


def test_scores_as_of(world):
    history, cards, codes = world
    rows = {r.id: r for r in fraud.score_transactions(history, history, cards, codes, 0.1, as_of=True).collect()}
    assert rows[1].n_neighbours == 0 and rows[2].avg_distance == 1.0 and rows[3].n_neighbours == 2


def test_history_details(world):
    history, cards, codes = world
    latest = fraud.latest_transactions(history)
    assert {(r.client_id, r.id) for r in latest.collect()} == {(1, 3), (2, 4)}
    near = fraud.neighbours(latest, history)
    rows = fraud.similar_history(near, history, cards, codes).collect()
    assert {(r.scored_id, r.id, r.mcc_description, r.card_brand, r.card_type) for r in rows} == {(3, 1, "Shop", "VISA", "Credit"), (3, 2, "Shop", "VISA", "Credit")}
    plan = near._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan


def test_equal_dates_take_the_larger_id(spark):
    rows = spark.createDataFrame([tx(1, 1, None), tx(2, 1, None)], TX)
    assert fraud.latest_transactions(rows).first().id == 2


def test_undated_rows_are_no_neighbours_of_the_past(spark):
    rows = [tx(1, 1, [1.0, 0.0], 1), tx(2, 1, [1.0, 0.1], 2), (3, None, 1, 1, 1.0, 1, "c", "t", [1.0, 0.2]), tx(4, 1, [1.0, 0.3], 3)]
    history = spark.createDataFrame(rows, TX)
    near = fraud.neighbours(history, history, as_of=True)
    assert {(r.scored_id, r.id) for r in near.collect()} == {(2, 1), (4, 1), (4, 2)}
    assert fraud.latest_transactions(history).first().id == 4


def test_feed_reads_one_day_only(spark):
    path = work_dir(spark, "feed")
    spark.createDataFrame([tx(1, 1, None)], TX).write.parquet(path)
    labels = spark.createDataFrame([(1, False)], "transaction_id long, is_fraud boolean")
    plan = fraud.fraud_feed(spark.read.parquet(path), labels, "2024-01-02", datetime(2024, 2, 1))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(date,2024-01-02T00:00)" in plan and "LessThan(date,2024-01-03T00:00)" in plan


def test_questions(spark):
    rows = [tx(1, 1, None, amount=1.5), tx(2, 1, None, amount=100.0), tx(3, 2, None, amount=9600.5), tx(4, 3, None, amount=50.5), tx(5, 1, None, amount=2.5)]
    rows += [tx(6, 4, None, amount=600.5), tx(7, 5, None, amount=600.5)]
    users = spark.createDataFrame([(2, 1000.0, 700), (3, 2000.0, 399), (4, 50_000.0, 399), (5, 50_000.0, 400)], "id long, yearly_income double, credit_score int")
    got = {r.id: (r.card_testing, r.lifestyle_mismatch, r.structured_amounts) for r in fraud.fraud_questions(spark.createDataFrame(rows, TX), users).collect()}
    assert got[1] == ("Yes", "No", "No")
    assert got[2] == ("No", "No", "Yes")  # 100 is below three times the mean of 34.67
    assert got[3] == ("No", "Yes", "Yes")
    assert got[4] == ("No", "No", "No")
    assert got[6] == ("No", "Yes", "No") and got[7] == ("No", "No", "No")  # a poor credit score and a large amount


def test_verdict_decoding(spark):
    df = spark.createDataFrame([("t",), ("Yes",), ("true",), ("no",), (None,)], "a string")
    assert [r.v for r in df.select(fraud.decode_verdict(F.col("a")).alias("v")).collect()] == ["Yes", "Yes", "Yes", "No", "No"]


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(1, 0.021, False), (2, 0.0275, True), (3, 0.05, True), (4, 0.0, False)]
    return spark.createDataFrame(rows, "id long, avg_distance double, is_anomalous boolean")


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame([(i, "No", "No", "Yes" if i in (1, 4) else "No") for i in (1, 2, 3, 4)], "id long, card_testing string, lifestyle_mismatch string, structured_amounts string")


def test_grey_band(scores, answers):
    routed = {r.id: r.route for r in fraud.route_questions(scores, 0.021).collect()}
    assert routed == {1: "asked", 2: "asked", 3: "skipped", 4: "skipped"}
    assert {r.route for r in fraud.route_questions(scores, 0.021, force=True).collect()} == {"asked"}
    verdicts = {r.id: r.is_fraud_verdict for r in fraud.combined_verdict(fraud.routed_answers(scores, answers, 0.021)).collect()}
    assert verdicts == {1: True, 2: True, 3: True, 4: False}  # 4 was not asked


def test_grey_band_edge(spark):
    df = spark.createDataFrame([(1, 0.007), (2, 0.0071)], "id long, avg_distance double")
    assert {r.id: r.route for r in fraud.route_questions(df, 0.0).collect()} == {1: "asked", 2: "skipped"}


def test_sweep(spark, scores, answers):
    labels = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "transaction_id long, is_fraud boolean")
    rows = {(r.threshold, r.with_questions): r for r in fraud.threshold_sweep(scores, answers, labels, (0.021, 1.0)).collect()}
    plain, asked, none = rows[(0.021, False)], rows[(0.021, True)], rows[(1.0, False)]
    assert (plain.tp, plain.fp, plain.fn, plain.tn) == (1, 1, 1, 1) and plain.recall == 0.5 and plain.accuracy == 0.5
    assert (asked.tp, asked.fn, asked.recall) == (2, 0, 1.0)
    assert (none.tp, none.fp, none.false_negative_rate, none.false_positive_rate) == (0, 0, 1.0, 0.0)


def replay(n_clear, n_fraud):
    """The replay in plain words: six clear ones, then one fraud, while clear ones are left."""
    clear, frauds, out = [f"c{i}" for i in range(n_clear)], [f"f{i}" for i in range(n_fraud)], []
    while clear:
        out += clear[:6]
        clear = clear[6:]
        out += frauds[:1]
        frauds = frauds[1:]
    return out


@pytest.mark.parametrize("n_clear, n_fraud", [(0, 2), (1, 0), (6, 1), (7, 3), (20, 2), (13, 15), (100, 15)])
def test_feed(spark, n_clear, n_fraud):
    rows = [tx(i, 1, None, day=2) for i in range(n_clear)] + [tx(1000 + i, 1, None) for i in range(n_fraud)] + [tx(5000, 1, None, amount=-1.0), tx(5001, 1, None, day=3)]
    labels = [(i, False) for i in range(n_clear)] + [(1000 + i, True) for i in range(n_fraud)] + [(5000, True), (5001, False)]
    base = datetime(2024, 2, 1)
    feed = fraud.fraud_feed(spark.createDataFrame(rows, TX), spark.createDataFrame(labels, "transaction_id long, is_fraud boolean"), "2024-01-02", base)
    got = feed.orderBy("position").collect()
    names = [f"f{r.id - 1000}" if r.is_fraud else f"c{r.id}" for r in got]
    assert names == replay(n_clear, n_fraud)
    assert [r.position for r in got] == list(range(len(got)))
    assert all(r.date == base + timedelta(minutes=2 * r.position) for r in got)


def test_bulk_filter_learns_a_rule(spark):
    rows = [tx(i, 1, [1.0 if i % 2 else -1.0, float(i % 7)]) for i in range(200)]
    table = spark.createDataFrame(rows, TX)
    sample = table.where("id < 100").select("id", (F.col("id") % 2 == 1).alias("answer"))
    found = {r.id for r in fraud.semantic_filter(table, sample).where("id >= 100").collect()}  # held out
    assert found == {i for i in range(100, 200) if i % 2}


def test_requested_transactions(spark, world):
    history, _, _ = world
    asked = spark.createDataFrame([(None, 1), (1, None), (9, None)], "client_id long, transaction_id long")
    picked = fraud.pick_transactions(history, asked)
    assert sorted(r.id for r in picked.collect()) == [1, 3] and picked.columns == history.columns
