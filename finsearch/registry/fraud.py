"""Anomaly scoring, questions, verdicts, evaluation and the labelled feed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsearch.plans import fraud
from finsearch.registry import query
from finsearch.registry.roles import THRESHOLD, THRESHOLDS, Roles, with_roles

FEED_DAY, FEED_BASE = "2024-01-02", datetime(2024, 2, 1)


def pairs_sql(scored: str, earlier: bool = False) -> str:
    """The ten nearest transactions of the same client for every row of ``scored``."""
    bound = " AND h.date < s.date" if earlier else ""
    return f"""SELECT s.id AS scored_id, h.id, distance, row_number() OVER (PARTITION BY s.id ORDER BY distance, h.id) AS rn
        FROM {scored} s JOIN transactions h ON h.client_id = s.client_id AND h.id <> s.id{bound}
        JOIN apart d ON d.vec_id = s.vec_id AND d.other_id = h.vec_id QUALIFY rn <= 10"""


def scores_sql(scored: str, earlier: bool = False) -> dict[str, str]:
    return {
        "near": pairs_sql(scored, earlier),
        "counted": """SELECT scored_id, CAST(sum(CAST(round(distance * 1e9) AS BIGINT)) AS DOUBLE) / (count(*) * 1e9) AS mean, count(*) AS n
            FROM near JOIN known USING (id) GROUP BY scored_id""",
        "scores": f"""SELECT s.id, coalesce(mean, 0.0::DOUBLE) AS avg_distance, coalesce(n, 0) AS n_neighbours,
            coalesce(mean, 0.0::DOUBLE) > {THRESHOLD}::DOUBLE AS is_anomalous
            FROM {scored} s LEFT JOIN counted ON s.id = scored_id""",
    }


LATEST = "SELECT * FROM transactions QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY date DESC, id DESC) = 1"
QUESTIONS = {
    "own": "SELECT client_id, CAST(round(sum(CAST(amount AS DECIMAL(28,10))), 2) AS DOUBLE) / count(amount) AS own_mean FROM transactions GROUP BY client_id",
    "questions": """SELECT t.id, CASE WHEN amount < 5.0::DOUBLE THEN 'Yes' ELSE 'No' END AS card_testing,
        CASE WHEN (yearly_income > 0 AND amount > yearly_income * 0.05::DOUBLE) OR (credit_score < 400 AND amount > 500.0::DOUBLE)
        OR amount > own_mean * 3.0::DOUBLE THEN 'Yes' ELSE 'No' END AS lifestyle_mismatch,
        CASE WHEN (amount > 0 AND amount = floor(amount)) OR (amount >= 9500.0::DOUBLE AND amount < 10000.0::DOUBLE) THEN 'Yes' ELSE 'No' END AS structured_amounts
        FROM transactions t JOIN own USING (client_id) LEFT JOIN users u ON u.id = t.client_id""",
}
ROUTED = f"""SELECT *, CASE WHEN abs(avg_distance - {THRESHOLD}::DOUBLE) <= 0.007::DOUBLE THEN 'asked' ELSE 'skipped' END AS route FROM scores"""
SCORE_ROLES = ("labelled", "known", "apart")


def labelled_scores(r: Roles) -> DataFrame:
    return fraud.score_transactions(r.labelled(), r.transactions(), r.cards(), r.mcc_codes(), THRESHOLD)


def questions(r: Roles) -> DataFrame:
    return fraud.fraud_questions(r.transactions().drop("embedding"), r.users())


@query(
    "latest_tx",
    with_roles("transactions", body=f"SELECT client_id, id, date, amount, transaction_description FROM ({LATEST})"),
)
def latest_tx(r: Roles) -> DataFrame:
    return fraud.latest_transactions(r.transactions().select("client_id", "id", "date", "amount", "transaction_description"))


@query(
    "fraud_history",
    with_roles(
        "known",
        "apart",
        more={"latest": LATEST, "near": pairs_sql("latest")},
        body="""SELECT scored_id, id, distance, rn, date, amount, transaction_description, merchant_city,
        card_brand, card_type, card_on_dark_web, mcc_description FROM near JOIN known USING (id)""",
    ),
)
def fraud_history(r: Roles) -> DataFrame:
    history = r.transactions()
    chosen = fraud.latest_transactions(history.select("client_id", "id", "date", "embedding"))
    near = fraud.neighbours(chosen, history)
    found = fraud.similar_history(near, history, r.cards(), r.mcc_codes(), 10 * chosen.count())
    return found.drop("card_id", "mcc")


@query("fraud_scores", with_roles(*SCORE_ROLES, more=scores_sql("labelled"), body="SELECT * FROM scores"))
def fraud_scores(r: Roles) -> DataFrame:
    return labelled_scores(r)


@query(
    "fraud_scores_as_of",
    with_roles("known", "apart", more=scores_sql("transactions", True), body="SELECT * FROM scores"),
)
def fraud_scores_as_of(r: Roles) -> DataFrame:
    history = r.transactions()
    return fraud.score_transactions(history, history, r.cards(), r.mcc_codes(), THRESHOLD, as_of=True)


@query("fraud_questions", with_roles("transactions", "users", more=QUESTIONS, body="SELECT * FROM questions"))
def fraud_questions(r: Roles) -> DataFrame:
    return questions(r)


@query(
    "fraud_routing",
    with_roles(
        *SCORE_ROLES,
        "users",
        more={**scores_sql("labelled"), **QUESTIONS, "routed": ROUTED},
        body="""SELECT r.*, card_testing, lifestyle_mismatch, structured_amounts
        FROM routed r LEFT JOIN questions q ON r.id = q.id AND route = 'asked'""",
    ),
)
def fraud_routing(r: Roles) -> DataFrame:
    return fraud.routed_answers(labelled_scores(r), questions(r), THRESHOLD)


@query(
    "fraud_verdicts",
    with_roles(
        *SCORE_ROLES,
        "users",
        more={**scores_sql("labelled"), **QUESTIONS, "routed": ROUTED},
        body="""SELECT r.id, r.avg_distance, r.is_anomalous, r.route, r.is_anomalous OR coalesce(card_testing = 'Yes', false)
        OR coalesce(lifestyle_mismatch = 'Yes', false) OR coalesce(structured_amounts = 'Yes', false) AS is_fraud_verdict
        FROM routed r LEFT JOIN questions q ON r.id = q.id AND route = 'asked'""",
    ),
)
def fraud_verdicts(r: Roles) -> DataFrame:
    answered = fraud.routed_answers(labelled_scores(r), questions(r), THRESHOLD)
    return fraud.combined_verdict(answered).select("id", "avg_distance", "is_anomalous", "route", "is_fraud_verdict")


ANY_YES = "'Yes' IN (card_testing, lifestyle_mismatch, structured_amounts)"


@query(
    "threshold_sweep",
    with_roles(
        *SCORE_ROLES,
        "users",
        more={
            **scores_sql("labelled"),
            **QUESTIONS,
            "settings": "SELECT threshold::DOUBLE AS threshold, with_questions FROM (VALUES "
            + ", ".join(f"({t})" for t in THRESHOLDS)
            + ") a(threshold), (VALUES (false), (true)) b(with_questions)",
            "predicted": f"""SELECT threshold, with_questions, is_fraud, avg_distance > threshold OR (with_questions
                AND abs(avg_distance - threshold) <= 0.007::DOUBLE AND {ANY_YES}) AS p
                FROM scores s JOIN fraud_labels l ON s.id = l.transaction_id JOIN questions q ON q.id = s.id CROSS JOIN settings""",
            "cells": """SELECT threshold, with_questions, count(*) FILTER (p AND is_fraud) AS tp, count(*) FILTER (p AND NOT is_fraud) AS fp,
                count(*) FILTER (NOT p AND is_fraud) AS fn, count(*) FILTER (NOT p AND NOT is_fraud) AS tn FROM predicted GROUP BY ALL""",
        },
        body="""SELECT *, round(tp / (tp + fn), 6) AS recall, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
        round(fp / (fp + tn), 6) AS false_positive_rate, round(fn / (tp + fn), 6) AS false_negative_rate FROM cells""",
    ),
)
def threshold_sweep(r: Roles) -> DataFrame:
    return fraud.threshold_sweep(labelled_scores(r), questions(r), r.fraud_labels(), THRESHOLDS)


@query(
    "fraud_feed",
    with_roles(
        "transactions",
        "fraud_labels",
        more={
            "joined": "SELECT t.*, is_fraud FROM transactions t JOIN fraud_labels ON id = transaction_id",
            "f": "SELECT *, row_number() OVER (ORDER BY id) - 1 AS k FROM joined WHERE is_fraud AND amount > 0 QUALIFY k < 15",
            "c": f"SELECT *, row_number() OVER (ORDER BY id) - 1 AS k FROM joined WHERE NOT is_fraud AND date::DATE = DATE '{FEED_DAY}' QUALIFY k < 100",
            "sizes": "SELECT (SELECT count(*) FROM c) AS n, (SELECT count(*) FROM f) AS m",
            "placed": """SELECT c.*, k + least(k // 6, m) AS position FROM c, sizes
                UNION ALL SELECT f.*, least(6 * (k + 1), n) + k FROM f, sizes WHERE k < ceil(n / 6)""",
        },
        body="""SELECT CAST(position AS BIGINT) AS position, id, client_id, amount, transaction_description, merchant_city, is_fraud,
        TIMESTAMP '2024-02-01' + to_minutes(CAST(position * 2 AS INTEGER)) AS date FROM placed""",
    ),
)
def fraud_feed(r: Roles) -> DataFrame:
    return fraud.fraud_feed(r.transactions(), r.fraud_labels(), FEED_DAY, FEED_BASE)


REQUESTS = """SELECT user_id AS client_id, CASE WHEN user_id % 3 > 0 THEN event_id END AS transaction_id
    FROM events WHERE event_type = 'error' AND value > 60.0"""


@query(
    "requested_transactions",
    with_roles(
        "transactions",
        more={
            "asked": REQUESTS,
            "latest": LATEST,
            "picked": """SELECT id FROM transactions WHERE id IN (SELECT transaction_id FROM asked)
                UNION ALL SELECT id FROM latest WHERE client_id IN (SELECT client_id FROM asked WHERE transaction_id IS NULL)""",
        },
        body="SELECT id, client_id, date, amount, transaction_description FROM picked JOIN transactions USING (id)",
    ),
)
def requested_transactions(r: Roles) -> DataFrame:
    """Some requests name a transaction, others a client whose newest is meant."""
    events = r.table("events").where((F.col("event_type") == "error") & (F.col("value") > 60.0))
    asked = events.select(
        F.col("user_id").alias("client_id"), F.when(F.col("user_id") % 3 > 0, F.col("event_id")).alias("transaction_id")
    )
    picked = fraud.pick_transactions(r.transactions().drop("embedding"), asked)
    return picked.select("id", "client_id", "date", "amount", "transaction_description")


@query(
    "decoded_verdicts",
    """SELECT event_id, answer, CASE WHEN answer IN ('true', 't', 'Yes') THEN 'Yes' ELSE 'No' END AS verdict
    FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN 't' WHEN 'purchase' THEN 'Yes' WHEN 'signup' THEN 'no' END AS answer
          FROM events)""",
)
def decoded_verdicts(r: Roles) -> DataFrame:
    """Textual answers of several spellings; one event type has none."""
    kind = F.col("event_type")
    answer = F.when(kind == "click", "true").when(kind == "view", "t").when(kind == "purchase", "Yes").when(kind == "signup", "no")
    answers = r.table("events").select("event_id", answer.alias("answer"))
    return answers.withColumn("verdict", fraud.decode_verdict(F.col("answer")))


def _learned(r: Roles) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors as transactions, and an answer that the vectors carry (the labels of the fixture do not follow from them).

    One fold of five is held out.
    """
    rows = r.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.element_at("embedding", 1) > 0).alias("answer"))
    known = rows.where(F.col("id") % 5 > 0).select("id", "answer")
    return rows.select("id", "embedding"), known, rows.where(F.col("id") % 5 == 0).select("id", "answer")


@query("semantic_filter")
def semantic_filter(r: Roles) -> DataFrame:
    """Learn a property of the vectors from four folds of five, ask it of all."""
    table, known, _ = _learned(r)
    return fraud.semantic_filter(table, known)


@query("semantic_filter_accuracy", "SELECT count(*) AS n_held_out, true AS accurate FROM embeddings WHERE vec_id % 5 = 0")
def semantic_filter_accuracy(r: Roles) -> DataFrame:
    """Whether the filter is right on at least four of five held-out rows."""
    table, known, held_out = _learned(r)
    found = fraud.semantic_filter(table, known).select("id", F.lit(True).alias("said"))
    right = F.coalesce("said", F.lit(False)) == F.col("answer")
    rated = held_out.join(found, "id", "left")
    return rated.agg(F.count("*").alias("n_held_out"), (F.avg(right.cast("double")) >= 0.8).alias("accurate"))
