"""Nearest-neighbour anomaly scoring of transactions, questions, verdicts and evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsearch.functions.vectors import DISTANCE_DIGITS, rounded
from finsearch.operators.ranking import small_side
from finsearch.operators.vector_search import knn_within
from finsearch.session import written

# Thresholds on the mean neighbour distance, width of the grey band.
SERVICE_THRESHOLD = 0.011
DEFAULT_THRESHOLD = 0.021
THRESHOLDS = (0.011, 0.021, 0.031)
GREY_BAND = 0.007

QUESTIONS = {
    "small_amount": 5.0,
    "income_share": 0.05,
    "poor_score": 400,
    "poor_limit": 500.0,
    "mean_factor": 3.0,
    "report_limit": 10_000.0,
    "below_limit": 0.05,
}


def latest_transactions(transactions: DataFrame) -> DataFrame:
    """The newest transaction of every client, the larger id on equal times; rows without a date count as oldest.

    Only client, date and id are aggregated; the other columns are fetched for the chosen ids.
    """
    newest = F.max(F.struct("date", "id")).alias("newest")
    chosen = transactions.select("client_id", "date", "id").groupBy("client_id").agg(newest).select(F.col("newest.id").alias("id"))
    return transactions.join(chosen, "id", "left_semi").select("client_id", *[c for c in transactions.columns if c != "client_id"])


def pick_transactions(transactions: DataFrame, requests: DataFrame) -> DataFrame:
    """The transaction each of ``requests(client_id, transaction_id)`` asks for: the one with the
    given id or, without an id, the client's newest."""
    by_id = requests.where(F.col("transaction_id").isNotNull()).select(F.col("transaction_id").alias("id"))
    clients = requests.where(F.col("transaction_id").isNull()).select("client_id")
    named = transactions.join(by_id, "id", "left_semi").select(transactions.columns)
    newest = latest_transactions(transactions.join(clients, "client_id", "left_semi")).select(transactions.columns)
    return named.unionByName(newest)


def neighbours(scored: DataFrame, history: DataFrame, k: int = 10, as_of: bool = False) -> DataFrame:
    """The k nearest other transactions of the same client; ``as_of`` allows earlier ones only."""
    return knn_within(scored, history, "client_id", k, "date" if as_of else None)


def similar_history(
    near: DataFrame, history: DataFrame, cards: DataFrame, mcc_codes: DataFrame, max_near: int | None = None
) -> DataFrame:
    """Neighbours with card and merchant details; those without card or code drop out.

    ``max_near`` bounds the neighbours, so that few of them are looked up without moving the history.
    """
    tx = history.select("id", "date", "amount", "transaction_description", "merchant_city", "card_id", "mcc")
    card = cards.select(F.col("id").alias("card_id"), "card_brand", "card_type", "card_on_dark_web")
    codes = mcc_codes.select(F.col("mcc").cast("int").alias("mcc"), F.col("description").alias("mcc_description"))
    few = near.select("scored_id", "id", "distance", "rn")
    return (
        tx.join(few if max_near is None else small_side(few, max_near), "id")
        .withColumn("card_id", F.col("card_id").cast("long"))
        .join(card, "card_id")
        .join(codes, "mcc")
    )


def score_transactions(
    scored: DataFrame,
    history: DataFrame,
    cards: DataFrame,
    mcc_codes: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    k: int = 10,
    as_of: bool = False,
) -> DataFrame:
    """Mean neighbour distance per scored transaction (0 without history) and the anomaly flag.

    Neighbours count only if their card and merchant code are known. The flag is strict. Distances
    are summed as whole billionths, so the mean does not depend on the order of the rows.
    """
    known = history.select("id", F.col("card_id").cast("long").alias("card_id"), F.col("mcc").cast("int").alias("mcc"))
    near = small_side(neighbours(scored, history, k, as_of), k * scored.count())
    counted = (
        known.join(near, "id")
        .join(cards.select(F.col("id").alias("card_id")), "card_id")
        .join(mcc_codes.select(F.col("mcc").cast("int").alias("mcc")), "mcc")
    )
    return mean_distances(scored.select("id"), counted, threshold)


def distance_units(distance: Column) -> Column:
    """A distance in whole billionths, which add up to the same in any order."""
    return F.round(distance * 10.0**DISTANCE_DIGITS).cast("long")


def mean_columns(units: Column, n: Column, threshold: float) -> list[Column]:
    """Mean distance of ``n`` neighbours that are ``units`` away in all, 0 without any, their number and the strict flag."""
    mean = F.coalesce(F.when(n > 0, units / (n * 10.0**DISTANCE_DIGITS)), F.lit(0.0))
    return [mean.alias("avg_distance"), F.coalesce(n, F.lit(0)).cast("long").alias("n_neighbours"), (mean > threshold).alias("is_anomalous")]


def mean_distances(scored: DataFrame, near: DataFrame, threshold: float) -> DataFrame:
    """``scored(id)`` with the mean distance of ``near(scored_id, distance)``, 0 without any, their number and the strict flag."""
    counted = near.groupBy("scored_id").agg(F.sum(distance_units(F.col("distance"))).alias("units"), F.count("*").alias("n"))
    met = scored.select(F.col("id").alias("scored_id")).join(counted, "scored_id", "left")
    return met.select(F.col("scored_id").alias("id"), *mean_columns(F.col("units"), F.col("n"), threshold))


def yes_no(value: Column) -> Column:
    """``Yes`` for true, anything else including null is ``No``."""
    return F.when(value, F.lit("Yes")).otherwise(F.lit("No"))


def decode_verdict(answer: Column) -> Column:
    """A textual answer as ``Yes`` or ``No``."""
    return yes_no(answer.isin("true", "t", "Yes"))


def fraud_questions(transactions: DataFrame, users: DataFrame, settings: dict | None = None) -> DataFrame:
    """Three yes/no questions per transaction: card testing, lifestyle mismatch, structured amounts.

    The client's own mean is aggregated first and joined back, so a busy client is never
    gathered in one window.
    """
    cfg = {**QUESTIONS, **(settings or {})}
    amount = F.col("amount").cast("double")
    own = transactions.groupBy("client_id").agg(
        (F.sum(F.col("amount").cast("decimal(28,10)")).cast("decimal(38,2)").cast("double") / F.count("amount")).alias("own_mean")
    )
    income = users.select(F.col("id").alias("client_id"), F.col("yearly_income").cast("double").alias("yearly_income"), "credit_score")
    limit, width = cfg["report_limit"], cfg["below_limit"]
    return (
        transactions.select("id", "client_id", "amount")
        .join(own, "client_id")
        .join(income, "client_id", "left")
        .select(
            "id",
            yes_no(amount < cfg["small_amount"]).alias("card_testing"),
            yes_no(
                ((F.col("yearly_income") > 0) & (amount > F.col("yearly_income") * cfg["income_share"]))
                | ((F.col("credit_score") < cfg["poor_score"]) & (amount > cfg["poor_limit"]))
                | (amount > F.col("own_mean") * cfg["mean_factor"])
            ).alias("lifestyle_mismatch"),
            yes_no(
                ((amount > 0) & (amount == F.floor(amount))) | ((amount >= limit * (1 - width)) & (amount < limit))
            ).alias("structured_amounts"),
        )
    )


ANSWERS = ("card_testing", "lifestyle_mismatch", "structured_amounts")


def route_questions(scores: DataFrame, threshold: float, grey_band: float = GREY_BAND, force: bool = False) -> DataFrame:
    """``asked`` inside the grey band around the threshold, else ``skipped``."""
    gap = F.abs(F.col("avg_distance") - F.lit(threshold))
    asked = F.lit(True) if force else gap <= grey_band
    return scores.withColumn("route", F.when(asked, F.lit("asked")).otherwise(F.lit("skipped")))


def routed_answers(scores: DataFrame, questions: DataFrame, threshold: float, grey_band: float = GREY_BAND, force: bool = False) -> DataFrame:
    """Scores with the answers of the transactions that were asked; skipped ones have none.

    The route is part of the join condition, so the scores are computed once.
    """
    routed = route_questions(scores, threshold, grey_band, force)
    answers = questions.withColumnRenamed("id", "answered_id")
    asked = (F.col("id") == F.col("answered_id")) & (F.col("route") == "asked")
    return routed.join(answers, asked, "left").drop("answered_id")


def combined_verdict(answered: DataFrame, answers: Sequence[str] = ANSWERS) -> DataFrame:
    """Distance flag or any question answered ``Yes``; a missing answer counts as ``No``."""
    fraud = F.col("is_anomalous")
    for name in answers:
        fraud = fraud | F.coalesce(F.col(name) == "Yes", F.lit(False))
    return answered.withColumn("is_fraud_verdict", fraud)


def threshold_sweep(
    scores: DataFrame,
    questions: DataFrame,
    labels: DataFrame,
    thresholds: Sequence[float] = THRESHOLDS,
    grey_band: float = GREY_BAND,
    answers: Sequence[str] = ANSWERS,
) -> DataFrame:
    """Confusion counts and rates per threshold, with and without the questions.

    All settings are summed in one aggregate over the scored rows; only the single result row is unfolded.
    """
    rows = scores.join(labels.select(F.col("transaction_id").alias("id"), "is_fraud"), "id").join(questions, "id", "left")
    any_yes = F.lit(False)
    for name in answers:
        any_yes = any_yes | F.coalesce(F.col(name) == "Yes", F.lit(False))
    sums, unfolded = [], []
    for i, threshold in enumerate(thresholds):
        flag = F.col("avg_distance") > threshold
        grey = F.abs(F.col("avg_distance") - F.lit(threshold)) <= grey_band
        for with_questions, predicted in ((False, flag), (True, flag | (grey & any_yes))):
            names = [f"c{i}_{int(with_questions)}_{cell}" for cell in ("tp", "fp", "fn", "tn")]
            cells = [
                predicted & F.col("is_fraud"),
                predicted & ~F.col("is_fraud"),
                ~predicted & F.col("is_fraud"),
                ~predicted & ~F.col("is_fraud"),
            ]
            sums += [F.count(F.when(c, 1)).alias(n) for c, n in zip(cells, names)]
            unfolded.append(
                F.struct(
                    F.lit(float(threshold)).alias("threshold"),
                    F.lit(with_questions).alias("with_questions"),
                    *[F.col(n).alias(cell) for n, cell in zip(names, ("tp", "fp", "fn", "tn"))],
                )
            )
    table = rows.agg(*sums).select(F.inline(F.array(*unfolded)))

    def rate(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.round(part / whole, 6))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return table.select(
        "threshold",
        "with_questions",
        "tp",
        "fp",
        "fn",
        "tn",
        rate(tp, tp + fn).alias("recall"),
        rate(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        rate(fp, fp + tn).alias("false_positive_rate"),
        rate(fn, tp + fn).alias("false_negative_rate"),
    )


def fraud_feed(
    transactions: DataFrame,
    labels: DataFrame,
    as_of: str,
    base: datetime,
    n_fraud: int = 15,
    n_clear: int = 100,
    run: int = 6,
    step_minutes: int = 2,
) -> DataFrame:
    """Labelled replay: after every ``run`` clear transactions comes one fraud, with rising times.

    Both classes are cut by id first, so the numbering below works on a bounded handful of rows.
    """
    columns = ["id", "client_id", "amount", "transaction_description", "merchant_city"]
    labelled = transactions.join(labels, F.col("id") == F.col("transaction_id"))
    fraud = labelled.where(F.col("is_fraud") & (F.col("amount") > 0)).select(*columns, F.lit(True).alias("is_fraud"))
    day = F.lit(as_of).cast("date").cast("timestamp_ntz")
    same_day = (F.col("date") >= day) & (F.col("date") < day + F.expr("INTERVAL 1 DAY"))
    clear = labelled.where(~F.col("is_fraud") & same_day).select(*columns, F.lit(False).alias("is_fraud"))

    picked = fraud.orderBy("id").limit(n_fraud).unionByName(clear.orderBy("id").limit(n_clear))
    by_class = Window.partitionBy("is_fraud")
    numbered = picked.withColumn("k", F.row_number().over(by_class.orderBy("id")) - 1).withColumn(
        "n", F.max(F.when(~F.col("is_fraud"), F.col("k") + 1)).over(Window.partitionBy(F.lit(1)))
    ).withColumn("f", F.coalesce(F.max(F.when(F.col("is_fraud"), F.col("k") + 1)).over(Window.partitionBy(F.lit(1))), F.lit(0)))
    k, n, f = F.col("k"), F.col("n"), F.col("f")
    clear_at = k + F.least(F.floor(k / run), f)
    fraud_at = F.least(run * (k + 1), n) + k
    shown = ~F.col("is_fraud") | (k < F.ceil(n / run))
    position = F.when(F.col("is_fraud"), fraud_at).otherwise(clear_at).cast("long")
    start = F.lit(base).cast("timestamp_ntz")
    return (
        numbered.where(shown)
        .withColumn("position", position)
        .select(
            "position",
            *columns,
            "is_fraud",
            (start + F.make_dt_interval(mins=(F.col("position") * step_minutes).cast("int"))).alias("date"),
        )
    )


def semantic_filter(
    transactions: DataFrame, sample: DataFrame, threshold: float = 0.5, label: str = "answer"
) -> DataFrame:
    """Bulk yes/no filter: a small model learns the answers of a labelled sample from the embeddings
    and is applied to the whole table. Returns ids with their probability where the answer is yes."""
    known = sample.select("id", F.col(label).cast("double").alias("label")).join(
        transactions.select("id", "embedding").where(F.col("embedding").isNotNull()), "id"
    )
    training = written(known, "training").select(array_to_vector("embedding").alias("features"), "label")
    model = LogisticRegression(maxIter=25, regParam=0.01).fit(training)
    scored = model.transform(transactions.where(F.col("embedding").isNotNull()).select("id", array_to_vector("embedding").alias("features")))
    probability = vector_to_array("probability")[1]
    return scored.select("id", rounded(probability, 6).alias("probability")).where(F.col("probability") >= threshold)
