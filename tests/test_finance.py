"""Bands, pivots, lakehouse queries and load share on small frames."""

import pytest
from pyspark.sql import functions as F

from finsearch.functions.finance import CONCEPT_COLUMNS, band, bands
from finsearch.operators.load import load_counts, load_percentages
from finsearch.plans import lakehouse


def test_band_edges(spark):
    df = spark.createDataFrame([(x,) for x in (99999999.0, 1e8, 5e8, 1e9, 1000000001.0, None)], "assets double")

    def kept(word):
        condition = band(F.col("assets"), word)
        return None if condition is None else [r.assets for r in df.where(condition).collect()]

    assert kept("low") == [99999999.0]
    assert kept("Medium") == [1e8, 5e8, 1e9]
    assert kept("high") == [1000000001.0]
    assert kept("none") is kept("") is kept(None) is kept("other") is None
    assert bands({"assets": "none"}) is None
    both = bands({"assets": "low", "cash": "high"})
    rows = spark.createDataFrame([(1.0, 2e9), (1.0, 1.0)], "assets double, cash double").where(both).collect()
    assert len(rows) == 1


@pytest.fixture(scope="module")
def concepts(spark):
    rows = [
        (1, "Assets", 5.0, 2025, "FY", "2025-02-01"),
        (1, "Assets", 9.0, 2025, "FY", "2025-01-01"),
        (1, "Revenues", 3.0, 2025, "FY", "2025-01-01"),
        (1, "Assets", 99.0, 2024, "FY", "2024-01-01"),
        (2, "Assets", 7.0, 2025, "Q1", "2025-01-01"),
        (1, "Unknown", 1.0, 2025, "FY", "2025-01-01"),
    ]
    return spark.createDataFrame(rows, "cik long, tag string, val double, fy long, fp string, filed string")


@pytest.fixture(scope="module")
def tickers(spark):
    return spark.createDataFrame([(1, "A"), (1, "A2"), (2, "B")], "cik long, ticker string")


def test_pivot(concepts, tickers):
    rows = {r.ticker: r for r in lakehouse.latest_financials(concepts, tickers, 2025, "FY").collect()}
    assert set(rows) == {"A", "A2"}
    assert rows["A"].assets == 9.0 and rows["A"].revenues == 3.0 and rows["A"].cash is None
    assert set(CONCEPT_COLUMNS.values()) <= set(rows["A"].asDict())
    newest = lakehouse.latest_financials(concepts, tickers, 2025, "FY", mode="latest").where("ticker = 'A'").first()
    assert newest.assets == 5.0 and newest.cash is None
    with pytest.raises(ValueError):
        lakehouse.latest_financials(concepts, tickers, 2025, "FY", mode="any")


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "A", 0, "t1", [1.0, 0.0]), (2, "B", 0, "t2", [0.9, 0.1]), (3, "C", 0, "t3", [0.0, 1.0])]
    return spark.createDataFrame(rows, "id long, ticker string, chunk_index int, chunk_text string, embedding array<float>")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("q", "x", [1.0, 0.0])], "query_id string, text string, vector array<float>")


def test_advanced_search(corpus, queries, concepts, tickers):
    financials = lakehouse.latest_financials(concepts, tickers, 2025, "FY")
    free = lakehouse.advanced_search(corpus, queries, financials, {})
    assert [(r.id, r.assets) for r in free.orderBy("rn").collect()] == [(1, 9.0), (2, None)]  # left join keeps B
    low = lakehouse.advanced_search(corpus, queries, financials, {"assets": "low"})
    assert [r.id for r in low.collect()] == [1]
    assert "LeftOuter" not in low._jdf.queryExecution().optimizedPlan().toString()
    # the pool is cut before the filter, unless the corpus is narrowed first
    late = lakehouse.advanced_search(corpus.where("id > 1").unionByName(corpus.where("id = 1")), queries, financials, {"assets": "low"}, pool=1)
    assert [r.id for r in late.collect()] == [1]
    far = queries.select("query_id", "text", F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>").alias("vector"))
    assert lakehouse.advanced_search(corpus, far, financials, {"assets": "low"}, pool=1, cutoff=None).count() == 0
    assert lakehouse.advanced_search(corpus, far, financials, {"assets": "low"}, pool=1, cutoff=None, prefilter=True).count() == 1


def test_unknown_values_come_first(spark):
    held = spark.createDataFrame([("A", "m1", 1, 5.0), ("A", "m2", 1, None), ("A", "m3", 1, 9.0), (None, "m4", 1, 1.0)], "ticker string, manager_name string, shares long, value_usd double")
    mapping = spark.createDataFrame([("B",)], "ticker string")
    rows = lakehouse.ticker_exposure(held, mapping, 2).orderBy("rn").collect()
    assert [(r.manager_name, r.has_mapping) for r in rows] == [("m2", False), ("m3", False)]


def test_manager_prefix_is_case_sensitive(spark):
    held = spark.createDataFrame([("Alpha", 1.0), ("alpha", 9.0), ("Beta", 2.0), ("Able", 2.5)], "manager_name string, value_usd double")
    top = lakehouse.manager_totals(held, "A", 5)
    assert [(r.manager_name, r.total_value) for r in top.collect()] == [("Able", 2.5), ("Alpha", 1.0)]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_ticker_details(spark):
    view = spark.sql("SELECT 'A' AS Symbol, timestamp_ntz'2020-01-01' AS date, 1 AS cik UNION ALL SELECT 'A', timestamp_ntz'2021-01-01', 2")
    rows = [("m1", "A", 1, 5.0, "SOLE", "COM"), ("m1", "A", 2, 5.5, "SOLE", "COM"), ("m2", "A", 9, 99.0, "SOLE", "COM"), ("m1", "B", 1, 1.0, "SOLE", "COM")]
    held = spark.createDataFrame(rows, "manager_name string, ticker string, shares long, value_usd double, investment_discretion string, title_of_class string")
    filing, positions = lakehouse.ticker_details(view, held, "A", "2021-01-01")
    assert [r.cik for r in filing.collect()] == [2]
    assert [(r.manager_name, r.shares, r.value_usd) for r in positions.collect()] == [("m2", 9, 99.0), ("m1", 3, 10.5)]


def test_gains_and_previews(spark):
    cols = ", ".join(f"cast({v} as double) as f_{h}_day_return" for h, v in zip((1, 3, 5, 10, 20, 40, 60, 80, 100, 150, 252), ["1.05", "0.9", "1.0"] + ["null"] * 8))
    view = spark.sql(f"SELECT 'k' AS cik, 'Some text' AS item_1, '' AS item_2, cast(null as string) AS item_3, {cols}")
    rows = {r.horizon: (r.gain, r.is_up) for r in lakehouse.return_gains(view, ["cik"]).collect()}
    assert rows == {1: (5.0, True), 3: (-10.0, False), 5: (0.0, True)}
    assert [(r.item, r.preview) for r in lakehouse.item_previews(view, ["cik"]).collect()] == [("item_1", "Some text...")]


def test_load_share(spark):
    def share(*kinds):
        df = spark.createDataFrame([(k,) for k in kinds], "kind string")
        return load_percentages(load_counts(df)).first()

    row = share("read", "forwarded", "forwarded", "write", "disqualified")
    assert (row.n_reads, row.n_forwarded, row.primary_load, row.pool_load) == (3, 2, 50.0, 50.0)
    empty = share("disqualified")
    assert (empty.primary_load, empty.pool_load) == (5.0, 0.0)
    counts = spark.createDataFrame([(2, 1, 9, 0)], "n_reads long, n_writes long, n_forwarded long, n_disqualified long")
    capped = load_percentages(counts).first()
    assert capped.primary_load == pytest.approx(100 / 3, abs=1e-6) and capped.pool_load == pytest.approx(200 / 3, abs=1e-6)
