"""Queries that join search results with filings, company financials and holdings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsearch.functions.finance import BAND_EDGES, CONCEPT_COLUMNS, bands, percent_gain
from finsearch.functions.text import preview
from finsearch.operators.ranking import small_side, top_k, with_payload
from finsearch.operators.vector_search import vector_search
from finsearch.schemas import FILING_ITEMS, RETURN_HORIZONS
from finsearch.session import written

EXACT_SUM = "decimal(38,2)"


def exact_sum(col: str) -> Column:
    """Sum of a money column without floating-point drift, whatever the order of the rows: rounded to cents last."""
    return F.sum(F.col(col).cast("decimal(28,10)")).cast(EXACT_SUM).cast("double")


def stock_10k_view(stocks: DataFrame, filings: DataFrame) -> DataFrame:
    """Listed securities joined to their filing history by company name."""
    names = stocks.select("Symbol", "Security_Name", "iceberg_company_name")
    return filings.join(names, F.col("iceberg_company_name") == F.col("company"))


def latest_financials(
    concepts: DataFrame,
    tickers: DataFrame,
    fy: int,
    fp: str,
    columns: Mapping[str, str] = CONCEPT_COLUMNS,
    mode: str = "max",
) -> DataFrame:
    """One row per ticker, one column per tag: the largest (or last filed) value of one fiscal period.

    Values are first reduced per company and then per ticker, so the join sees one row per company.
    """
    rows = concepts.where((F.col("fy") == fy) & (F.col("fp") == fp) & F.col("tag").isin(*columns))
    if mode == "max":
        per_company = rows.groupBy("cik").agg(*[F.max(F.when(F.col("tag") == t, F.col("val"))).alias(c) for t, c in columns.items()])
        return per_company.join(tickers.select("cik", "ticker"), "cik").groupBy("ticker").agg(
            *[F.max(c).alias(c) for c in columns.values()]
        )
    if mode != "latest":
        raise ValueError(f"unknown mode {mode!r}")
    newest = [F.max(F.when(F.col("tag") == t, F.struct("filed", "val"))).alias(c) for t, c in columns.items()]
    per_company = rows.groupBy("cik").agg(*newest).join(tickers.select("cik", "ticker"), "cik")
    return per_company.groupBy("ticker").agg(*[F.max(c)["val"].alias(c) for c in columns.values()])


def semantic_financials(
    corpus: DataFrame, queries: DataFrame, concepts: DataFrame, tickers: DataFrame, tag: str, fp: str, k: int = 5,
    payload: DataFrame | None = None,
) -> DataFrame:
    """Nearest k chunks per query with every matching value of one tag; no match keeps the chunk."""
    queries = written(queries, "queries")
    bound = k * queries.count()
    near = vector_search(corpus, queries, k, None).drop("rn")
    chunks = written(with_payload(near, corpus if payload is None else payload, ["ticker"], bound), "near-chunks")
    # only the companies of these few chunks are looked up
    asked = small_side(chunks.select("ticker").distinct(), bound)
    companies = tickers.select("cik", "ticker").join(asked, "ticker", "left_semi")
    values = concepts.where((F.col("tag") == tag) & (F.col("fp") == fp)).select("cik", "val", "fy")
    revenue = values.join(companies, "cik").select(
        "ticker", F.col("val").alias("revenue"), F.col("fy").cast("double").alias("fy")
    )
    return (
        chunks.join(revenue, "ticker", "left")
        .withColumn("remote_item_1", F.lit(None).cast("string"))
        .orderBy("query_id", F.desc_nulls_last("revenue"), "id", "fy")
    )


def advanced_search(
    corpus: DataFrame,
    queries: DataFrame,
    financials: DataFrame,
    band_words: Mapping[str, str | None],
    edges: tuple[float, float] = BAND_EDGES,
    pool: int = 50,
    k: int = 24,
    cutoff: float | None = 0.5,
    prefilter: bool = False,
    columns: Sequence[str] = ("ticker", "chunk_index", "chunk_text"),
    payload: DataFrame | None = None,
) -> DataFrame:
    """Nearest chunks with pivoted financials under band filters.

    The pool is cut *before* the filter, so fewer than k rows may remain; ``prefilter`` narrows
    the corpus to companies inside the bands first.
    """
    queries = written(queries, "queries")
    condition = bands(band_words, *edges)
    if prefilter and condition is not None:
        corpus = corpus.join(financials.where(condition).select("ticker"), "ticker", "left_semi")
    near = vector_search(corpus, queries, pool, cutoff).drop("rn")
    chunks = written(with_payload(near, corpus if payload is None else payload, columns, pool * queries.count()), "pool")
    # only the companies of the pool are pivoted
    asked = small_side(chunks.select("ticker").distinct(), pool * queries.count())
    joined = chunks.join(financials.join(asked, "ticker", "left_semi"), "ticker", "left")
    if condition is not None:
        joined = joined.where(condition)
    return top_k(joined, ["query_id"], [F.asc("distance"), F.asc("id")], k)


def security_lookup(view: DataFrame, symbols: DataFrame, k: int = 5) -> DataFrame:
    """The k newest filings of each asked symbol with three forward returns."""
    rows = view.join(symbols, "Symbol", "left_semi").select(
        F.col("Symbol").alias("ticker"),
        F.col("Security_Name").alias("security_name"),
        F.col("iceberg_company_name").alias("iceberg_company"),
        F.lit(None).cast("string").alias("remote_item_1"),
        "date",
        "f_1_day_return",
        "f_40_day_return",
        "f_100_day_return",
        "cik",
    )
    return top_k(rows, ["ticker"], [F.desc_nulls_first("date"), F.asc("cik")], k)


def ticker_filing(view: DataFrame, symbol: str, date: str) -> DataFrame:
    """All filing columns for one symbol and date."""
    return view.where((F.col("Symbol") == symbol) & (F.col("date") == F.lit(date).cast("timestamp_ntz")))


def holdings_rollup(holdings: DataFrame) -> DataFrame:
    """Shares and value per manager, ticker, discretion and class."""
    return holdings.groupBy("manager_name", "ticker", "investment_discretion", "title_of_class").agg(
        F.sum("shares").alias("shares"), exact_sum("value_usd").alias("value_usd")
    )


def ticker_details(view: DataFrame, holdings: DataFrame, symbol: str, date: str) -> tuple[DataFrame, DataFrame]:
    """Filing of one symbol and date, and its positions, largest value first."""
    positions = holdings_rollup(holdings.where(F.col("ticker") == symbol))
    return ticker_filing(view, symbol, date), positions.orderBy(F.desc_nulls_first("value_usd"), "manager_name")


def manager_totals(holdings: DataFrame, prefix: str, k: int = 20) -> DataFrame:
    """Largest managers by value among those whose name starts with a prefix."""
    return (
        holdings.where(F.col("manager_name").startswith(prefix))
        .groupBy("manager_name")
        .agg(exact_sum("value_usd").alias("total_value"))
        .orderBy(F.desc("total_value"), "manager_name")
        .limit(k)
    )


def mapping_flags(tickers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Whether each ticker has a mapped filing history."""
    known = mapping.select("ticker").distinct().withColumn("has_mapping", F.lit(True))
    return tickers.join(known, "ticker", "left").withColumn("has_mapping", F.coalesce("has_mapping", F.lit(False)))


def ticker_exposure(holdings: DataFrame, mapping: DataFrame, k: int = 5) -> DataFrame:
    """Largest k positions per ticker with the mapping flag; unknown values come first."""
    order = [F.desc_nulls_first("value_usd"), F.asc("manager_name"), F.asc("shares")]
    rows = holdings.where(F.col("ticker").isNotNull()).select("ticker", "manager_name", "shares", "value_usd")
    return mapping_flags(top_k(rows, ["ticker"], order, k), mapping)


def return_gains(view: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Forward returns in long form: horizon, percent gain and direction; missing ones are left out."""
    wide = view.select(*keys, *[percent_gain(F.col(f"f_{h}_day_return")).alias(str(h)) for h in RETURN_HORIZONS])
    long = wide.unpivot(list(keys), [str(h) for h in RETURN_HORIZONS], "horizon", "gain")
    return long.where(F.col("gain").isNotNull()).select(
        *keys, F.col("horizon").cast("int").alias("horizon"), "gain", (F.col("gain") >= 0).alias("is_up")
    )


def item_previews(filings: DataFrame, keys: Sequence[str], length: int = 60) -> DataFrame:
    """Previews of the filing items that have text. Only the previews are unpivoted, not the texts."""
    items = [c for c in FILING_ITEMS if c in filings.columns]
    short = filings.select(*keys, *[F.when(F.col(c) != "", preview(F.col(c), length)).alias(c) for c in items])
    return short.unpivot(list(keys), items, "item", "preview").where(F.col("preview").isNotNull())


def company_profile(
    stocks: DataFrame, filings: DataFrame, financials: DataFrame, holdings: DataFrame, k: int = 3
) -> DataFrame:
    """One row per listed security: name, number of filings, financials and largest holders."""
    n_filings = filings.groupBy(F.col("company").alias("iceberg_company_name")).agg(F.count("*").alias("n_filings"))
    per_manager = holdings.groupBy("ticker", "manager_name").agg(exact_sum("value_usd").alias("value_usd"))
    top = top_k(per_manager, ["ticker"], [F.desc("value_usd"), F.asc("manager_name")], k)
    names = F.array_sort(F.collect_list(F.struct("rn", "manager_name")))
    holders = top.groupBy(F.col("ticker").alias("Symbol")).agg(
        F.concat_ws(", ", F.transform(names, lambda r: r["manager_name"])).alias("top_holders"),
        F.max("value_usd").alias("top_value"),
    )
    return (
        stocks.select("Symbol", "Security_Name", "iceberg_company_name")
        .join(n_filings, "iceberg_company_name", "left")
        .join(financials.withColumnRenamed("ticker", "iceberg_company_name"), "iceberg_company_name", "left")
        .join(holders, "Symbol", "left")
        .withColumn("n_filings", F.coalesce("n_filings", F.lit(0)).cast("long"))
    )
