"""Lakehouse queries: search joined with filings, financials and holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsearch.functions.finance import bands
from finsearch.functions.text import route_query
from finsearch.plans import lakehouse
from finsearch.registry import query
from finsearch.registry.roles import CONCEPTS, CUTOFF, FISCAL_PERIOD, FISCAL_YEAR, Roles, with_roles
from finsearch.session import work_dir
from finsearch.sources.snapshots import refresh_snapshot

EDGES = (1.65e5, 3.3e5)
BANDS = {"assets": "high", "liabilities": "high"}
SYMBOL, FILED_ON = "Brand#4", "2010-01-04"

PIVOT = (
    "SELECT {key}, "
    + ", ".join(f"max(CASE WHEN tag = '{t}' THEN val END) AS {c}" for t, c in CONCEPTS.items())
    + f" FROM concepts JOIN tickers USING (cik) WHERE fy = {FISCAL_YEAR} AND fp = '{FISCAL_PERIOD}' GROUP BY {{key}}"
)
VALUE = "CAST(round(sum(CAST(value_usd AS DECIMAL(28,10))), 2) AS DOUBLE)"


def financials(r: Roles) -> DataFrame:
    return lakehouse.latest_financials(r.concepts(), r.tickers(), FISCAL_YEAR, FISCAL_PERIOD, CONCEPTS)


def per_company(r: Roles) -> DataFrame:
    """Financials of one company per ticker."""
    names = r.table("customer").select(F.col("c_custkey").alias("cik"), F.col("c_name").alias("ticker"))
    return lakehouse.latest_financials(r.concepts(), names, FISCAL_YEAR, FISCAL_PERIOD, CONCEPTS)


@query("latest_financials", with_roles("concepts", "tickers", body=PIVOT.format(key="ticker")))
def latest_financials(r: Roles) -> DataFrame:
    return financials(r)


@query(
    "financial_bands",
    with_roles(
        "concepts",
        more={"tickers": "SELECT c_custkey AS cik, c_name AS ticker FROM customer", "f": PIVOT.format(key="ticker")},
        body=f"SELECT * FROM f WHERE assets > {EDGES[1]} OR (liabilities BETWEEN {EDGES[0]} AND {EDGES[1]} AND equity < {EDGES[0]})",
    ),
)
def financial_bands(r: Roles) -> DataFrame:
    either = bands({"assets": "high", "cash": "none", "inventories": ""}, *EDGES) | bands(
        {"liabilities": "Medium", "equity": "low", "cash": "unknown"}, *EDGES
    )
    return per_company(r).where(either)


@query(
    "stock_10k_view",
    with_roles("view10k", body="SELECT Symbol, Security_Name, iceberg_company_name, cik, company, date, item_1, item_1A, f_1_day_return, f_252_day_return FROM view10k"),
)
def stock_10k_view(r: Roles) -> DataFrame:
    view = lakehouse.stock_10k_view(r.stocks(), r.filings())
    return view.select(
        "Symbol", "Security_Name", "iceberg_company_name", "cik", "company", "date", "item_1", "item_1A", "f_1_day_return", "f_252_day_return"
    )


@query(
    "security_lookup",
    with_roles(
        "view10k",
        body="""SELECT Symbol AS ticker, Security_Name AS security_name, iceberg_company_name AS iceberg_company,
        CAST(NULL AS VARCHAR) AS remote_item_1, date, f_1_day_return, f_40_day_return, f_100_day_return, cik,
        row_number() OVER (PARTITION BY Symbol ORDER BY date DESC NULLS FIRST, cik) AS rn FROM view10k QUALIFY rn <= 5""",
    ),
)
def security_lookup(r: Roles) -> DataFrame:
    view = lakehouse.stock_10k_view(r.stocks(), r.filings())
    return lakehouse.security_lookup(view, r.stocks().select("Symbol"))


@query(
    "ticker_filing",
    with_roles("view10k", body=f"SELECT * FROM view10k WHERE Symbol = '{SYMBOL}' AND date = TIMESTAMP '{FILED_ON}'"),
)
def ticker_filing(r: Roles) -> DataFrame:
    return lakehouse.ticker_filing(lakehouse.stock_10k_view(r.stocks(), r.filings()), SYMBOL, FILED_ON)


@query(
    "ticker_details",
    with_roles(
        "holdings",
        "view10k",
        body=f"""SELECT * FROM (SELECT 'filing' AS kind, cik AS key, company AS name, CAST(NULL AS BIGINT) AS shares, CAST(NULL AS DOUBLE) AS value_usd
        FROM view10k WHERE Symbol = '{SYMBOL}' AND date = TIMESTAMP '{FILED_ON}'
        UNION ALL SELECT 'position', concat_ws('/', ticker, investment_discretion, title_of_class), manager_name, CAST(sum(shares) AS BIGINT), {VALUE}
        FROM holdings WHERE ticker = '{SYMBOL}' GROUP BY manager_name, ticker, investment_discretion, title_of_class)""",
    ),
)
def ticker_details(r: Roles) -> DataFrame:
    view = lakehouse.stock_10k_view(r.stocks(), r.filings())
    filing, positions = lakehouse.ticker_details(view, r.holdings(), SYMBOL, FILED_ON)
    held = positions.select(
        F.lit("position").alias("kind"),
        F.concat_ws("/", "ticker", "investment_discretion", "title_of_class").alias("key"),
        F.col("manager_name").alias("name"),
        "shares",
        "value_usd",
    )
    filed = filing.select(F.lit("filing").alias("kind"), F.col("cik").alias("key"), F.col("company").alias("name"))
    return filed.unionByName(held, allowMissingColumns=True)


@query(
    "holdings_rollup",
    with_roles(
        "holdings",
        body=f"""SELECT manager_name, ticker, investment_discretion, title_of_class, CAST(sum(shares) AS BIGINT) AS shares,
        {VALUE} AS value_usd FROM holdings GROUP BY ALL""",
    ),
)
def holdings_rollup(r: Roles) -> DataFrame:
    return lakehouse.holdings_rollup(r.holdings())


@query(
    "manager_totals",
    with_roles(
        "holdings",
        body=f"""SELECT manager_name, {VALUE} AS total_value FROM holdings WHERE manager_name LIKE 'Supplier#00000000%'
        GROUP BY manager_name ORDER BY total_value DESC, manager_name LIMIT 20""",
    ),
)
def manager_totals(r: Roles) -> DataFrame:
    return lakehouse.manager_totals(r.holdings(), "Supplier#00000000")


@query(
    "ticker_exposure",
    with_roles(
        "holdings",
        "mapping",
        body="""SELECT ticker, manager_name, shares, value_usd,
        row_number() OVER (PARTITION BY ticker ORDER BY value_usd DESC NULLS FIRST, manager_name, shares) AS rn,
        ticker IN (SELECT ticker FROM mapping) AS has_mapping FROM holdings QUALIFY rn <= 5""",
    ),
)
def ticker_exposure(r: Roles) -> DataFrame:
    return lakehouse.ticker_exposure(r.holdings(), r.mapping())


@query(
    "mapping_flag",
    with_roles("mapping", body="SELECT Symbol AS ticker, Symbol IN (SELECT ticker FROM mapping) AS has_mapping FROM stocks"),
)
def mapping_flag(r: Roles) -> DataFrame:
    return lakehouse.mapping_flags(r.stocks().select(F.col("Symbol").alias("ticker")), r.mapping())


@query(
    "semantic_financials",
    with_roles(
        "far",
        "concepts",
        "tickers",
        more={
            "near": "SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn FROM far QUALIFY rn <= 5",
            "revenue": f"SELECT ticker, val AS revenue, CAST(fy AS DOUBLE) AS fy FROM concepts JOIN tickers USING (cik) WHERE tag = '1-URGENT' AND fp = '{FISCAL_PERIOD}'",
        },
        body="""SELECT query_id, n.id, distance, c.ticker, revenue, fy, CAST(NULL AS VARCHAR) AS remote_item_1
        FROM near n JOIN chunks c ON n.id = c.id LEFT JOIN revenue v ON c.ticker = v.ticker""",
    ),
)
def semantic_financials(r: Roles) -> DataFrame:
    return lakehouse.semantic_financials(r.chunks(), r.queries(), r.concepts(), r.tickers(), "1-URGENT", FISCAL_PERIOD, payload=r.texts())


ADVANCED = with_roles(
    "far",
    "concepts",
    "tickers",
    more={
        "near": f"""SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS place
            FROM far WHERE distance < {CUTOFF} QUALIFY place <= 50""",
        "f": PIVOT.format(key="ticker"),
    },
    body=f"""SELECT query_id, n.id, n.distance, c.ticker, chunk_index, chunk_text, assets, liabilities, equity, cash, inventories,
    row_number() OVER (PARTITION BY query_id ORDER BY n.distance, n.id) AS rn
    FROM near n JOIN chunks c ON n.id = c.id LEFT JOIN f ON c.ticker = f.ticker
    WHERE assets > {EDGES[1]} AND liabilities > {EDGES[1]} QUALIFY rn <= 24""",
)


def _advanced(r: Roles, values: DataFrame) -> DataFrame:
    return lakehouse.advanced_search(r.chunks(), r.queries(), values, BANDS, EDGES, cutoff=CUTOFF, payload=r.texts())


@query("advanced_search", ADVANCED)
def advanced_search(r: Roles) -> DataFrame:
    return _advanced(r, financials(r))


@query("advanced_search_snapshot", ADVANCED)
def advanced_search_snapshot(r: Roles) -> DataFrame:
    base = work_dir(r.spark, "refreshed")
    concepts = refresh_snapshot(r.concepts(), f"{base}/concepts")
    tickers = refresh_snapshot(r.tickers(), f"{base}/tickers")
    return _advanced(r, lakehouse.latest_financials(concepts, tickers, FISCAL_YEAR, FISCAL_PERIOD, CONCEPTS))


HORIZONS = (1, 3, 5, 10, 20, 40, 60, 80, 100, 150, 252)


@query(
    "return_gains",
    with_roles(
        "view10k",
        more={
            "long": " UNION ALL ".join(
                f"SELECT Symbol, cik, {h} AS horizon, round((f_{h}_day_return - 1.0::DOUBLE) * 100.0::DOUBLE, 2) + 0.0 AS gain FROM view10k" for h in HORIZONS
            )
        },
        body="SELECT Symbol, cik, horizon, gain, gain >= 0 AS is_up FROM long WHERE gain IS NOT NULL",
    ),
)
def return_gains(r: Roles) -> DataFrame:
    return lakehouse.return_gains(lakehouse.stock_10k_view(r.stocks(), r.filings()), ["Symbol", "cik"])


@query(
    "item_previews",
    with_roles(
        "filings",
        body="""SELECT cik, item, substring(body, 1, 60) || '...' AS preview FROM (SELECT cik, 'item_1' AS item, item_1 AS body FROM filings
        UNION ALL SELECT cik, 'item_1A', item_1A FROM filings) WHERE body IS NOT NULL AND body <> ''""",
    ),
)
def item_previews(r: Roles) -> DataFrame:
    return lakehouse.item_previews(r.filings(), ["cik"])


ASKED = """SELECT 'conversation' AS kind, conv_id || '/' || CAST(turn AS VARCHAR) AS key, text FROM conversations
UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation UNION ALL SELECT 'source', CAST(doc_id AS VARCHAR), upper(source) FROM documents"""


@query(
    "route_queries",
    f"""SELECT kind, key, CASE WHEN regexp_matches(text, '[ \\p{{Ll}}]') THEN 'semantic' ELSE 'ticker' END AS route FROM ({ASKED})""",
)
def route_queries(r: Roles) -> DataFrame:
    talks = r.table("conversations").select(
        F.lit("conversation").alias("kind"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "text"
    )
    nations = r.table("nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("text"))
    sources = r.table("documents").select(F.lit("source").alias("kind"), F.col("doc_id").cast("string").alias("key"), F.upper("source").alias("text"))
    return talks.unionByName(nations).unionByName(sources).select("kind", "key", route_query(F.col("text")).alias("route"))


@query(
    "company_profile",
    with_roles(
        "stocks",
        "filings",
        "concepts",
        "tickers",
        "holdings",
        more={
            "f": PIVOT.format(key="ticker"),
            "n": "SELECT company, count(*) AS n_filings FROM filings GROUP BY company",
            "m": f"SELECT ticker, manager_name, {VALUE} AS value_usd FROM holdings GROUP BY ticker, manager_name",
            "t": "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY value_usd DESC, manager_name) AS rn FROM m QUALIFY rn <= 3",
            "h": "SELECT ticker, string_agg(manager_name, ', ' ORDER BY rn) AS top_holders, max(value_usd) AS top_value FROM t GROUP BY ticker",
        },
        body="""SELECT Symbol, Security_Name, iceberg_company_name, coalesce(n_filings, 0) AS n_filings, assets, liabilities, equity, cash, inventories,
        top_holders, top_value FROM stocks s LEFT JOIN n ON n.company = iceberg_company_name LEFT JOIN f ON f.ticker = iceberg_company_name
        LEFT JOIN h ON h.ticker = Symbol""",
    ),
)
def company_profile(r: Roles) -> DataFrame:
    return lakehouse.company_profile(r.stocks(), r.filings(), financials(r), r.holdings())
