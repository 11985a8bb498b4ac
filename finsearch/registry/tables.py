"""Loading, writing, refreshing and auditing tables; preparation of documents and facts."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finsearch.functions.text import ENTITIES
from finsearch.operators import prepare
from finsearch.operators.load import load_counts as count_load
from finsearch.operators.load import load_percentages
from finsearch.plans.lakehouse import exact_sum
from finsearch.registry import query
from finsearch.registry.roles import CONCEPTS, FISCAL_PERIOD, FISCAL_YEAR, Roles, with_roles
from finsearch.schemas import TABLES
from finsearch.session import work_dir
from finsearch.sources import audit, sinks, snapshots
from finsearch.sources import tables as sources

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NOW = datetime(2024, 2, 1)


# --- sources and sinks ---------------------------------------------------------------------------


def _as_declared(df: DataFrame, name: str) -> DataFrame:
    """Role columns in the declared order and type, absent ones null."""
    have = set(df.columns)
    return df.select(
        [
            F.col(f.name) if f.name in have and isinstance(f.dataType, T.ArrayType)
            else (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].fields
        ]
    )


# checksums of the loaded tables, and the same over the given ones
CSV_SUMS = {
    "fraud_labels": ("int(is_fraud)", "sum(toxic)", "labels"),
    "cards": ("int(card_on_dark_web)", "sum(CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END)", "supplier"),
    "mcc_codes": ("mcc", "sum(mcc)", "mcc_codes"),
    "users": ("yearly_income", "sum(CAST(c_acctbal AS DECIMAL(19,2)) * 10)", "customer"),
    "transactions_25_26": ("amount", "sum(CAST(value AS DECIMAL(19,2)))", "events"),
    "sec_document_chunks": ("length(chunk_text)", "sum(length(text))", "documents"),
    "sec_to_iceberg_mapping": ("length(security_name)", "sum(length(n_name) + 5)", "nation WHERE 'src' || n_nationkey IN (SELECT source FROM documents)"),
}
PARQUET_SUMS = {
    "stock_metadata": ("length(Security_Name)", "sum(length(n_name) + 5)", "nation"),
    "company_concepts": ("cast(val AS decimal(19,2))", "sum(CAST(o_totalprice AS DECIMAL(19,2)))", "orders"),
    "company_tickers": ("cik", "sum(c_custkey)", "customer"),
    "sec_13f_holdings": ("cast(value_usd AS decimal(19,2))", "sum(CAST(value_usd AS DECIMAL(19,2)))", "holdings"),
    "sec_10k_iceberg": ("length(item_1)", "sum(length(text))", "documents"),
}


CSV_ROWS_PER_FILE = 5_000  # texts with line breaks make a file one task


def _register(r: Roles, names: Iterable[str]) -> None:
    """Write the named tables and register them as views with declared types.

    Operational tables travel as CSV text, warehouse tables as Parquet. Texts hold line breaks, so the files
    of the chunks do not split; they are kept small instead.
    """
    base = work_dir(r.spark, "load")
    money = F.concat(F.lit("$"), F.format_number(F.col("yearly_income"), 2))
    frames: dict[str, Callable[[], DataFrame]] = {
        "fraud_labels": r.fraud_labels,
        "cards": r.cards,
        "mcc_codes": r.mcc_codes,
        "users": r.users,
        "transactions_25_26": r.transactions,
        "sec_document_chunks": r.chunks,
        "sec_to_iceberg_mapping": r.mapping,
        "stock_metadata": r.stocks,
        "company_concepts": r.concepts,
        "company_tickers": r.tickers,
        "sec_13f_holdings": lambda: r.holdings().withColumn("cusip", F.col("cusip").cast("string")),
        "sec_10k_iceberg": r.filings,
    }
    catalog = {}
    for name in names:
        df = _as_declared(frames[name](), name)
        catalog[name] = (f"{base}/{name}", "parquet" if name in PARQUET_SUMS else "csv")
        if name in PARQUET_SUMS:
            df.write.parquet(f"{base}/{name}")
            continue
        if name == "users":
            df = df.withColumn("yearly_income", F.regexp_replace(money, r"\$-", r"-\$"))
        for field in df.schema.fields:
            if isinstance(field.dataType, T.ArrayType):
                df = df.withColumn(field.name, F.to_json(field.name))
        df.write.option("maxRecordsPerFile", CSV_ROWS_PER_FILE).csv(f"{base}/{name}", header=True, escape='"')
    sources.register_sources(r.spark, catalog, multiline=["sec_document_chunks"])


@query(
    "load_counts",
    with_roles(
        "mcc_codes",
        "holdings",
        body=" UNION ALL ".join(
            f"SELECT '{n}' AS table_name, count(*) AS n_rows, CAST({total} AS DOUBLE) AS checksum FROM {table}"
            for n, (_, total, table) in {**CSV_SUMS, **PARQUET_SUMS}.items()
        ),
    ),
)
def load_counts(r: Roles) -> DataFrame:
    _register(r, [*CSV_SUMS, *PARQUET_SUMS])
    return r.spark.sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, count(*) AS n_rows, cast(sum({expr}) AS double) AS checksum FROM {n}"
            for n, (expr, _, _) in {**CSV_SUMS, **PARQUET_SUMS}.items()
        )
    )


@query(
    "federated_join",
    with_roles(
        "chunks",
        "concepts",
        "tickers",
        body=f"""SELECT ticker, n_chunks, n_companies, total FROM (SELECT ticker, count(*) AS n_chunks FROM chunks GROUP BY ticker)
        JOIN (SELECT ticker, count(DISTINCT cik) AS n_companies, CAST(round(sum(CAST(val AS DECIMAL(28,10))), 2) AS DOUBLE) AS total
        FROM concepts JOIN tickers USING (cik) WHERE fy = {FISCAL_YEAR} AND fp = '{FISCAL_PERIOD}' GROUP BY ticker) USING (ticker)""",
    ),
)
def federated_join(r: Roles) -> DataFrame:
    """One SQL statement over operational and warehouse views, which are all that is loaded."""
    _register(r, ["sec_document_chunks", "company_concepts", "company_tickers"])
    return r.spark.sql(
        f"""SELECT ticker, n_chunks, n_companies, total
        FROM (SELECT ticker, count(*) AS n_chunks FROM sec_document_chunks GROUP BY ticker)
        JOIN (SELECT ticker, count(DISTINCT cik) AS n_companies, cast(cast(sum(cast(val AS decimal(28,10))) AS decimal(38,2)) AS double) AS total
              FROM company_concepts JOIN company_tickers USING (cik)
              WHERE fy = {FISCAL_YEAR} AND fp = '{FISCAL_PERIOD}' GROUP BY ticker) USING (ticker)"""
    )


@query(
    "load_evolving",
    """SELECT event_id, user_id, event_type, value, CASE WHEN event_type NOT IN ('view', 'click') THEN props END AS props FROM events""",
)
def load_evolving(r: Roles) -> DataFrame:
    base = work_dir(r.spark, "evolving")
    events = r.table("events").select("event_id", "user_id", "event_type", "value", "props")
    early = F.col("event_type").isin("view", "click")
    events.where(early).drop("props").write.parquet(f"{base}/first")
    events.where(~early).write.parquet(f"{base}/second")
    return sources.load_evolving(r.spark, [f"{base}/first", f"{base}/second"])


@query(
    "load_reconciled",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' OR o_orderpriority <> '5-LOW' THEN o_totalprice END AS o_totalprice,
    CAST(o_orderdate AS DATE) AS o_orderdate, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority,
    (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '5-LOW') AS n_rejected FROM orders""",
)
def load_reconciled(r: Roles) -> DataFrame:
    """Two loads of the orders that disagree: keys and days as numbers in one, prices as text with gaps and a further column in the other."""
    base = work_dir(r.spark, "reconciled")
    orders = r.table("orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority", "o_orderstatus")
    filled = F.col("o_orderstatus") == "F"
    day = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    orders.where(filled).select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), "o_totalprice", day.alias("o_orderdate")).write.parquet(f"{base}/first")
    price = F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    orders.where(~filled).select("o_orderkey", "o_custkey", price.alias("o_totalprice"), "o_orderdate", "o_orderpriority").write.parquet(f"{base}/second")
    rows, rejected = sources.load_reconciled(r.spark, [f"{base}/first", f"{base}/second"], {"o_totalprice": "double"})
    return rows.crossJoin(F.broadcast(rejected.agg(F.count("*").alias("n_rejected"))))


CONCEPT_SUMS = "count(*) AS n_rows, CAST(round(sum(CAST(val AS DECIMAL(28,10))), 2) AS DOUBLE) AS total, count(DISTINCT cik) AS n_companies"


@query("clustered_scan", with_roles("concepts", body=f"SELECT fy, fp, {CONCEPT_SUMS} FROM concepts GROUP BY fy, fp"))
def clustered_scan(r: Roles) -> DataFrame:
    table = sinks.build_clustered(r.concepts(), work_dir(r.spark, "clustered"), ["cik"], ["fy"])
    return table.groupBy(F.col("fy").cast("long").alias("fy"), "fp").agg(
        F.count("*").alias("n_rows"), exact_sum("val").alias("total"), F.countDistinct("cik").alias("n_companies")
    )


@query("snapshot_refresh", with_roles("concepts", body=f"SELECT fy, {CONCEPT_SUMS} FROM concepts GROUP BY fy"))
def snapshot_refresh(r: Roles) -> DataFrame:
    """A partial first version, then a refresh with all rows; the view shows the second."""
    base = work_dir(r.spark, "snapshot")
    concepts = r.concepts()
    snapshots.refresh_snapshot(concepts.where(F.col("fp") == FISCAL_PERIOD), base, view="refreshed_concepts")
    snapshots.refresh_snapshot(concepts, base, view="refreshed_concepts")
    return (
        r.spark.table("refreshed_concepts")
        .groupBy("fy")
        .agg(F.count("*").alias("n_rows"), exact_sum("val").alias("total"), F.countDistinct("cik").alias("n_companies"))
    )


@query(
    "snapshot_delta",
    with_roles(
        "concepts",
        body=f"""SELECT fy, {CONCEPT_SUMS}, bool_or(fy = {FISCAL_YEAR} AND fp = '{FISCAL_PERIOD}') AS rewritten FROM concepts GROUP BY fy""",
    ),
)
def snapshot_delta(r: Roles) -> DataFrame:
    """A first version without the reports of one year's period, then a refresh with all rows, which copies that year only."""
    base = work_dir(r.spark, "delta")
    concepts, year = r.concepts(), F.col("fy")
    snapshots.refresh_delta(concepts.where(~((year == FISCAL_YEAR) & (F.col("fp") == FISCAL_PERIOD))), base, year)
    current = snapshots.refresh_delta(concepts, base, year)
    sums = current.groupBy("fy").agg(F.count("*").alias("n_rows"), exact_sum("val").alias("total"), F.countDistinct("cik").alias("n_companies"))
    first = snapshots.read_manifest(r.spark, base, 1).select(F.col("folder").alias("first"), "part")
    manifest = snapshots.read_manifest(r.spark, base).join(first, "part", "left")
    files = manifest.select(F.col("part").cast("long").alias("fy"), (~F.col("folder").eqNullSafe(F.col("first"))).alias("rewritten"))
    return sums.join(files, "fy")


@query(
    "hot_concepts",
    with_roles("concepts", body=f"SELECT cik, tag, val, fy, fp FROM concepts WHERE fy = {FISCAL_YEAR} AND fp = '{FISCAL_PERIOD}'"),
)
def hot_concepts(r: Roles) -> DataFrame:
    hot = (F.col("fy") == FISCAL_YEAR) & (F.col("fp") == FISCAL_PERIOD)
    table = sinks.hot_subset(r.concepts(), hot, "cik", work_dir(r.spark, "hot"))
    return table.where(hot).select("cik", "tag", "val", F.col("fy").cast("long").alias("fy"), "fp")


def trades(r: Roles) -> DataFrame:
    return r.holdings().select(
        "ticker", "shares", F.col("value_usd").alias("price"), "investment_discretion"
    )


@query(
    "append_trades",
    with_roles(
        "holdings",
        body="""SELECT ticker, count(*) AS n_trades, count(*) AS n_ids, CAST(sum(shares) AS BIGINT) AS shares,
        CAST(sum(CAST(value_usd AS DECIMAL(10,2))) AS DOUBLE) AS total, TIMESTAMP '2024-02-01' AS last_at FROM holdings GROUP BY ticker""",
    ),
)
def append_trades(r: Roles) -> DataFrame:
    path = work_dir(r.spark, "trades")
    returned = F.col("investment_discretion") == "R"
    sinks.append_trades(trades(r).where(returned), path, NOW)
    stored = sinks.append_trades(trades(r).where(~returned), path, NOW)
    return stored.groupBy("ticker").agg(
        F.count("*").alias("n_trades"),
        F.countDistinct("trade_id").alias("n_ids"),
        F.sum("shares").alias("shares"),
        F.sum("price").cast("double").alias("total"),
        F.max("executed_at").alias("last_at"),
    )


@query(
    "delete_keys",
    "SELECT event_id, user_id, event_type, value FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def delete_keys(r: Roles) -> DataFrame:
    keys = r.fraud_labels().where("is_fraud").select(F.col("transaction_id").alias("event_id"))
    return sinks.delete_keys(r.table("events").select("event_id", "user_id", "event_type", "value"), keys, "event_id")


EXPECTED = {"region": 5, "nation": 25}


@query(
    "row_count_audit",
    "SELECT *, coalesce(n_rows = expected_rows, true) AS ok FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n_rows, CAST({EXPECTED.get(n, 'NULL')} AS BIGINT) AS expected_rows FROM {n}" for n in NAMES
    )
    + ")",
)
def row_count_audit(r: Roles) -> DataFrame:
    return audit.audit_counts({n: r.table(n) for n in NAMES}, EXPECTED)


KEYS = {
    "customer": ["c_custkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "labels": ["doc_id"],
}
PARTIAL = f"year(o_orderdate) = {FISCAL_YEAR} AND o_orderstatus = '{FISCAL_PERIOD}'"


def _key_sql(name: str, table: str, keys: list[str], where: str = "true") -> str:
    cols = ", ".join(keys)
    return f"""SELECT '{name}' AS key_name, count(*) AS n_bad_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_bad_rows
        FROM (SELECT count(*) AS n FROM {table} WHERE {where} GROUP BY {cols} HAVING count(*) > 1)"""


@query(
    "key_audit",
    " UNION ALL ".join([_key_sql(t, t, k) for t, k in KEYS.items()] + [_key_sql("hot orders", "orders", ["o_custkey"], PARTIAL)]),
)
def key_audit(r: Roles) -> DataFrame:
    parts = [audit.audit_key_summary(t, r.table(t), k) for t, k in KEYS.items()]
    parts.append(audit.audit_key_summary("hot orders", r.table("orders"), ["o_custkey"], F.expr(PARTIAL)))
    return reduce(DataFrame.unionByName, parts)


# --- preparation ---------------------------------------------------------------------------------


def _html_sql() -> str:
    stripped = "html"
    for pattern in (r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        stripped = f"regexp_replace({stripped}, '{pattern}', ' ', 'g')"
    # numbers first, each distinct reference once; then names; the ampersand last, so that nothing is decoded twice
    number = "CASE WHEN ref LIKE '&#x%' THEN CAST('0x' || substr(ref, 4, length(ref) - 4) AS BIGINT) ELSE CAST(substr(ref, 3, length(ref) - 3) AS BIGINT) END"
    numbers = f"""(SELECT list(struct_pack(ref := ref, c := CASE WHEN n BETWEEN 1 AND 1114111 AND n NOT BETWEEN 55296 AND 57343 THEN chr(CAST(n AS INTEGER)) ELSE chr(65533) END))
        FROM (SELECT ref, {number} AS n FROM (SELECT DISTINCT unnest(regexp_extract_all(t, '&#(?:x[0-9A-Fa-f]{{1,12}}|[0-9]{{1,12}});')) AS ref)))"""
    text = f"list_reduce(list_prepend(struct_pack(ref := '', c := t), coalesce({numbers}, [])), lambda a, b: struct_pack(ref := '', c := replace(a.c, b.ref, b.c))).c"
    for name, value in ENTITIES.items():
        literal = value.replace("'", "''")
        text = text if name == "amp" else f"replace({text}, '&{name};', '{literal}')"
    text = f"replace({text}, '&amp;', '&')"
    return rf"SELECT page_id, url, trim(regexp_replace({text}, '[\s\x{{00A0}}]+', ' ', 'g')) AS text FROM (SELECT page_id, url, {stripped} AS t FROM pages)"


@query("html_text", _html_sql())
def html_text(r: Roles) -> DataFrame:
    return prepare.clean_pages(r.table("pages"))


@query(
    "chunk_docs",
    """SELECT doc_id, lang, source, i AS chunk_index, substring(text, CAST(i * 1200 + 1 AS BIGINT), 1500) AS chunk_text
    FROM (SELECT *, unnest(range(0, 1 + CAST(greatest(ceil((length(text) - 1500) / 1200), 0) AS BIGINT))) AS i FROM documents)""",
)
def chunk_docs(r: Roles) -> DataFrame:
    docs = r.table("documents").select("doc_id", "lang", "source", "text")
    return prepare.chunk_text(docs).withColumn("chunk_index", F.col("chunk_index").cast("long"))


ROW_ID = """md5(concat_ws('|', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR,
    round(l_quantity * 100)::BIGINT::VARCHAR, round(l_extendedprice * 100)::BIGINT::VARCHAR, l_shipdate::DATE::VARCHAR))"""


@query(
    "dedup_chunks",
    f"""SELECT l_orderkey AS accession_number, l_linenumber AS chunk_index, min({ROW_ID}) AS id,
    arg_min(l_partkey, {ROW_ID}) AS l_partkey, arg_min(l_extendedprice, {ROW_ID}) AS l_extendedprice FROM lineitem GROUP BY ALL""",
)
def dedup_chunks(r: Roles) -> DataFrame:
    def cents(name: str):
        return F.round(F.col(name) * 100).cast("long").cast("string")

    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    parts += [cents("l_quantity"), cents("l_extendedprice"), F.col("l_shipdate").cast("date").cast("string")]
    rows = r.table("lineitem").select(
        F.col("l_orderkey").alias("accession_number"),
        F.col("l_linenumber").alias("chunk_index"),
        F.md5(F.concat_ws("|", *parts)).alias("id"),
        "l_partkey",
        "l_extendedprice",
    )
    return prepare.dedup_min_id(rows, ["accession_number", "chunk_index"])


@query(
    "holdings_build",
    """SELECT l_orderkey AS filing, o_custkey AS manager, o_orderstatus AS status, l_partkey AS cusip, CAST(l_quantity AS BIGINT) AS shares,
    l_extendedprice AS value_usd FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def holdings_build(r: Roles) -> DataFrame:
    cover = r.table("orders").select(
        F.col("o_orderkey").alias("filing"), F.col("o_custkey").alias("manager"), F.col("o_orderstatus").alias("status")
    )
    info = r.table("lineitem").select(
        F.col("l_orderkey").alias("filing"),
        F.col("l_partkey").alias("cusip"),
        F.col("l_quantity").cast("long").alias("shares"),
        F.col("l_extendedprice").alias("value_usd"),
    )
    return prepare.build_holdings(cover, info, "filing")


CUSIPS = "SELECT c_custkey AS cusip, c_name AS ticker FROM customer"
POSITIONS = "SELECT l_partkey AS cusip, CAST(l_quantity AS BIGINT) AS shares, l_extendedprice AS value_usd FROM lineitem"


def _backfilled(r: Roles) -> DataFrame:
    cusips = r.table("customer").select(F.col("c_custkey").alias("cusip"), F.col("c_name").alias("ticker"))
    return prepare.backfill_ticker(r.holdings().select("cusip", "shares", "value_usd"), cusips)


@query("ticker_backfill", f"SELECT * FROM ({POSITIONS}) LEFT JOIN ({CUSIPS}) USING (cusip)")
def ticker_backfill(r: Roles) -> DataFrame:
    return _backfilled(r)


@query(
    "ticker_coverage",
    f"""SELECT count(*) AS n_rows, count(ticker) AS n_with_ticker, round(count(ticker) / count(*), 6) AS coverage
    FROM ({POSITIONS}) LEFT JOIN ({CUSIPS}) USING (cusip)""",
)
def ticker_coverage(r: Roles) -> DataFrame:
    return prepare.ticker_coverage(_backfilled(r))


@query(
    "facts_flatten",
    """SELECT l_orderkey AS cik, o_orderstatus AS taxonomy, o_orderpriority AS tag, upper(o_orderpriority) AS label, l_returnflag AS unit,
    l_extendedprice AS val, year(l_shipdate) AS fy, l_linestatus AS fp FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def facts_flatten(r: Roles) -> DataFrame:
    """Orders and lines nested to one JSON text per order, then flattened again."""
    value = F.struct(
        F.col("l_extendedprice").alias("val"), F.year("l_shipdate").cast("long").alias("fy"), F.col("l_linestatus").alias("fp")
    )
    units = (
        r.table("lineitem")
        .repartition("l_orderkey")  # one shuffle for both groupings and the join
        .groupBy("l_orderkey", "l_returnflag")
        .agg(F.collect_list(value).alias("values"))
        .groupBy("l_orderkey")
        .agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "values"))).alias("units"))
    )
    body = F.struct(F.upper("o_orderpriority").alias("label"), "units")
    nested = units.join(r.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("cik"),
        F.to_json(F.create_map("o_orderstatus", F.create_map("o_orderpriority", body))).alias("facts"),
    )
    return prepare.flatten_facts(nested)


@query(
    "core_concepts",
    with_roles(
        "concepts",
        "tickers",
        body=f"""SELECT * FROM concepts WHERE tag IN ({', '.join(f"'{t}'" for t in CONCEPTS)})
        AND cik IN (SELECT cik FROM tickers WHERE ticker IN (SELECT source FROM documents))""",
    ),
)
def core_concepts(r: Roles) -> DataFrame:
    listed = r.table("documents").select(F.col("source").alias("Symbol"))
    return prepare.core_concepts(r.concepts(), r.tickers(), listed, tuple(CONCEPTS))


# --- load ----------------------------------------------------------------------------------------

LOAD = """count(*) FILTER (kind IN ('read', 'forwarded')) AS n_reads, count(*) FILTER (kind = 'write') AS n_writes,
    count(*) FILTER (kind = 'forwarded') AS n_forwarded, count(*) FILTER (kind = 'disqualified') AS n_disqualified"""
SHARE = """CASE WHEN n_reads + n_writes > 0 THEN round((n_writes + n_reads - least(n_reads, n_forwarded)) * 100.0::DOUBLE / (n_reads + n_writes), 6)
    ELSE 5.0::DOUBLE END AS primary_load,
    CASE WHEN n_reads + n_writes > 0 THEN round(least(n_reads, n_forwarded) * 100.0::DOUBLE / (n_reads + n_writes), 6) ELSE 0.0::DOUBLE END AS pool_load"""


@query("load_share", with_roles("requests", body=f"SELECT *, {SHARE} FROM (SELECT {LOAD} FROM requests)"))
def load_share(r: Roles) -> DataFrame:
    return load_percentages(count_load(r.requests()))


@query(
    "load_share_by_day",
    with_roles(
        "requests",
        body=f"SELECT *, {SHARE} FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, {LOAD} FROM requests GROUP BY 1)",
    ),
)
def load_share_by_day(r: Roles) -> DataFrame:
    per_day = r.requests().groupBy(F.window("ts", "1 day").alias("w"))
    return load_percentages(count_load(per_day)).withColumn("window_start", F.col("w.start").cast("timestamp_ntz")).drop("w")
