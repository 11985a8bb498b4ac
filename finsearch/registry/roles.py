"""The data model's tables, derived from the given ones: once as DataFrames, once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsearch.functions.text import STOPWORDS, TOKEN_GAP
from finsearch.operators.text_index import TextIndex, build_text_index, save_text_index
from finsearch.schemas import RETURN_HORIZONS
from finsearch.session import work_dir

# Query texts, concept columns.
N_CODES = 30  # merchant codes in use; the table of codes knows 25 of them
QUERIES = (("q1", "er nd", 7), ("q2", "tion ing", 11), ("q3", "ou", 23))
CONCEPTS = {
    "1-URGENT": "assets",
    "2-HIGH": "liabilities",
    "3-MEDIUM": "equity",
    "4-NOT SPECIFIED": "cash",
    "5-LOW": "inventories",
}
FISCAL_YEAR, FISCAL_PERIOD = 1997, "F"
CUTOFF = 0.9
THRESHOLDS = (0.78, 0.80, 0.825)
THRESHOLD = 0.80


class Roles:
    """Reads the given tables of one folder and presents them under the names of the data model."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def chunks(self) -> DataFrame:
        docs, vectors = self.table("documents"), self.table("embeddings")
        return _chunk_columns(docs.join(vectors, F.col("vec_id") == F.col("doc_id"), "left"), "embedding")

    def texts(self) -> DataFrame:
        """The chunks without their vectors."""
        return _chunk_columns(self.table("documents"))

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")

    def queries(self) -> DataFrame:
        """Every benchmark text as a query, and a few short ones, since texts that long are found where they are quoted only."""
        rows = ", ".join(f"('{q}', '{t}', {v}L)" for q, t, v in QUERIES)
        asked = self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(query_id, text, vec_id)")
        texts = self.table("benchmark").select(F.concat(F.lit("b"), "item_id").alias("query_id"), "text", F.col("item_id").alias("vec_id"))
        return self.table("embeddings").join(asked.unionByName(texts), "vec_id").select("query_id", "text", F.col("embedding").alias("vector"))

    def query_batch(self) -> DataFrame:
        """Every benchmark text as a query."""
        vectors = self.table("embeddings")
        return self.table("benchmark").join(vectors, F.col("vec_id") == F.col("item_id")).select(
            F.col("item_id").alias("query_id"), "text", F.col("embedding").alias("vector")
        )

    def n_vectors(self) -> int:
        """Number of vectors, from the file footers; the events share them in turn."""
        return self.table("embeddings").count()

    def transactions(self) -> DataFrame:
        return self.transactions_of(self.table("events"))

    def transactions_of(self, events: DataFrame) -> DataFrame:
        """Events, stored or arriving, as transactions."""
        vectors = self.table("embeddings")
        numbered = events.withColumn("vec_id", F.col("event_id") % self.n_vectors())
        return numbered.join(vectors, "vec_id").select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("date"),
            F.col("user_id").alias("client_id"),
            F.col("user_id").alias("card_id"),
            F.col("value").alias("amount"),
            (F.col("event_id") % N_CODES).cast("int").alias("mcc"),
            F.col("event_type").alias("merchant_city"),
            F.concat("event_type", F.lit(" of "), F.col("value").cast("string")).alias("transaction_description"),
            "embedding",
        )

    def labelled(self) -> DataFrame:
        """Transactions that have a label."""
        return self.transactions().join(self.fraud_labels(), F.col("id") == F.col("transaction_id"), "left_semi")

    def fraud_labels(self) -> DataFrame:
        return self.table("labels").select(F.col("doc_id").alias("transaction_id"), (F.col("toxic") == 1).alias("is_fraud"))

    def cards(self) -> DataFrame:
        """Cards for the clients that have a supplier's key; most others have none."""
        return self.table("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.concat(F.lit("Brand "), F.col("s_nationkey").cast("string")).alias("card_brand"),
            F.when(F.col("s_acctbal") >= 5000, F.lit("Credit")).otherwise(F.lit("Debit")).alias("card_type"),
            (F.col("s_acctbal") < 0).alias("card_on_dark_web"),
        )

    def mcc_codes(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("short").alias("mcc"), F.col("n_name").alias("description"))

    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.round(F.col("c_acctbal") * 10, 2).cast("decimal(19,2)").alias("yearly_income"),
            (F.lit(300) + F.floor(F.abs("c_acctbal")) % 550).cast("int").alias("credit_score"),
        )

    def tickers(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("cik"), F.concat(F.lit("src"), F.col("c_nationkey").cast("string")).alias("ticker")
        )

    def concepts(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("cik"),
            F.col("o_orderpriority").alias("tag"),
            F.col("o_totalprice").alias("val"),
            F.year("o_orderdate").cast("long").alias("fy"),
            F.col("o_orderstatus").alias("fp"),
            F.col("o_orderdate").alias("filed"),
        )

    def stocks(self) -> DataFrame:
        return self.table("nation").select(
            F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 1).cast("string")).alias("Symbol"),
            F.concat("n_name", F.lit(" Corp")).alias("Security_Name"),
            F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("iceberg_company_name"),
        )

    def mapping(self) -> DataFrame:
        """Securities whose company has filings."""
        known = self.table("documents").select(F.col("source").alias("iceberg_company_name")).distinct()
        return self.stocks().join(known, "iceberg_company_name", "left_semi").select(
            F.col("Symbol").alias("ticker"), F.col("Security_Name").alias("security_name"), F.col("iceberg_company_name").alias("iceberg_company")
        )

    def filings(self) -> DataFrame:
        returns = [
            (F.lit(1.0) + (F.col("doc_id") % (20 + h) - 10) / F.lit(100.0)).alias(f"f_{h}_day_return") for h in RETURN_HORIZONS
        ]
        start = F.lit("2010-01-01").cast("timestamp_ntz")
        second = self.table("benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("item_1A"))
        return self.table("documents").join(second, "doc_id", "left").select(
            F.col("doc_id").cast("string").alias("cik"),
            F.col("source").alias("company"),
            (start + F.make_dt_interval(days=F.col("doc_id").cast("int"))).alias("date"),
            F.col("text").alias("item_1"),
            "item_1A",
            *returns,
        )

    def holdings(self) -> DataFrame:
        lines, managers, parts = self.table("lineitem"), self.table("supplier"), self.table("part")
        return (
            lines.join(managers, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("s_name").alias("manager_name"),
                F.col("p_brand").alias("ticker"),
                F.col("l_partkey").alias("cusip"),
                F.col("l_quantity").cast("long").alias("shares"),
                F.col("l_extendedprice").alias("value_usd"),
                F.col("l_returnflag").alias("investment_discretion"),
                F.col("l_linestatus").alias("title_of_class"),
            )
        )

    def requests(self) -> DataFrame:
        return self.table("events").select("event_id", "ts", request_kind().alias("kind"))

    def text_index(self, positions: bool = False) -> TextIndex:
        """The saved index of the chunks, built once per session and state of the files."""
        key = (self.spark.sparkContext.applicationId, positions, *_stamps(self.spark, self.table("documents").inputFiles()))
        if key not in _INDEXES:
            index = build_text_index(self.texts(), "id", "chunk_text", buckets=8, positions=positions)
            _INDEXES[key] = save_text_index(index, work_dir(self.spark, "text-index"))
        return _INDEXES[key]


def _stamps(spark: SparkSession, files: list[str]) -> list[tuple[str, int, int]]:
    """Files with their size and time of change: a table that is written again under its name is another one."""
    out = []
    for name in sorted(files):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return out


def request_kind() -> Column:
    """What an event stands for in the load log."""
    return (
        F.when(F.col("event_type") == "view", "read")
        .when(F.col("event_type") == "click", "forwarded")
        .when(F.col("event_type") == "error", "disqualified")
        .otherwise("write")
    )


def _chunk_columns(docs: DataFrame, *more: str) -> DataFrame:
    form = F.when(F.col("doc_id") % 2 == 0, F.lit("-13F-")).otherwise(F.lit("-10K-"))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("ticker"),
        F.concat("lang", form, F.col("doc_id").cast("string")).alias("accession_number"),
        F.lit(0).alias("chunk_index"),
        F.col("text").alias("chunk_text"),
        *more,
    )


_INDEXES: dict[tuple, TextIndex] = {}

# --- the same tables as SQL common table expressions ---------------------------------------------

_RETURNS = ", ".join(f"1.0::DOUBLE + (doc_id % {20 + h} - 10) / 100.0::DOUBLE AS f_{h}_day_return" for h in RETURN_HORIZONS)
_STOP = " ".join(STOPWORDS)

SQL = {
    "chunks": """SELECT doc_id AS id, source AS ticker,
        lang || CASE WHEN doc_id % 2 = 0 THEN '-13F-' ELSE '-10K-' END || CAST(doc_id AS VARCHAR) AS accession_number,
        0 AS chunk_index, text AS chunk_text, embedding::DOUBLE[] AS embedding
        FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "queries": """SELECT query_id, text, embedding::DOUBLE[] AS vector FROM (VALUES """
    + ", ".join(f"('{q}', '{t}', {v})" for q, t, v in QUERIES)
    + """ UNION ALL SELECT 'b' || item_id, text, item_id FROM benchmark) AS t(query_id, text, vec_id) JOIN embeddings USING (vec_id)""",
    "query_batch": """SELECT item_id AS query_id, text, embedding::DOUBLE[] AS vector
        FROM benchmark JOIN embeddings ON vec_id = item_id""",
    "transactions": f"""SELECT event_id AS id, ts AS date, user_id AS client_id, user_id AS card_id, value AS amount,
        CAST(event_id % {N_CODES} AS INTEGER) AS mcc, event_type AS merchant_city,
        event_type || ' of ' || CAST(value AS VARCHAR) AS transaction_description, vec_id
        FROM events JOIN (SELECT vec_id FROM embeddings) AS held ON vec_id = event_id % (SELECT count(*) FROM embeddings)""",
    "fraud_labels": "SELECT doc_id AS transaction_id, toxic = 1 AS is_fraud FROM labels",
    "cards": """SELECT s_suppkey AS id, 'Brand ' || CAST(s_nationkey AS VARCHAR) AS card_brand,
        CASE WHEN s_acctbal >= 5000 THEN 'Credit' ELSE 'Debit' END AS card_type, s_acctbal < 0 AS card_on_dark_web FROM supplier""",
    "mcc_codes": "SELECT n_nationkey AS mcc, n_name AS description FROM nation",
    "users": """SELECT c_custkey AS id, round(c_acctbal * 10, 2) AS yearly_income,
        CAST(300 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 550 AS INTEGER) AS credit_score FROM customer""",
    "tickers": "SELECT c_custkey AS cik, 'src' || CAST(c_nationkey AS VARCHAR) AS ticker FROM customer",
    "concepts": """SELECT o_custkey AS cik, o_orderpriority AS tag, o_totalprice AS val, year(o_orderdate) AS fy,
        o_orderstatus AS fp, o_orderdate AS filed FROM orders""",
    "stocks": """SELECT 'Brand#' || CAST(n_nationkey + 1 AS VARCHAR) AS Symbol, n_name || ' Corp' AS Security_Name,
        'src' || CAST(n_nationkey AS VARCHAR) AS iceberg_company_name FROM nation""",
    "filings": f"""SELECT CAST(doc_id AS VARCHAR) AS cik, source AS company,
        TIMESTAMP '2010-01-01' + to_days(CAST(doc_id AS INTEGER)) AS date, d.text AS item_1,
        b.text AS item_1A, {_RETURNS} FROM documents d LEFT JOIN benchmark b ON item_id = doc_id""",
    "mapping": """SELECT Symbol AS ticker FROM stocks WHERE iceberg_company_name IN (SELECT source FROM documents)""",
    "view10k": "SELECT * FROM stocks JOIN filings ON iceberg_company_name = company",
    "holdings": """SELECT s_name AS manager_name, p_brand AS ticker, l_partkey AS cusip,
        CAST(l_quantity AS BIGINT) AS shares, l_extendedprice AS value_usd, l_returnflag AS investment_discretion,
        l_linestatus AS title_of_class FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""",
    "requests": """SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'forwarded'
        WHEN 'error' THEN 'disqualified' ELSE 'write' END AS kind FROM events""",
    # text search
    "stop": f"SELECT unnest(string_split('{_STOP}', ' ')) AS term",
    "tokens": f"""SELECT id, pos, term FROM (SELECT id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term
        FROM (SELECT id, regexp_split_to_array(lower(chunk_text), '{TOKEN_GAP}') AS w FROM chunks))
        WHERE term <> '' AND term NOT IN (SELECT term FROM stop)""",
    "lengths": "SELECT c.id, count(t.term) AS doc_len FROM chunks c LEFT JOIN tokens t ON c.id = t.id GROUP BY c.id",
    "stats": "SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM lengths",
    "postings": "SELECT term, id, count(*) AS tf, min(pos) AS first_pos FROM tokens GROUP BY term, id",
    "vocabulary": "SELECT term, count(*) AS df FROM postings GROUP BY term",
    "query_terms": f"""SELECT DISTINCT query_id, term FROM (SELECT query_id,
        unnest(regexp_split_to_array(lower(text), '{TOKEN_GAP}')) AS term FROM queries)
        WHERE term <> '' AND term NOT IN (SELECT term FROM stop)""",
    "weighted": """SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n_terms, df,
        ln(1.0::DOUBLE + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf
        FROM query_terms LEFT JOIN vocabulary USING (term) CROSS JOIN stats""",
    "hits": """SELECT query_id, id, term, tf, first_pos, n_terms, idf,
        idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len)) AS part
        FROM weighted JOIN postings USING (term) JOIN lengths USING (id) CROSS JOIN stats""",
    "matched": """SELECT query_id, id, round(sum(part), 9) + 0.0 AS score,
        round(1.0::DOUBLE / (1.0::DOUBLE + (max(first_pos) - min(first_pos)) / greatest(n_terms - 1, 1)::DOUBLE), 9) + 0.0 AS near_score
        FROM hits GROUP BY query_id, id, n_terms HAVING count(*) = n_terms""",
    # vector search
    "far": """SELECT query_id, id, round(list_cosine_distance(embedding, vector), 9) + 0.0 AS distance
        FROM chunks CROSS JOIN queries WHERE embedding IS NOT NULL""",
    "vector_far": """SELECT query_id, vec_id AS id, round(list_cosine_distance(embedding::DOUBLE[], vector), 9) + 0.0 AS distance
        FROM embeddings CROSS JOIN query_batch""",
    # fraud
    "apart": """SELECT a.vec_id, b.vec_id AS other_id, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) + 0.0 AS distance
        FROM embeddings a, embeddings b""",
    "labelled": "SELECT * FROM transactions WHERE id IN (SELECT transaction_id FROM fraud_labels)",
    "known": """SELECT t.id, t.date, t.amount, t.transaction_description, t.merchant_city, card_brand, card_type, card_on_dark_web,
        m.description AS mcc_description FROM transactions t JOIN cards c ON t.card_id = c.id JOIN mcc_codes m ON t.mcc = m.mcc""",
}

_NEEDS = {
    "mapping": ["stocks"],
    "view10k": ["stocks", "filings"],
    "tokens": ["stop", "chunks"],
    "lengths": ["chunks", "tokens"],
    "stats": ["lengths"],
    "postings": ["tokens"],
    "vocabulary": ["postings"],
    "query_terms": ["queries", "stop"],
    "weighted": ["query_terms", "vocabulary", "stats"],
    "hits": ["weighted", "postings", "lengths", "stats"],
    "matched": ["hits"],
    "far": ["chunks", "queries"],
    "vector_far": ["query_batch"],
    "labelled": ["transactions", "fraud_labels"],
    "known": ["transactions", "cards", "mcc_codes"],
}


def with_roles(*names: str, body: str, more: dict[str, str] | None = None, replace: dict[str, str] | None = None) -> str:
    """A statement over the named roles: their expressions, then ``more``, then the body."""
    texts = {**SQL, **(replace or {})}
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    heavy = {"apart", "tokens", "postings", "lengths", "vocabulary", "hits", "far", "vector_far", "matched", "transactions"}
    parts = [f"{n} AS {'MATERIALIZED ' if n in heavy else ''}({texts[n]})" for n in ordered]
    parts += [f"{n} AS ({t})" for n, t in (more or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
