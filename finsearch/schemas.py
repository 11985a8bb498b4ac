"""Declared schemas of the operational, warehouse and lakehouse tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(19, 2)
NUMERIC = T.DecimalType(38, 10)
VECTOR = T.ArrayType(T.FloatType(), containsNull=False)


def _table(spec: str, key: str | None = None) -> T.StructType:
    """``name:type`` words to a StructType; the key column is not nullable."""
    kinds = {
        "long": T.LongType(),
        "int": T.IntegerType(),
        "short": T.ShortType(),
        "bool": T.BooleanType(),
        "str": T.StringType(),
        "double": T.DoubleType(),
        "numeric": NUMERIC,
        "money": MONEY,
        "price": T.DecimalType(10, 2),
        "date": T.DateType(),
        "ntz": T.TimestampNTZType(),
        "vector": VECTOR,
    }
    fields = []
    for word in spec.split():
        name, kind = word.split(":")
        fields.append(T.StructField(name, kinds[kind], nullable=name != key))
    return T.StructType(fields)


# Table and column names and types of the data model.
RETURN_HORIZONS = (1, 3, 5, 10, 20, 40, 60, 80, 100, 150, 252)
FILING_ITEMS = (
    "item_1 item_1A item_1B item_2 item_3 item_4 item_5 item_6 item_7 item_7A item_8 "
    "item_9 item_9A item_9B item_10 item_11 item_12 item_13 item_14 item_15"
).split()

FRAUD_LABELS = _table("transaction_id:long is_fraud:bool", "transaction_id")
CARDS = _table(
    "id:long client_id:int card_brand:str card_type:str card_number:str expires:str cvv:str "
    "has_chip:bool num_cards_issued:int credit_limit:money acct_open_date:date "
    "year_pin_last_changed:int card_on_dark_web:bool",
    "id",
)
MCC_CODES = _table("mcc:short description:str", "mcc")
TRANSACTIONS = _table(
    "id:long date:ntz client_id:int card_id:int amount:numeric use_chip:str merchant_id:int "
    "merchant_city:str merchant_state:str zip:str mcc:int errors:str "
    "transaction_description:str embedding:vector embedding_model:str",
    "id",
)
USERS = _table(
    "id:long current_age:int retirement_age:int birth_year:int birth_month:int gender:str "
    "address:str latitude:numeric longitude:numeric per_capita_income:money yearly_income:money "
    "total_debt:money credit_score:int num_credit_cards:int",
    "id",
)
DOCUMENT_CHUNKS = _table(
    "id:long ticker:str accession_number:str chunk_index:int chunk_text:str embedding:vector "
    "embedding_model:str embedding_hnsw:vector embedding_hnsw_model:str",
    "id",
)
COMPANY_MAPPING = _table("ticker:str security_name:str iceberg_company:str")
TRADES = _table("trade_id:long ticker:str shares:int price:price executed_at:ntz", "trade_id")
STOCK_METADATA = _table(
    "Nasdaq_Traded:str Symbol:str Security_Name:str Listing_Exchange:str Market_Category:str ETF:str "
    "Round_Lot_Size:double Test_Issue:str Financial_Status:str CQS_Symbol:str NASDAQ_Symbol:str "
    "NextShares:str iceberg_company_name:str"
)
COMPANY_CONCEPTS = _table(
    "cik:long taxonomy:str tag:str unit:str start_date:date end_date:date val:double accn:str "
    "fy:long fp:str form:str filed:date frame:str"
)
COMPANY_FACTS = _table(
    "cik:long taxonomy:str tag:str unit:str val:double fact_name:str label:str description:str"
)
COMPANY_TICKERS = _table("cik:long ticker:str title:str")
HOLDINGS = _table(
    "id:long manager_name:str ticker:str cusip:str shares:long value_usd:double put_call:str "
    "investment_discretion:str title_of_class:str period_of_report:int created_at:ntz"
)
FILINGS_10K = _table(
    "cik:str sic:str company:str date:ntz "
    + " ".join(f"{item}:str" for item in FILING_ITEMS)
    + " ret:double mkt_cap:double "
    + " ".join(f"f_{h}_day_return:double" for h in RETURN_HORIZONS)
)

TABLES: dict[str, T.StructType] = {
    "fraud_labels": FRAUD_LABELS,
    "cards": CARDS,
    "mcc_codes": MCC_CODES,
    "transactions_25_26": TRANSACTIONS,
    "users": USERS,
    "sec_document_chunks": DOCUMENT_CHUNKS,
    "sec_to_iceberg_mapping": COMPANY_MAPPING,
    "simulated_trades": TRADES,
    "stock_metadata": STOCK_METADATA,
    "company_concepts": COMPANY_CONCEPTS,
    "company_facts": COMPANY_FACTS,
    "company_tickers": COMPANY_TICKERS,
    "sec_13f_holdings": HOLDINGS,
    "sec_10k_iceberg": FILINGS_10K,
}
