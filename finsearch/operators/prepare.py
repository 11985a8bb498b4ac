"""Preparing documents, holdings and company facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsearch.functions.finance import CONCEPT_COLUMNS
from finsearch.functions.text import html_to_text


SPAN = 64  # windows per span of a long text


def clean_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Raw pages with their plain text in place of the markup."""
    return pages.withColumn("text", html_to_text(F.col(html))).drop(html)


def chunk_text(docs: DataFrame, text: str = "text", size: int = 1500, overlap: int = 300) -> DataFrame:
    """Overlapping character windows with a 0-based ``chunk_index``; short texts make one chunk.

    Finding a position in UTF-8 text means walking to it, so long texts are first cut into spans of
    ``SPAN`` windows, and the windows out of their span.
    """
    step = size - overlap
    rest = [c for c in docs.columns if c != text]
    last = F.greatest(F.ceil((F.length(text) - F.lit(size)) / F.lit(step)), F.lit(0)).cast("int")
    spans = (
        docs.where(F.col(text).isNotNull())
        .withColumn("_last", last)
        .withColumn("_first", F.explode(F.sequence(F.lit(0), F.col("_last"), F.lit(SPAN))))
    )
    span = F.substring(F.col(text), F.col("_first") * step + 1, F.lit((SPAN - 1) * step + size))
    windows = spans.select(*rest, "_last", "_first", span.alias("_span")).withColumn(
        "chunk_index", F.explode(F.sequence(F.col("_first"), F.least(F.col("_first") + (SPAN - 1), F.col("_last"))))
    )
    start = (F.col("chunk_index") - F.col("_first")) * step + 1
    return windows.select(*rest, "chunk_index", F.substring(F.col("_span"), start, F.lit(size)).alias("chunk_text"))


def dedup_min_id(df: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """The row with the smallest id of every key, one of them if several have it.

    Only keys and ids are aggregated; the other columns are fetched for the chosen rows.
    """
    least = df.select(*keys, id_col).groupBy(*keys).agg(F.min(id_col).alias("_least")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_least")
    same = [df[k].eqNullSafe(least[f"_{k}"]) for k in keys]
    chosen = df.join(least, [*same, df[id_col].eqNullSafe(least["_least"])], "left_semi")
    return chosen.dropDuplicates([*keys, id_col]).select(*keys, *[c for c in df.columns if c not in keys])


def build_holdings(cover: DataFrame, info: DataFrame, on: str) -> DataFrame:
    """Cover pages joined to the positions they report."""
    return info.join(cover, on)


def backfill_ticker(holdings: DataFrame, cusip_map: DataFrame) -> DataFrame:
    """Tickers by CUSIP; positions without a match keep a null ticker."""
    return holdings.join(cusip_map.select("cusip", "ticker"), "cusip", "left")


def ticker_coverage(holdings: DataFrame) -> DataFrame:
    """Share of positions with a ticker."""
    return holdings.agg(
        F.count("*").alias("n_rows"),
        F.count("ticker").alias("n_with_ticker"),
        F.round(F.avg(F.col("ticker").isNotNull().cast("double")), 6).alias("coverage"),
    )


FACTS_SCHEMA = "map<string, map<string, struct<label: string, units: map<string, array<struct<{entry}>>>>>>"


def flatten_facts(nested: DataFrame, json: str = "facts", entry: str = "val double, fy bigint, fp string") -> DataFrame:
    """Company -> taxonomy -> tag -> unit -> values, one row per value."""
    schema = FACTS_SCHEMA.format(entry=entry)
    facts = nested.withColumn("f", F.from_json(json, schema, {"mode": "FAILFAST"})).drop(json)
    keys = [c for c in nested.columns if c != json]
    tags = facts.select(*keys, F.explode("f").alias("taxonomy", "tags")).select(*keys, "taxonomy", F.explode("tags").alias("tag", "body"))
    units = tags.select(*keys, "taxonomy", "tag", F.col("body.label").alias("label"), F.explode("body.units").alias("unit", "values"))
    return units.select(*keys, "taxonomy", "tag", "label", "unit", F.inline("values"))


def core_concepts(
    concepts: DataFrame, tickers: DataFrame, stocks: DataFrame, tags: Sequence[str] = tuple(CONCEPT_COLUMNS)
) -> DataFrame:
    """Concept rows of the core tags, for listed companies only."""
    listed = tickers.join(stocks.select(F.col("Symbol").alias("ticker")), "ticker", "left_semi").select("cik")
    return concepts.where(F.col("tag").isin(*tags)).join(listed, "cik", "left_semi")
