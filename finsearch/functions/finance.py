"""Financial expressions: bands, gains, pivoted concepts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reporting tags and the columns they fill, band edges.
CONCEPT_COLUMNS = {
    "Assets": "assets",
    "Liabilities": "liabilities",
    "StockholdersEquity": "equity",
    "CashAndCashEquivalentsAtCarryingValue": "cash",
    "Inventories": "inventories",
    "Revenues": "revenues",
    "NetIncomeLoss": "net_income",
    "OperatingIncomeLoss": "operating_income",
    "GrossProfit": "gross_profit",
    "NetCashProvidedByUsedInOperatingActivities": "operating_cash_flow",
}
BAND_EDGES = (1e8, 1e9)


def band(col: Column, word: str | None, low: float = BAND_EDGES[0], high: float = BAND_EDGES[1]) -> Column | None:
    """The predicate of one band word; ``None`` for words that set no filter."""
    return {"low": col < low, "medium": col.between(low, high), "high": col > high}.get((word or "none").lower())


def bands(words: Mapping[str, str | None], low: float = BAND_EDGES[0], high: float = BAND_EDGES[1]) -> Column | None:
    """All given bands together, or ``None`` when no filter is set."""
    parts = [band(F.col(name), word, low, high) for name, word in words.items()]
    parts = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, parts) if parts else None


def percent_gain(value: Column, digits: int = 2) -> Column:
    """A forward return factor as percent gain."""
    return F.round((value - F.lit(1.0)) * F.lit(100.0), digits) + F.lit(0.0)
