"""Run a named query and its SQL form on the same tables and compare all rows."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# type names that count as equal on both sides
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences found: columns, types, number of rows, values."""
    relation = con.sql(sql)
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    ours = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    problems = []
    if sorted(ours) != sorted(theirs):
        return [f"columns differ: {sorted(ours)} and {sorted(theirs)}"]
    for name, kind in ours.items():
        if KINDS.get(kind, kind) != theirs[name]:
            problems.append(f"type of {name}: {kind} and {theirs[name]}")
    names = sorted(ours)
    left = sorted((tuple(_plain(row[n]) for n in names) for row in spark_df.collect()), key=repr)
    index = [relation.columns.index(n) for n in names]
    right = sorted((tuple(_plain(row[i]) for i in index) for row in relation.fetchall()), key=repr)
    if len(left) != len(right):
        problems.append(f"rows: {len(left)} and {len(right)}")
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        problems.append(f"{len(wrong)} rows differ, first {str(wrong[0])[:600]}")
    if not left:
        problems.append("no rows")
    return problems
