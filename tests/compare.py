"""Comparison of a registered query with its SQL counterpart."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, bool):
        return str(value)
    return "NULL" if value is None else str(value)


def canonical(columns, rows):
    """Rows with columns in name order, in an order of their own."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(connection, df, sql):
    """Return an empty text, or what differs."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = canonical(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    actual = canonical(df.columns, [tuple(r) for r in df.collect()])
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    wrong = [(a, e) for a, e in zip(actual, expected, strict=True) if a != e]
    return f"{len(wrong)} rows differ, first: {wrong[0]}" if wrong else ""
