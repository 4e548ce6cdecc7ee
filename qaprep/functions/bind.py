"""Evaluate a column once and use it several times inside an expression.

Spark evaluates an expression again for every element when the body of a
higher-order function refers to it. A lambda variable is evaluated once, so
expensive values are passed into such bodies through one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns, so that later filters on them do not repeat them.

    Catalyst moves a filter below a plain projection by copying the computed
    expressions into it, and they then run twice. It does not move a filter
    below a generator, so the columns are produced as a one-row generator.
    """
    kept = [c for c in df.columns if c not in columns]
    fields = [value.alias(name) for name, value in columns.items()]
    return df.select(*kept, F.inline(F.array(F.struct(*fields))))
