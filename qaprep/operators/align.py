"""Alignment of tables by key, or of numbered lines by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zip_tables(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that both tables have, side by side."""
    return left.join(right, key)


def zip_by_position(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Lines of two texts side by side, as far as both go.

    Both sides hold `position` and `input`, as `read_numbered_lines` gives them.
    """
    sides = [t.select("position", F.col("input").alias(n)) for t, n in zip((left, right), names)]
    return zip_tables(*sides, key="position")


def append_column(
    df: DataFrame, derived: DataFrame, column: str, key: str = "row_id"
) -> DataFrame:
    """Add a column computed elsewhere; NULL where the other table has no row."""
    return df.join(derived.select(key, column), key, "left")
