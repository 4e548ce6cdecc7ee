"""Row filters of the curation, with the bounds included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of a curated table.
CURATED_COLUMNS = (
    "input_text",
    "target_text",
    "query",
    "title",
    "abstract_trimmed",
    "label",
    "oracle_text",
    "oracle_rougeL",
    "overlap",
    "label_tokens",
)


def label_len_ok(minimum: int = 5, maximum: int = 40) -> Column:
    """The label has a number of words within the bounds."""
    return F.col("label_tokens").between(minimum, maximum)


def overlap_ok(minimum: float = 0.45) -> Column:
    """The text has enough of the label's tokens."""
    return F.col("overlap") >= minimum


def oracle_score_ok(minimum: float = 0.15) -> Column:
    """The best sentence is close enough to the reference."""
    return F.col("oracle_rougeL") >= minimum


def oracle_text_ok() -> Column:
    """Some sentence was selected."""
    return F.length("oracle_text") > 0


def filter_label_len(df: DataFrame, minimum: int = 5, maximum: int = 40) -> DataFrame:
    return df.filter(label_len_ok(minimum, maximum))


def filter_overlap(df: DataFrame, minimum: float = 0.45) -> DataFrame:
    return df.filter(overlap_ok(minimum))


def filter_oracle(df: DataFrame, minimum: float = 0.15) -> DataFrame:
    return df.filter(oracle_score_ok(minimum) & oracle_text_ok())


def select_curated(df: DataFrame, *keys: str) -> DataFrame:
    """Keep the output columns, after the key columns the caller wants kept."""
    return df.select(*keys, *CURATED_COLUMNS)


def drop_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: rows before, after and dropped, and drops by first failing rule.

    The rules are tried in order; one aggregation counts them all.
    """
    passed = F.lit(True)
    failed = {}
    for name, rule in rules.items():
        holds = F.coalesce(rule, F.lit(False))
        failed[name] = F.count_if(passed & ~holds).alias(f"dropped_{name}")
        passed = passed & holds
    before, after = F.count(F.lit(1)), F.count_if(passed)
    return df.agg(
        before.alias("rows_before"),
        after.alias("rows_after"),
        (before - after).alias("dropped"),
        *failed.values(),
    )
