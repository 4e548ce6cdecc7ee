"""Table sinks. Each writes a folder with one file per task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS_SCHEMA = "run string, metric string, value double"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header that brings quotes, line breaks and spaces back intact."""
    df.write.mode(mode).csv(
        path,
        header=True,
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_jsonl(
    df: DataFrame, path: str, partition: str | None = None, mode: str = "errorifexists"
) -> None:
    """JSON lines, in one folder per value of the partition column if given."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).json(path)


def write_metrics(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Metrics rows as JSON objects; NULL metrics are left out."""
    df.write.mode(mode).json(path)


def write_parquet(
    df: DataFrame, path: str, partition: Iterable[str] = (), mode: str = "errorifexists"
) -> None:
    """Prepared table, optionally partitioned (by `split`, say)."""
    df.write.mode(mode).partitionBy(*partition).parquet(path)


def append_metrics(df: DataFrame, path: str, commit: str | None = None) -> None:
    """Append a wide row per run to the log as `(run, metric, value)` rows.

    Values are stored under their metric's name, so runs with other metrics can
    share one log. Rows of one `commit` lie in a folder of their own, which a
    repeated append replaces; without a commit each append adds rows.
    """
    names = [c for c in df.columns if c != "run"]
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
            for c in names
        ]
    )
    rows = df.select("run", F.inline(pairs)).write
    if commit is None:
        rows.mode("append").parquet(path)
    else:
        folder = f"commit-{hashlib.sha256(commit.encode()).hexdigest()}"
        rows.mode("overwrite").parquet(f"{path.rstrip('/')}/{folder}")


def read_metrics_log(spark: SparkSession, path: str) -> DataFrame:
    """The log that `append_metrics` writes."""
    return spark.read.schema(METRICS_SCHEMA).option("recursiveFileLookup", True).parquet(path)
