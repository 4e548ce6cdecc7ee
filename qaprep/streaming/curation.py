"""Curate files as they arrive.

Curation keeps no state between rows, so the batch job runs on a stream as it
is; the checkpoint folder makes each input file count once.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from qaprep.plans.curate import CLEAN, CurateOptions, curate

RAW_SCHEMA = "query string, title string, abstract string, label string"


def curate_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    options: CurateOptions = CLEAN,
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Append the curated rows of every new CSV file to a Parquet table.

    Columns are found by the header of the files that are there at the start;
    a file with another header fails instead of shifting its columns.
    """
    reader = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
    header = spark.read.options(**reader).csv(source).columns
    names = StructType.fromDDL(RAW_SCHEMA).fieldNames()
    missing = [c for c in names if c not in header]
    if missing:
        raise ValueError(f"the header of {source} lacks {', '.join(missing)}")
    raw = (
        spark.readStream.schema(StructType([StructField(c, StringType()) for c in header]))
        .options(**reader)
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(source, enforceSchema=False)
        .select(*names)
    )
    return (
        curate(raw, options)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
