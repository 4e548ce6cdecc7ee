"""Table sources."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window as W

from qaprep.functions.prompts import column_prompt
from qaprep.functions.text import clean_text, strip
from qaprep.session import scratch_path
from qaprep.sources.quoted_csv import read_quoted_csv

METRICS_FILE = "eval_metrics.json"


def require_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """The column names as a list; all of them must be columns of df."""
    wanted = list(columns)
    absent = sorted(set(wanted).difference(df.columns))
    if absent:
        raise ValueError(f"the table has no column {', '.join(absent)}; it has {', '.join(df.columns)}")
    return wanted


def file_path() -> Column:
    """The path of a row's file as it was named, with `%XX` of its URI resolved.

    A `+` is no space in a path, unlike in a form.
    """
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def in_path(df: DataFrame, part: str) -> DataFrame:
    """Rows of files whose whole path, folders included, contains `part`.

    Letter case does not count and no character is special. Spark skips the
    other files before reading them.
    """
    return df.where(F.contains(F.lower(file_path()), F.lit(part.lower())))


def name_glob(part: str = "", suffix: str = "") -> str:
    """File-name pattern for a name part and a suffix, in any letter case."""

    def any_case(text: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in text)

    return f"*{any_case(part)}*{any_case(suffix)}" if part else f"*{any_case(suffix)}"


def read_table_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str,
    required: Iterable[str] = (),
    path_filter: str | None = None,
    multi_line: bool = True,
    split: bool = False,
) -> DataFrame:
    """CSV with a header row; quoted fields may hold quotes and line breaks.

    Line breaks inside fields mean that one file is read by one task, unless
    `split` is set: then quotes are counted first and large files are split, see
    `read_quoted_csv`. Where no field holds a line break give `multi_line=False`, and
    large files are split. The schema names the columns to expect; the header
    decides which of them are there.
    """
    options = {"header": True, "multiLine": multi_line, "quote": '"', "escape": '"'}
    if path_filter:
        options |= {"pathGlobFilter": path_filter, "recursiveFileLookup": True}
    header = spark.read.options(**options).csv(path).columns
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    types = {f.name: f.dataType for f in wanted}
    found = StructType([StructField(c, types.get(c, StringType())) for c in header])
    # Files whose header differs from the first one's fail instead of shifting.
    if split:
        df = read_quoted_csv(spark, path, header, found, options)
    else:
        df = spark.read.schema(found).options(**options).csv(path, enforceSchema=False)
    require_columns(df, required)
    return df.select(*[c for c in header if c in types])


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Fill absent columns, and NULLs of present ones, with a default."""

    def filled(name: str, default: object) -> Column:
        value = F.lit(default)
        return F.coalesce(F.col(name), value) if name in df.columns else value

    return df.withColumns({c: filled(c, d) for c, d in defaults.items()})


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files as `input`, stripped, blank ones left out."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("input"))
    return lines.filter(F.length("input") > 0)


def read_numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines as `read_lines` gives them, with their `position` from 0.

    Files come in the order of their names, so a folder written from a sorted
    table keeps its order. Each part of a file counts its own lines; how many
    come before a part is summed over a table with one row per part. The lines
    are written once, so that both steps see the same parts.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    lines = spark.read.text(path).select(strip(F.col("value")).alias("input"), place.alias("part"))
    saved = scratch_path(spark, "numbered")
    # Within a part these ids grow by one with each line.
    lines.filter(F.length("input") > 0).withColumn("id", F.monotonically_increasing_id()).write.parquet(saved)
    rows = spark.read.parquet(saved)
    parts = rows.groupBy("part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", (earlier - F.col("first")).alias("offset"))
    return rows.join(offsets, "part").select((F.col("id") + F.col("offset")).alias("position"), "input")


def _joined(name: str) -> Column:
    """A JSON field that holds a text or a list of texts, as one text."""
    value = F.variant_get(F.col("item"), f"$.{name}", "string")
    parts = F.try_variant_get(F.col("item"), f"$.{name}", "array<string>")
    return F.coalesce(F.array_join(parts, " "), value, F.lit(""))


def read_summ_jsonl(
    spark: SparkSession, path: str | list[str], path_filter: str | None = None
) -> DataFrame:
    """JSON lines of `source` and `target`; an absent key gives empty text."""
    options = {}
    if path_filter:
        options = {"pathGlobFilter": path_filter, "recursiveFileLookup": True}
    lines = spark.read.options(**options).text(path)
    parsed = lines.select(F.parse_json("value").alias("item"))
    return parsed.select(
        _joined("source").alias("source"), _joined("target").alias("target")
    )


def stack_splits(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One table of all splits, with the split's name as a column."""
    named = [df.withColumn("split", F.lit(split)) for split, df in parts.items()]
    stacked = named[0]
    for part in named[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def read_presplit(
    spark: SparkSession,
    paths: Mapping[str, str | list[str]],
    schema: StructType | str,
    multi_line: bool = True,
    split: bool = False,
) -> DataFrame:
    """CSV files that are already split, as one table with a `split` column.

    `multi_line` and `split` are those of `read_table_csv`.
    """
    options = {"multi_line": multi_line, "split": split}
    return stack_splits({name: read_table_csv(spark, path, schema, **options) for name, path in paths.items()})


def _canonical(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, bool]]:
    """Each path as its file system names it, and whether it exists there."""
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = hadoop_path.getFileSystem(conf)
        found.append((system.makeQualified(hadoop_path).toString(), system.exists(hadoop_path)))
    return found


def _no_glob(path: str) -> str:
    """A path to read as it is; Spark takes these characters for patterns."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def read_run_metrics(spark: SparkSession, run_dirs: Sequence[str]) -> DataFrame:
    """Metrics of each run folder as `(run, metric, value)` rows.

    Folders may have any name. A run without a metrics file keeps one row with
    NULL metric and value, and a folder named twice has its rows twice.
    """
    files = _canonical(spark, [f"{d.rstrip('/')}/{METRICS_FILE}" for d in run_dirs])
    named = [(d.rstrip("/"), file) for d, (file, _) in zip(run_dirs, files)]
    runs = spark.createDataFrame(named, "run string, path string")
    existing = sorted({_no_glob(file) for file, there in files if there})
    if not existing:
        empty = F.lit(None)
        return runs.select("run", empty.cast("string").alias("metric"), empty.cast("double").alias("value"))
    # Files as a table: their paths come back in the form of the listing.
    bodies = spark.read.format("binaryFile").load(existing)
    metrics = F.from_json(F.decode("content", "UTF-8"), "map<string,double>")
    long = bodies.select("path", F.explode(metrics).alias("metric", "value"))
    return runs.join(long, "path", "left").select("run", "metric", "value")


def load_pairs(
    df: DataFrame, text_columns: Sequence[str], label_column: str
) -> DataFrame:
    """`input_text` and `target_text`: kept if both are there, else built."""
    if {"input_text", "target_text"} <= set(df.columns):
        return df.select("input_text", "target_text")
    require_columns(df, [*text_columns, label_column])
    return df.select(
        column_prompt(df, text_columns).alias("input_text"),
        clean_text(F.col(label_column)).alias("target_text"),
    )
