"""Views of the given tables in the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaprep.functions.text import clean_text, split_sentences
from qaprep.operators.running import number_rows
from qaprep.plans.curate import CurateOptions, curate

RUNS = 20
SEEDS = 3
FIRST_SEED = 13
HOUR_SECONDS = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-answering rows from neighbouring turns of conversations.

    The join is on conversation and turn, which together are unique, so a long
    conversation spreads over many tasks.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("asked")
    )
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("abstract")
    )
    pairs = asked.join(answered, ["conv_id", "turn"]).withColumns(
        {
            "_asked": split_sentences(clean_text(F.col("asked"))),
            "_answer": split_sentences(clean_text(F.col("abstract"))),
        }
    )
    conv, first = F.col("conv_id"), F.get("_asked", F.lit(0))
    named = F.when(conv % 3 == 0, first).otherwise(
        F.array_join(F.slice("_answer", 1, 2), " ")
    )
    label = F.concat(
        F.lit('"'),
        F.coalesce(named, F.lit("")),
        F.when(conv % 5 == 0, " .").otherwise(""),
        F.lit('"'),
    )
    return pairs.select(
        (conv * 1000 + F.col("turn")).alias("row_id"),
        F.replace("asked", F.lit(", "), F.lit(",\u00a0")).alias("query"),
        F.when(conv % 2 == 0, first).alias("title"),
        "abstract",
        label.alias("label"),
    )


def curated_qa(spark: SparkSession, sf_dir: str, stem: bool = False) -> DataFrame:
    """Curated rows with their key."""
    return curate(raw_qa(spark, sf_dir), CurateOptions(stem=stem), ("row_id",))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of three runs: exact, partial and poor predictions."""
    sentences = split_sentences(F.col("abstract_trimmed"))
    start = F.when(F.col("row_id") % 3 == 1, 1).otherwise(2)
    return curated_qa(spark, sf_dir).select(
        "row_id",
        F.concat(F.lit("base_seed"), FIRST_SEED + F.col("row_id") % SEEDS).alias("run"),
        F.col("label").alias("predicted"),
        F.array_join(F.slice(sentences, start, F.lit(2)), " ").alias("reference"),
    )


def _seconds() -> Column:
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts")
    return micros / 1_000_000


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log rows: run, number within the run, time and value."""
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % RUNS).cast("int").alias("run"),
        "event_id",
        _seconds().alias("ts_s"),
        "value",
    )
    hour = F.floor(F.col("ts_s") / HOUR_SECONDS).cast("bigint")
    order = [F.col("ts_s"), F.col("event_id")]
    return number_rows(events, ["run"], order, hour, "number")


def eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return log.select("run", F.col("number").alias("step"), F.col("value").alias("metric"))


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step appears twice, except the single step 0."""
    step = F.floor(F.col("number") / 2).cast("bigint")
    log = _log(spark, sf_dir)
    return log.select("run", step.alias("step"), "ts_s", F.col("value").alias("loss"))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "events").groupBy((F.col("user_id") % RUNS).cast("int").alias("run"))
    return values.agg(
        F.avg("value").alias("latency"), (F.max("value") / 500).alias("rougeL")
    )


def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(run, metric, value)` with runs named by configuration and seed."""
    name = F.concat(
        F.lit("config"),
        (F.col("run") % 4).cast("string"),
        F.lit("_seed"),
        F.col("run").cast("string"),
    )
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
            for m in ("latency", "rougeL")
        ]
    )
    return run_metrics(spark, sf_dir).select(name.alias("run"), F.inline(pairs))


def summ_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in ("train", "validation", "test")])
    sentences = split_sentences(clean_text(F.col("text")))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("source"),
        F.coalesce(F.get(sentences, F.lit(0)), F.lit("")).alias("target"),
        F.get(names, (F.col("doc_id") % 3).cast("int")).alias("split"),
    )


def nli_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array(
        F.struct(F.lit("ENTAILMENT").alias("label"), F.col("quality").cast("double").alias("score")),
        F.struct(F.lit("CONTRADICTION").alias("label"), F.col("toxic").cast("double").alias("score")),
    )
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), scores.alias("scores"))
