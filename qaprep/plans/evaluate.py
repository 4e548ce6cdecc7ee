"""Evaluation of predictions: corpus metrics and the per-row report.

Scores are computed inside each row; the only shuffle moves one partial sum per
task and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaprep.functions.stem import stem_tokens
from qaprep.functions.text import rouge_tokens
from qaprep.operators.scoring import (
    BLEU_FIELDS,
    bleu_score,
    is_exact,
    rouge_l,
    rouge_ns,
    sentence_bleu,
    sum_bleu_counts,
    with_bleu_counts,
)
from qaprep.functions.bind import compute_once
from qaprep.sources.readers import require_columns

ROUGE_COLUMNS = ("rouge1", "rouge2", "rougeL")


def with_rouge(df: DataFrame, stem: bool = True) -> DataFrame:
    """Add ROUGE-1, ROUGE-2 and ROUGE-L F1 to each row."""
    require_columns(df, ("predicted", "reference"))
    tokens = df.withColumns(
        {
            "_pred": rouge_tokens(F.col("predicted")),
            "_ref": rouge_tokens(F.col("reference")),
        }
    )
    if stem:
        tokens = tokens.withColumns(
            {"_pred": stem_tokens(F.col("_pred")), "_ref": stem_tokens(F.col("_ref"))}
        )
    pred, ref = F.col("_pred"), F.col("_ref")
    # Filters on the scores must not run the stages below twice.
    scored = compute_once(tokens, {"_ns": rouge_ns(pred, ref, (1, 2)), "rougeL": rouge_l(pred, ref)})
    ns = [F.get("_ns", F.lit(i)) for i in range(2)]
    return scored.withColumns({"rouge1": ns[0], "rouge2": ns[1]}).drop("_pred", "_ref", "_ns")


def _mean(column: str | Column) -> Column:
    return F.coalesce(F.avg(column), F.lit(0.0))


def text_metrics(
    df: DataFrame, by: Sequence[str] = (), mode: str = "13a", stem: bool = True
) -> DataFrame:
    """Corpus BLEU and mean ROUGE of each group; zeros for an empty table."""
    pairs = df.select(*by, *require_columns(df, ("predicted", "reference")))
    scored = with_bleu_counts(with_rouge(pairs, stem), mode)
    means = [_mean(c).alias(c) for c in ROUGE_COLUMNS]
    sums = scored.groupBy(*by).agg(*means, *sum_bleu_counts())
    bleu = bleu_score({f: F.col(f) for f in BLEU_FIELDS})
    return sums.select(*by, bleu.alias("bleu"), *ROUGE_COLUMNS)


def evaluate_rows(df: DataFrame) -> DataFrame:
    """The predictions with each row's BLEU."""
    require_columns(df, ("predicted", "reference"))
    return sentence_bleu(df)


def evaluate(df: DataFrame, by: Sequence[str] = (), stem: bool = True) -> DataFrame:
    """Mean sentence BLEU, mean ROUGE and exact match of each group."""
    pairs = df.select(*by, *require_columns(df, ("predicted", "reference")))
    scored = sentence_bleu(with_rouge(pairs, stem))
    exact = is_exact(F.col("predicted"), F.col("reference"))
    return scored.groupBy(*by).agg(
        _mean("bleu_score").alias("bleu"),
        *[_mean(c).alias(c) for c in ROUGE_COLUMNS],
        _mean(exact).alias("exact_match"),
    )


SCORES = ("bleu_score", *ROUGE_COLUMNS, "exact_match")


def score_rows(df: DataFrame, stem: bool = True) -> DataFrame:
    """df with each row's BLEU, ROUGE F1 and exact match.

    NULL texts count as empty. Columns of df that have the name of a score are
    replaced.
    """
    plain = df.drop(*SCORES)
    exact = is_exact(F.col("predicted"), F.col("reference"))
    return sentence_bleu(with_rouge(plain, stem)).withColumn("exact_match", exact).select(*plain.columns, *SCORES)


def evaluate_saved(df: DataFrame, path: str, by: Sequence[str] = (), stem: bool = True) -> DataFrame:
    """Write the scored rows as Parquet and return the means of each group.

    The texts are crossed once: the means are taken from the scores in the
    written table, of which only these columns are read, so they are the means
    of just the rows that were kept. An empty table gives zeros, or no groups.
    """
    scored = score_rows(df, stem)
    scored.write.parquet(path)
    saved = df.sparkSession.read.schema(scored.schema).parquet(path)
    names = {"bleu_score": "bleu"}
    return saved.groupBy(*by).agg(*[_mean(c).alias(names.get(c, c)) for c in SCORES])
