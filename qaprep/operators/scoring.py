"""ROUGE, BLEU and exact match over pairs of texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaprep.functions.bind import bind
from qaprep.functions.counts import clipped_each
from qaprep.functions.lcs import lcs_len, lcs_many
from qaprep.functions.text import bleu_tokens, ngrams

BLEU_ORDERS = (1, 2, 3, 4)
BLEU_FIELDS = (
    "pred_len",
    "ref_len",
    *[f"match{n}" for n in BLEU_ORDERS],
    *[f"total{n}" for n in BLEU_ORDERS],
)


def f1(matches: Column, predicted: Column, reference: Column) -> Column:
    """F1 of a match count and the two lengths; 0 when nothing matches."""
    precision = matches / predicted
    recall = matches / reference
    score = 2 * precision * recall / (precision + recall)
    return F.when(matches > 0, score).otherwise(F.lit(0.0))


def rouge_ns(predicted: Column, reference: Column, orders: Sequence[int]) -> Column:
    """ROUGE-N F1 of two token arrays for each order, as an array."""
    pairs = [(ngrams(predicted, n), ngrams(reference, n)) for n in orders]
    return clipped_each(pairs, lambda m, left, right: f1(m, F.size(left), F.size(right)))


def rouge_n(predicted: Column, reference: Column, n: int) -> Column:
    """ROUGE-N F1 of two token arrays."""
    return F.get(rouge_ns(predicted, reference, (n,)), F.lit(0))


def rouge_l(predicted: Column, reference: Column, stem: bool = False) -> Column:
    """ROUGE-L F1 of two token arrays."""
    lcs = lcs_len(predicted, reference, stem)
    return bind(lcs, lambda m: f1(m, F.size(predicted), F.size(reference)))


def rouge_l_many(candidates: Column, reference: Column, stem: bool = False) -> Column:
    """ROUGE-L F1 of each token array in `candidates` with one reference."""
    parts = F.struct(
        lcs_many(candidates, reference, stem).alias("lcs"),
        candidates.alias("candidates"),
        F.size(reference).alias("size"),
    )
    return bind(
        parts,
        lambda p: F.zip_with(
            p["lcs"], p["candidates"], lambda m, t: f1(m, F.size(t), p["size"])
        ),
    )


def bleu_counts(predicted: Column, reference: Column, mode: str = "13a") -> Column:
    """Struct of lengths, clipped matches and totals for n-grams of order 1-4.

    In `ws` mode a prediction too short for an order still counts one gram
    there, as the whitespace-splitting scorer does; in `13a` mode it counts none.
    """
    floor = F.lit(1 if mode == "ws" else 0)
    pairs = [(ngrams(predicted, n), ngrams(reference, n)) for n in BLEU_ORDERS]

    def counts(matches: Column) -> Column:
        pred_len = F.size(predicted)
        clipped = [F.get(matches, F.lit(n - 1)) for n in BLEU_ORDERS]
        totals = [F.greatest(pred_len - (n - 1), floor) for n in BLEU_ORDERS]
        values = [pred_len, F.size(reference), *clipped, *totals]
        return F.struct(*[v.alias(f) for v, f in zip(values, BLEU_FIELDS, strict=True)])

    return bind(clipped_each(pairs), counts)


def bleu_score(counts: dict[str, Column]) -> Column:
    """Unsmoothed BLEU from (summed) counts; 0 when an order has no match."""
    logs = [F.log(counts[f"match{n}"] / counts[f"total{n}"]) for n in BLEU_ORDERS]
    mean = reduce(lambda a, b: a + b, logs) / len(BLEU_ORDERS)
    pred_len, ref_len = counts["pred_len"], counts["ref_len"]
    penalty = F.when(pred_len > ref_len, F.lit(0.0)).otherwise(1 - ref_len / pred_len)
    some = reduce(lambda a, b: a & b, [counts[f"match{n}"] > 0 for n in BLEU_ORDERS])
    return F.when(some, F.exp(penalty + mean)).otherwise(F.lit(0.0))


def with_bleu_counts(df: DataFrame, mode: str = "13a") -> DataFrame:
    """Add the BLEU counts of `predicted` against `reference` to each row."""
    tokens = df.withColumns(
        {
            "_pred": bleu_tokens(F.col("predicted"), mode),
            "_ref": bleu_tokens(F.col("reference"), mode),
        }
    )
    counted = tokens.withColumn(
        "bleu_counts", bleu_counts(F.col("_pred"), F.col("_ref"), mode)
    )
    return counted.drop("_pred", "_ref")


def sum_bleu_counts() -> list[Column]:
    """Aggregates that add the counts up over a group, 0 for an empty one."""
    return [
        F.coalesce(F.sum(f"bleu_counts.{f}"), F.lit(0)).alias(f) for f in BLEU_FIELDS
    ]


def corpus_bleu(df: DataFrame, by: Sequence[str] = (), mode: str = "13a") -> DataFrame:
    """BLEU of each group from counts summed over its rows."""
    sums = with_bleu_counts(df, mode).groupBy(*by).agg(*sum_bleu_counts())
    score = bleu_score({f: F.col(f) for f in BLEU_FIELDS})
    return sums.select(*by, score.alias("bleu"))


def sentence_bleu(df: DataFrame, mode: str = "ws") -> DataFrame:
    """Add each row's own BLEU as `bleu_score`."""
    counts = {f: F.col(f"bleu_counts.{f}") for f in BLEU_FIELDS}
    scored = with_bleu_counts(df, mode).withColumn("bleu_score", bleu_score(counts))
    return scored.drop("bleu_counts")


def is_exact(predicted: Column, reference: Column) -> Column:
    """1.0 where both texts are equal, else 0.0; NULL counts as empty."""
    equal = F.coalesce(predicted, F.lit("")) == F.coalesce(reference, F.lit(""))
    return equal.cast("double")


def exact_match(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction equals the reference."""
    equal = F.avg(is_exact(F.col("predicted"), F.col("reference")))
    return df.groupBy(*by).agg(F.coalesce(equal, F.lit(0.0)).alias("exact_match"))
