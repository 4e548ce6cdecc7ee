"""Batch scoring with a model function that the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType, StringType

from qaprep.functions.bind import compute_once
from qaprep.functions.prompts import paraphrase_prompt

NLI_LABELS = ("entailment", "neutral", "contradiction")


def batch_score(
    df: DataFrame,
    inputs: Sequence[str],
    make_predict_fn: Callable,
    return_type: DataType | None = None,
    batch_size: int = 20,
    out: str = "prediction",
) -> DataFrame:
    """Add a prediction column, computed in batches of at most `batch_size`.

    `make_predict_fn` runs once per Python worker and returns a function from
    one NumPy array per input to an array of the same length. The prediction
    stays in the row it was made from. The model runs once a row, also if the
    prediction is filtered on later.
    """
    predict = predict_batch_udf(
        make_predict_fn, return_type=return_type or StringType(), batch_size=batch_size
    )
    texts = [F.coalesce(F.col(c), F.lit("")) for c in inputs]
    return compute_once(df, {out: predict(*texts)})


def augment(df: DataFrame, make_predict_fn: Callable, batch_size: int = 4) -> DataFrame:
    """Add `target_text_paraphrase` from the paraphrase prompt of the target."""
    if "target_text" not in df.columns:
        raise ValueError("augment needs a column target_text")
    prompted = df.withColumn("_prompt", paraphrase_prompt(F.col("target_text")))
    scored = batch_score(
        prompted, ["_prompt"], make_predict_fn, None, batch_size, "target_text_paraphrase"
    )
    return scored.drop("_prompt")


def score_pairs(
    df: DataFrame,
    make_predict_fn: Callable,
    labels: Sequence[str] = NLI_LABELS,
    batch_size: int = 20,
) -> DataFrame:
    """Score premise and hypothesis; one column for each label.

    The premise is `reference`, the hypothesis `predicted`. The model function
    returns one row of scores a pair, in the order of `labels`.
    """
    scored = batch_score(
        df,
        ["reference", "predicted"],
        make_predict_fn,
        ArrayType(FloatType()),
        batch_size,
        "_scores",
    )
    columns = {
        label: F.get("_scores", F.lit(i)).cast("double") for i, label in enumerate(labels)
    }
    return scored.withColumns(columns).drop("_scores")


def scores_to_columns(
    scores: Column, labels: Sequence[str] = NLI_LABELS
) -> dict[str, Column]:
    """A column for each label of a `(label, score)` list, 0.0 where missing.

    Labels match in any letter case; the last entry of a label counts.
    """

    def last(label: str) -> Column:
        same = F.filter(scores, lambda s: F.lower(s["label"]) == label)
        return F.coalesce(F.try_element_at(same, F.lit(-1))["score"], F.lit(0.0))

    return {label: last(label) for label in labels}
