"""Prompt templates. A template is chosen while the plan is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaprep.functions.text import clean_lower, clean_punct, clean_text, label_for

# The instruction texts of the prompts.
ANSWER_INSTRUCTION = (
    "Instruction: Answer the question using only the abstract. If the abstract does "
    "not contain the answer, respond with 'Not enough information.'."
)
SUMMARY_INSTRUCTION = "Instruction: Summarize the abstract in 1-2 sentences."


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def _if_any(label: str, value: Column) -> Column:
    """`Label: value`, or NULL (which `concat_ws` leaves out) for empty text."""
    return F.when(value != "", _labelled(label, value))


def answer_prompt(query: Column, title: Column, abstract: Column) -> Column:
    """Answer-from-the-abstract prompt over clean text; the title is optional."""
    return F.concat_ws(
        " ",
        F.lit(ANSWER_INSTRUCTION),
        _labelled("Question", query),
        _if_any("Title", title),
        _labelled("Abstract", abstract),
    )


def column_prompt(df: DataFrame, columns: Sequence[str]) -> Column:
    """`Label: value` for each column the table has, empty values left out."""
    parts = [
        _if_any(label_for(c), clean_text(F.col(c))) for c in columns if c in df.columns
    ]
    return F.concat_ws(" ", *parts)


def capitalized_prompt(df: DataFrame, columns: Sequence[str]) -> Column:
    """`Column: value` for each column the table has, NULLs left out."""
    parts = [
        _labelled(c.lower().capitalize(), F.col(c)) for c in columns if c in df.columns
    ]
    return F.concat_ws(" ", *parts)


def inference_prompt(query: Column, context: Column) -> Column:
    """Question and context, lower-cased and without punctuation."""
    return F.concat_ws(
        " ",
        _labelled("Question", clean_lower(query)),
        _labelled("Context", clean_lower(context)),
    )


def training_prompt(query: Column, abstract: Column) -> Column:
    """Question and context without punctuation, the context labelled inside."""
    return F.concat_ws(
        " ",
        _labelled("Question", clean_punct(query)),
        _labelled("Context", _labelled("Abstract", clean_punct(abstract))),
    )


def summary_prompt(source: Column) -> Column:
    """Summarise-the-abstract prompt."""
    text = F.coalesce(source, F.lit(""))
    return F.concat_ws(" ", F.lit(SUMMARY_INSTRUCTION), _labelled("Abstract", text))


def paraphrase_prompt(target: Column) -> Column:
    """Paraphrase-the-target prompt."""
    return _labelled("Paraphrase", F.coalesce(target, F.lit("")))


def render(df: DataFrame, template: str, out: str = "input_text") -> DataFrame:
    """Add a prompt column by template name, over the template's usual columns."""
    columns = ("query", "title", "abstract")
    templates = {
        "answer": lambda: answer_prompt(*[clean_text(F.col(c)) for c in columns]),
        "columns": lambda: column_prompt(df, columns),
        "capitalized": lambda: capitalized_prompt(df, columns),
        "inference": lambda: inference_prompt(F.col("query"), F.col("context")),
        "training": lambda: training_prompt(F.col("query"), F.col("abstract")),
        "summary": lambda: summary_prompt(F.col("source")),
        "paraphrase": lambda: paraphrase_prompt(F.col("target_text")),
    }
    if template not in templates:
        raise ValueError(f"Unknown prompt template: {template}")
    return df.withColumn(out, templates[template]())
