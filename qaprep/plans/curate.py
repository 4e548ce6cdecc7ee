"""Curation of raw question-answering rows into training pairs.

The job is row-local: one scan, one Arrow UDF for the sentence scores, no
shuffle. Cheap rules run before the UDF, which then sees surviving rows only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaprep.functions.bind import compute_once
from qaprep.functions.prompts import answer_prompt
from qaprep.functions.text import (
    append_end,
    clean_text,
    normalize_label,
    overlap_ratio,
    rouge_tokens,
    split_sentences,
    to_bullets,
    token_set,
    trim_sentences,
    word_count,
)
from qaprep.operators import filters
from qaprep.operators.oracle import (
    candidate_tokens,
    eligible_sentences,
    oracle_reference,
    pick_oracle,
)
from qaprep.operators.scoring import rouge_l_many
from qaprep.sources.readers import require_columns

RAW_COLUMNS = ("query", "title", "abstract", "label")
SCOPES = ("trimmed", "full")
TARGET_STYLES = ("oracle", "label", "bullets")


@dataclass(frozen=True)
class CurateOptions:
    """Settings of a curation.

    `scope` names the text that overlap and oracle sentences come from: the
    trimmed abstract, or the full one. `score_filter` drops rows by oracle
    score and empty oracle text.
    """

    oracle_reference: str = "query_label"
    oracle_sentences: int = 3
    min_sentence_tokens: int = 5
    min_overlap: float = 0.45
    min_oracle_rouge_l: float = 0.15
    min_label_tokens: int = 5
    max_label_tokens: int = 40
    max_abstract_sentences: int = 8
    scope: str = "trimmed"
    score_filter: bool = True
    target_style: str = "oracle"
    end_token: str | None = None
    stem: bool = True

    def __post_init__(self) -> None:
        if self.scope not in SCOPES:
            raise ValueError(f"Unknown scope: {self.scope}")
        if self.target_style not in TARGET_STYLES:
            raise ValueError(f"Unknown target style: {self.target_style}")


CLEAN = CurateOptions()
VARIANT = CurateOptions(scope="full", score_filter=False)


def clean_rows(df: DataFrame) -> DataFrame:
    """Clean texts, normalised label and its word count."""
    require_columns(df, RAW_COLUMNS)
    cleaned = compute_once(
        df,
        {
            "query": clean_text(F.col("query")),
            "title": clean_text(F.col("title")),
            "label": normalize_label(F.col("label")),
        },
    )
    return cleaned.withColumn("label_tokens", word_count(F.col("label")))


def add_overlap(df: DataFrame, options: CurateOptions = CLEAN) -> DataFrame:
    """Sentences, trimmed abstract and overlap; `sentences` covers the scope."""
    split = compute_once(df, {"sentences": split_sentences(clean_text(F.col("abstract")))})
    limit = options.max_abstract_sentences
    trimmed = trim_sentences(F.col("sentences"), limit)
    scoped = split.withColumn("abstract_trimmed", trimmed).drop("abstract")
    if options.scope == "trimmed":
        scoped = scoped.withColumn("sentences", F.slice("sentences", 1, limit))
    text = F.array_join("sentences", " ")
    overlap = overlap_ratio(token_set(F.col("label")), token_set(text))
    return compute_once(scoped, {"overlap": overlap})


def add_oracle(df: DataFrame, options: CurateOptions = CLEAN) -> DataFrame:
    """Oracle text and score of rows that have `sentences`."""
    reference = oracle_reference(
        F.col("query"), F.col("label"), options.oracle_reference
    )
    prepared = df.withColumns(
        {
            "_eligible": eligible_sentences(
                F.col("sentences"), options.min_sentence_tokens
            ),
            "_reference": rouge_tokens(reference),
        }
    ).withColumn("_tokens", candidate_tokens(F.col("_eligible")))
    scores = rouge_l_many(F.col("_tokens"), F.col("_reference"), options.stem)
    oracle = pick_oracle(F.col("_eligible"), scores, options.oracle_sentences)
    scored = compute_once(prepared, {"_oracle": oracle})
    return scored.withColumns(
        {"oracle_text": F.col("_oracle.text"), "oracle_rougeL": F.col("_oracle.score")}
    ).drop("_eligible", "_reference", "_tokens", "_oracle", "sentences")


def target_text(options: CurateOptions) -> Column:
    """The answer text in the chosen style."""
    if options.target_style == "label":
        target = F.col("label")
    elif options.target_style == "bullets":
        target = to_bullets(split_sentences(F.col("oracle_text")))
    else:
        target = F.col("oracle_text")
    return append_end(target, options.end_token) if options.end_token else target


def rules(options: CurateOptions = CLEAN) -> dict[str, Column]:
    """The filter rules in the order they are applied."""
    chosen = {
        "label_length": filters.label_len_ok(
            options.min_label_tokens, options.max_label_tokens
        ),
        "overlap": filters.overlap_ok(options.min_overlap),
    }
    if options.score_filter:
        chosen["oracle_score"] = filters.oracle_score_ok(options.min_oracle_rouge_l)
        chosen["oracle_text"] = filters.oracle_text_ok()
    return chosen


def curate(
    df: DataFrame, options: CurateOptions = CLEAN, keys: Sequence[str] = ()
) -> DataFrame:
    """Curated training rows; `keys` are extra columns to carry along."""
    rule = rules(options)
    rows = clean_rows(df.select(*keys, *require_columns(df, RAW_COLUMNS)))
    rows = rows.filter(rule["label_length"])
    rows = add_overlap(rows, options).filter(rule["overlap"])
    rows = add_oracle(rows, options)
    if options.score_filter:
        rows = rows.filter(rule["oracle_score"] & rule["oracle_text"])
    prompt = answer_prompt(F.col("query"), F.col("title"), F.col("abstract_trimmed"))
    rows = rows.withColumns({"input_text": prompt, "target_text": target_text(options)})
    return filters.select_curated(rows, *keys)


def curation_report(df: DataFrame, options: CurateOptions = CLEAN) -> DataFrame:
    """How many rows a curation keeps, and which rule drops the others.

    Rows that fail a cheap rule reach the scoring UDF without sentences, so the
    report costs no more scoring than the curation itself.
    """
    rule = rules(options)
    rows = add_overlap(clean_rows(df.select(*require_columns(df, RAW_COLUMNS))), options)
    cheap = rule["label_length"] & rule["overlap"]
    rows = rows.withColumn(
        "sentences", F.when(cheap, F.col("sentences")).otherwise(F.slice("sentences", 1, 0))
    )
    return filters.drop_report(add_oracle(rows, options), rule)
