"""Extractive target sentences: the ones closest to a reference by ROUGE-L."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaprep.functions.text import rouge_tokens, word_count
from qaprep.operators.scoring import rouge_l_many

REFERENCE_MODES = ("label", "query_label", "query_only")


def oracle_reference(query: Column, label: Column, mode: str = "query_label") -> Column:
    """The text that sentences are compared with."""
    if mode not in REFERENCE_MODES:
        raise ValueError(f"Unknown oracle reference: {mode}")
    if mode == "query_only":
        return query
    return label if mode == "label" else F.concat(query, F.lit(" "), label)


def eligible_sentences(sentences: Column, min_tokens: int = 5) -> Column:
    """Sentences with enough words, each with its place in the text."""
    numbered = F.transform(
        sentences, lambda s, i: F.struct(i.alias("idx"), s.alias("sent"))
    )
    return F.filter(numbered, lambda e: word_count(e["sent"]) >= min_tokens)


def candidate_tokens(eligible: Column) -> Column:
    """ROUGE tokens of every eligible sentence."""
    return F.transform(eligible, lambda e: rouge_tokens(e["sent"]))


def pick_oracle(eligible: Column, scores: Column, k: int = 3) -> Column:
    """Join the k best sentences in text order; ties keep the earlier one.

    Gives a struct of the text and the best score, `('', 0.0)` for no sentence.
    """
    ranked = F.sort_array(
        F.zip_with(
            eligible,
            scores,
            lambda e, score: F.struct(
                (-score).alias("cost"), e["idx"].alias("idx"), e["sent"].alias("sent")
            ),
        )
    )
    best = F.slice(ranked, 1, k)
    in_order = F.sort_array(
        F.transform(best, lambda e: F.struct(e["idx"].alias("idx"), e["sent"].alias("sent")))
    )
    text = F.array_join(F.transform(in_order, lambda e: e["sent"]), " ")
    score = F.coalesce(-F.get(ranked, F.lit(0))["cost"], F.lit(0.0))
    return F.struct(text.alias("text"), score.alias("score"))


def select_oracle(
    sentences: Column,
    reference: Column,
    k: int = 3,
    min_tokens: int = 5,
    stem: bool = True,
) -> Column:
    """Best sentences of a text against a reference text, and the best score."""
    eligible = eligible_sentences(sentences, min_tokens)
    scores = rouge_l_many(candidate_tokens(eligible), rouge_tokens(reference), stem)
    return pick_oracle(eligible, scores, k)
