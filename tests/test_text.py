from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from qaprep.functions import text
from tests import brute


def test_clean_text_matches_every_whitespace_character(spark):
    characters = [chr(c) for c in range(1, 0x3100)]
    rows = [(c, f"{c}a{c}{c} b {c}") for c in characters]
    df = spark.createDataFrame(rows, "c string, t string")
    for row in df.select("c", "t", text.clean_text(F.col("t")).alias("v")).collect():
        assert row["v"] == brute.clean(row["t"]), repr(row["c"])


def test_null_is_empty_text(one):
    for function in (text.clean_text, text.clean_lower, text.clean_punct, text.normalize_label):
        assert one(function, None) == ""
    assert one(text.word_count, None) == 0
    assert one(text.split_sentences, None) == []
    assert one(text.rouge_tokens, None) == []


def test_punctuation_goes_and_words_stay(one):
    assert one(text.clean_lower, "  It's ²—«Élan»_x!  No. ") == "its ²élan_x no"
    assert one(text.clean_punct, "A - B, C") == "A B C"


@pytest.mark.parametrize(
    ("label", "wanted"),
    [
        ('"quoted" .', 'quoted"'),
        ('""twice""', "twice"),
        ("“curly”", '"curly"'),
        ('"“both”"', '"both"'),
        ("it’s ‘so’", "it's ‘so'"),
        ('a "b" c .', 'a "b" c'),
        ('" . "', "."),
        ('"', ""),
        ("end  .", "end"),
    ],
)
def test_normalize_label(one, label, wanted):
    assert one(text.normalize_label, label) == wanted


def test_outer_curly_quotes_survive_as_straight_ones(one):
    assert one(text.normalize_label, "“curly”") == '"curly"'


@pytest.mark.parametrize(
    ("t", "wanted"),
    [
        ("", []),
        ("One.", ["One."]),
        ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]),
        ("a.b. c", ["a.b.", "c"]),
        ("No end", ["No end"]),
        (". . .", [".", ".", "."]),
    ],
)
def test_split_sentences(one, t, wanted):
    assert one(lambda c: text.split_sentences(text.clean_text(c)), t) == wanted


def test_trim_and_bullets(one):
    t = "A b. C d! E f? G h."
    assert one(lambda c: text.trim_sentences(text.split_sentences(c), 2), t) == "A b. C d!"
    assert one(lambda c: text.to_bullets(text.split_sentences(c)), t) == "- A b.\n- C d!\n- E f?"
    assert one(lambda c: text.to_bullets(text.split_sentences(c)), "") == ""


def test_word_count_and_end_marker(one):
    assert one(text.word_count, "") == 0
    assert one(text.word_count, "a b  c".replace("  ", " ")) == 3
    assert one(text.append_end, "done \t") == "done [END]"


def test_word_tokens_and_overlap(one):
    assert one(text.word_tokens, "Él_1 x-Y ½ z²!") == re.findall(r"\w+", "él_1 x-y ½ z²!")

    def ratio(a, b):
        return text.overlap_ratio(text.token_set(a), text.token_set(b))

    assert one(ratio, "a b c c", "A x b") == pytest.approx(2 / 3)
    assert one(ratio, "...", "a") == 0.0


def test_ngrams(one):
    def grams(n):
        return lambda c: text.ngrams(text.rouge_tokens(c), n)

    assert one(grams(2), "a b c") == ["a\x01b", "b\x01c"]
    assert one(grams(3), "a b") == []
    assert one(grams(1), "a b") == ["a", "b"]


def _tokens_13a(line):
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for old, new in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(old, new)
    line = f" {line} "
    for pattern, parted in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        line = re.sub(pattern, parted, line)
    return line.split()


@pytest.mark.parametrize(
    "t",
    ["", "Hello, world!", "3.14, 1,000-fold", "a-\nb c\nd", "&lt;x&gt; &amp;quot;", "..., .5 5.", "a{b}c [d] e/f @g"],
)
def test_bleu_tokens(one, t):
    assert one(text.bleu_tokens, t) == _tokens_13a(t)
    assert one(lambda c: text.bleu_tokens(c, "ws"), t) == t.split()


def test_unknown_bleu_mode_is_refused():
    with pytest.raises(ValueError):
        text.bleu_tokens(None, "other")


def test_label_for():
    assert [text.label_for(n) for n in ("query", "Abstract", "title", "fieldName")] == [
        "Question",
        "Context",
        "Title",
        "Fieldname",
    ]
