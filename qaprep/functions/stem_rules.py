"""The stemming rules as one table, and stems by built-in Spark functions.

A rule names an ending, and what a word with that ending turns into if the rest
of it is long enough. Of each step the first rule whose ending fits decides,
whether it changes the word or not. The conditions on the rest, which count
vowel and consonant runs, are patterns without look-around, so that Spark and
other engines read the same table.

A `y` that acts as a vowel is written as `Y` from the first step to the last.
`#` marks a word that lost its past or progressive ending and may need repair,
`!` one that is done.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaprep.functions.stem import ADJECTIVAL, DERIVED, IRREGULAR, RESIDUAL
from qaprep.functions.text import rouge_tokens

VOWEL, CONSONANT = "[aeiouY]", "[^aeiouY]"
#: A beginning with a vowel run that a consonant follows; and with two of these.
ONCE = f"{CONSONANT}*{VOWEL}+{CONSONANT}"
TWICE = f"{ONCE}+{VOWEL}+{CONSONANT}"
#: A word of one such run that ends consonant, vowel, consonant but w, x or y.
SHORT = f"{CONSONANT}+{VOWEL}[^aeiouYwxy]|{VOWEL}{CONSONANT}"
DOUBLED = "bcdfghjkmnpqrtvwxy0123456789"


class Rule(NamedTuple):
    """Words with an ending (or that match a pattern) and their change, if any."""

    ending: str
    change: str = ""
    into: str = r"\1"
    pattern: bool = False


def _swapped(rules: tuple[tuple[str, str], ...]) -> list[Rule]:
    return [Rule(old, f"^({ONCE}.*){old}$", rf"\1{new}") for old, new in rules]


def _residual(ending: str) -> Rule:
    if ending == "ion":
        return Rule(ending, f"^({ONCE}+{VOWEL}+(?:{CONSONANT}.*)?[st])ion$")
    return Rule(ending, f"^({TWICE}.*){ending}$")


STEPS: list[list[Rule]] = [
    [
        Rule("ies", "^(.ie|i|..+i)(?:s|es)$"),
        Rule("sses", "^(.*ss)es$"),
        Rule("ss"),
        Rule("s", "^(.*)s$"),
    ],
    [
        Rule("ied", "^(.ie|i|..+i)(?:d|ed)$"),
        Rule("eed", f"^({ONCE}.*)eed$", r"\1ee"),
        Rule("ed", f"^(.*{VOWEL}.*)ed$", r"\1#"),
        Rule("ing", f"^(.*{VOWEL}.*)ing$", r"\1#"),
    ],
    [
        *[Rule(f"{end}#", "^(.*)#$", r"\1e") for end in ("at", "bl", "iz")],
        *[Rule(f"{x}{x}#", f"^(.*){x}#$") for x in DOUBLED],
        Rule("Yy#", "^(.*)y#$"),
        *[Rule(f"{x}{x}#", "^(.*)#$") for x in "lsz"],
        Rule(f"^(?:{SHORT})#$", "^(.*)#$", r"\1e", pattern=True),
        Rule("#", "^(.*)#$"),
    ],
    [Rule("Y", f"^(.+{CONSONANT})Y$", r"\1i")],
    [Rule("alli", f"^({ONCE}.*)alli$", r"\1al")],
    [Rule("logi", f"^({ONCE}.*)ogi$", r"\1og"), *_swapped(DERIVED)],
    _swapped(ADJECTIVAL),
    [_residual(ending) for ending in RESIDUAL],
    [Rule(f"^(?:{SHORT})e$", pattern=True), Rule("e", f"^({ONCE}.*)e$")],
    [Rule("ll", f"^({ONCE}+{VOWEL}+(?:{CONSONANT}.*)?l)l$")],
]
#: How a vowel `y` is marked: after a consonant, and every second one of a run.
MARKS = ((r"([^aeiouYy])y", r"\1Y"), ("yy", "yY"))


def _replaced(word: Column, pattern: str, into: str) -> Column:
    return F.regexp_replace(word, pattern, into.replace("\\1", "$1"))


def _begun(word: Column) -> Column:
    """The word with its vowel `y` marked, or done: irregular or of three characters at most."""
    marked = reduce(lambda w, mark: _replaced(w, *mark), MARKS, word)
    out = F.when(F.length(word) <= 3, F.concat(word, F.lit("!")))
    for irregular, stem in IRREGULAR.items():
        out = out.when(word == irregular, f"{stem}!")
    return out.when(F.contains(word, F.lit("y")), marked).otherwise(word)


def _step(rules: list[Rule]) -> Callable[[Column], Column]:
    def step(word: Column) -> Column:
        out = F.when(F.endswith(word, F.lit("!")), word)
        for rule in rules:
            fits = word.rlike(rule.ending) if rule.pattern else F.endswith(word, F.lit(rule.ending))
            out = out.when(fits, _replaced(word, rule.change, rule.into) if rule.change else word)
        return out.otherwise(word)

    return step


def _ended(word: Column) -> Column:
    return F.translate(word, "Y!", "y")


def with_stems(df: DataFrame, token: str = "token", out: str = "stem") -> DataFrame:
    """df with the stem of its lower-case tokens, by built-in functions only.

    Each step is a projection of its own, so that it is compiled once. NULL
    stays NULL; an empty token is its own stem. Columns of df called `out` or
    `_word` are replaced or must not occur, respectively.
    """
    rows = df.drop(out).withColumn("_word", _begun(F.col(token)))
    for rules in STEPS:
        rows = rows.withColumn("_word", _step(rules)(F.col("_word")))
    return rows.withColumn(out, _ended(F.col("_word"))).drop("_word")


def stem_vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, stem, n): every distinct ROUGE token of the texts and its count.

    Tokens are counted before the shuffle and stemmed once each, whatever the
    number of texts. NULL and empty texts have no tokens.
    """
    tokens = df.select(F.explode(rouge_tokens(F.col(text))).alias("token"))
    return with_stems(tokens.groupBy("token").agg(F.count("*").alias("n"))).select("token", "stem", "n")
