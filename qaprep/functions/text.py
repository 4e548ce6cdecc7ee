"""Text and sentence functions, all of them built-in Spark expressions.

Every function takes and returns a Column, treats NULL as an empty string and
works inside one row, so none of them moves data between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaprep.functions.bind import bind

# The characters a Python `\s` and `\w` match. Whitespace is a text
# of single characters; the others are the insides of Java character classes.
SPACE = " "
OTHER_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE = SPACE + OTHER_WHITESPACE
# Naming the ASCII part first spares most characters a Unicode lookup.
LOWER_WORD = r"[a-z0-9_\p{L}\p{N}]+"
NOT_WORD_OR_SPACE = r"[^a-zA-Z0-9_ \p{L}\p{N}]"

# The rewriting rules of the "13a" BLEU tokenisation. Its first
# class also has the space, which only widens runs that are split on later.
BLEU_13A_ENTITIES = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)
BLEU_13A_PATTERNS = (
    (r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)

BLEU_MODES = ("ws", "13a")
GRAM_SEPARATOR = "\u0001"


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _parts(cleaned: Column, separator: str) -> Column:
    """Parts of cleaned text, none for an empty one.

    Cleaned text has no empty parts of its own. Testing for the empty text
    instead would evaluate the cleaning twice.
    """
    return F.array_remove(F.split(_text(cleaned), separator), "")


def strip(column: Column) -> Column:
    """Remove whitespace of any kind from both ends."""
    outer = f"^[{WHITESPACE}]+|[{WHITESPACE}]+\\z"
    return F.regexp_replace(_text(column), outer, "")


def _spaced(column: Column) -> Column:
    """Turn every whitespace character into a plain space.

    Mapping characters first leaves a pattern that seldom matches; matching
    every whitespace run instead takes several times as long.
    """
    return F.translate(_text(column), OTHER_WHITESPACE, SPACE * len(OTHER_WHITESPACE))


def _tidy(spaced: Column) -> Column:
    return F.trim(F.regexp_replace(spaced, "  +", SPACE))


def clean_text(column: Column) -> Column:
    """Turn every whitespace run into one space and strip the ends."""
    return _tidy(_spaced(column))


def clean_punct(column: Column) -> Column:
    """Delete punctuation and symbols, then clean whitespace; keeps the case."""
    return _tidy(F.regexp_replace(_spaced(column), NOT_WORD_OR_SPACE, ""))


def clean_lower(column: Column) -> Column:
    """`clean_punct` on lower-cased text."""
    return clean_punct(F.lower(_text(column)))


def normalize_label(column: Column) -> Column:
    """Clean a label, drop the straight quotes around it and a last `" ."`.

    Curly quotes become straight ones only after the outer quotes are gone, so
    an outer curly pair stays in the label as straight quotes.
    """
    unquoted = F.btrim(clean_text(column), F.lit('"'))
    straight = F.translate(unquoted, "“”’", "\"\"'")
    return F.regexp_replace(F.trim(straight), r" \.\z", "")


def word_count(column: Column) -> Column:
    """Number of space-separated words of cleaned text; 0 when empty."""
    return F.size(_parts(column, SPACE))


def append_end(column: Column, token: str = "[END]") -> Column:
    """Strip the right end and add an end marker."""
    bare = F.regexp_replace(_text(column), f"[{WHITESPACE}]+\\z", "")
    return F.concat(bare, F.lit(f" {token}"))


def word_tokens(column: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    lowered = F.lower(_text(column))
    return F.regexp_extract_all(lowered, F.lit(LOWER_WORD), F.lit(0))


def token_set(column: Column) -> Column:
    """Distinct word tokens."""
    return F.array_distinct(word_tokens(column))


def rouge_tokens(column: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    lowered = F.lower(_text(column))
    return F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0))


def bleu_tokens(column: Column, mode: str = "13a") -> Column:
    """BLEU tokens: `ws` splits on whitespace, `13a` also parts punctuation."""
    if mode not in BLEU_MODES:
        raise ValueError(f"Unknown BLEU token mode: {mode}")
    text = _text(column)
    if mode == "13a":
        for entity, plain in BLEU_13A_ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(plain))
        text = F.concat(F.lit(SPACE), text, F.lit(SPACE))
        for pattern, parted in BLEU_13A_PATTERNS:
            text = F.regexp_replace(text, pattern, parted)
    return _parts(clean_text(text), SPACE)


def split_sentences(column: Column) -> Column:
    """Sentences of cleaned text: a break follows `.`, `!` or `?` and a space."""
    return _parts(column, "(?<=[.!?]) ")


def trim_sentences(sentences: Column, limit: int = 8) -> Column:
    """The first sentences, joined by a space."""
    return F.array_join(F.slice(sentences, 1, limit), SPACE)


def to_bullets(sentences: Column, limit: int = 3) -> Column:
    """The first sentences as `- sentence` lines."""
    lines = F.transform(
        F.slice(sentences, 1, limit), lambda s: F.concat(F.lit("- "), s)
    )
    return F.array_join(lines, "\n")


def overlap_ratio(label_set: Column, text_set: Column) -> Column:
    """Share of the label's distinct tokens that the text has; 0 when empty."""

    def ratio(pair: Column) -> Column:
        shared = F.size(F.array_intersect(pair["label"], pair["text"]))
        size = F.size(pair["label"])
        return F.when(size == 0, F.lit(0.0)).otherwise(shared / size)

    return bind(F.struct(label_set.alias("label"), text_set.alias("text")), ratio)


def ngrams(tokens: Column, n: int) -> Column:
    """N-grams as joined strings, empty when there are fewer than n tokens."""
    if n == 1:
        return tokens

    def grams(words: Column) -> Column:
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        return F.transform(
            F.slice(words, F.lit(1), count),
            lambda first, i: F.concat_ws(
                GRAM_SEPARATOR, first, *[F.get(words, i + k) for k in range(1, n)]
            ),
        )

    return bind(tokens, grams)


def label_for(name: str) -> str:
    """Display label of a prompt column, chosen while the plan is built."""
    # Columns whose label is not just their capitalised name.
    labels = {"query": "Question", "abstract": "Context", "title": "Title"}
    return labels.get(name.lower(), name.lower().capitalize())
