"""Porter stemming of token arrays.

The rules are those of M. F. Porter, "An algorithm for suffix stripping"
(Program 14(3), 1980), with the small extensions of the widely used English
implementation that ROUGE scorers rely on: a pool of irregular words, `ies` and
`ied` in four-letter words, and the `fulli`, `logi` and repeated `alli` endings.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Irregular words and their stems.
IRREGULAR = {
    "sky": "sky",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "news": "news",
    "inning": "inning",
    "innings": "inning",
    "outing": "outing",
    "outings": "outing",
    "canning": "canning",
    "cannings": "canning",
    "howe": "howe",
    "proceed": "proceed",
    "exceed": "exceed",
    "succeed": "succeed",
}

# Suffixes of the second step, tried in this order.
DERIVED = (
    ("ational", "ate"),
    ("tional", "tion"),
    ("enci", "ence"),
    ("anci", "ance"),
    ("izer", "ize"),
    ("bli", "ble"),
    ("alli", "al"),
    ("entli", "ent"),
    ("eli", "e"),
    ("ousli", "ous"),
    ("ization", "ize"),
    ("ation", "ate"),
    ("ator", "ate"),
    ("alism", "al"),
    ("iveness", "ive"),
    ("fulness", "ful"),
    ("ousness", "ous"),
    ("aliti", "al"),
    ("iviti", "ive"),
    ("biliti", "ble"),
    ("fulli", "ful"),
)

# Suffixes of the third step.
ADJECTIVAL = (
    ("icate", "ic"),
    ("ative", ""),
    ("alize", "al"),
    ("iciti", "ic"),
    ("ical", "ic"),
    ("ful", ""),
    ("ness", ""),
)

# Suffixes the fourth step removes.
RESIDUAL = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
    "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(text: str) -> str:
    """One `v` or `c` per letter; `y` is a vowel right after a consonant."""
    shape = ""
    for letter in text:
        vowel = letter in "aeiou" or (letter == "y" and shape[-1:] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(text: str) -> int:
    return _shape(text).count("vc")


def _ends_short(text: str) -> bool:
    """Consonant-vowel-consonant at the end, the last one not w, x or y."""
    shape = _shape(text)
    if len(text) == 2:
        return shape == "vc"
    return shape[-3:] == "cvc" and text[-1] not in "wxy"


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        base = word.removesuffix(suffix)
        if base != word and "v" in _shape(base):
            return _repair(base)
    return word


def _repair(base: str) -> str:
    """Give a base that lost `ed` or `ing` its proper ending."""
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base[-2:-1] == base[-1:] and _shape(base)[-1:] == "c":
        return base if base[-1] in "lsz" else base[:-1]
    return base + "e" if _measure(base) == 1 and _ends_short(base) else base


def _final_y(word: str) -> str:
    consonant_before = len(word) > 2 and _shape(word)[-2] == "c"
    return word[:-1] + "i" if word[-1:] == "y" and consonant_before else word


def _swap(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    """Apply the first rule whose suffix fits, if its base is long enough."""
    for suffix, replacement in rules:
        if word.endswith(suffix):
            base = word[: len(word) - len(suffix)]
            return base + replacement if _measure(base) > 0 else word
    return word


def _derived(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derived(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _swap(word, DERIVED)


def _residual(word: str) -> str:
    for suffix in RESIDUAL:
        if word.endswith(suffix):
            base = word[: len(word) - len(suffix)]
            fits = suffix != "ion" or base[-1:] in ("s", "t")
            return base if fits and _measure(base) > 1 else word
    return word


def _final_e(word: str) -> str:
    base = word.removesuffix("e")
    if base == word:
        return word
    measure = _measure(base)
    return base if measure > 1 or (measure == 1 and not _ends_short(base)) else word


def _final_double_l(word: str) -> str:
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(maxsize=1 << 18)
def porter_stem(word: str) -> str:
    """Stem of one lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _final_y(_past(_plural(word)))
    word = _swap(_derived(word), ADJECTIVAL)
    return _final_double_l(_final_e(_residual(word)))


def stem_words(words: list[str]) -> list[str]:
    """Stems, leaving words of three characters or fewer as they are."""
    return [porter_stem(w) if len(w) > 3 else w for w in words]


def flatten(lists: pa.Array) -> pa.Array:
    """The values of a list array; a batch without any gives a sound empty array.

    Empty vectors arrive without their offset buffers, which later calls need.
    """
    values = lists.flatten()
    return values if len(values) else pa.array([], values.type)


@F.arrow_udf(ArrayType(StringType()))
def _stem_arrays(tokens: pa.Array) -> pa.Array:
    encoded = flatten(tokens).dictionary_encode()
    stems = pa.array(stem_words(encoded.dictionary.to_pylist()), pa.string())
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, stems.take(encoded.indices))


def stem_tokens(tokens: Column) -> Column:
    """Stem every token longer than three characters."""
    return _stem_arrays(tokens)
