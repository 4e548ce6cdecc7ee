"""Longest common subsequence of token arrays.

A subsequence length cannot be computed from per-row built-ins at a usable
speed, so it runs in an Arrow UDF: tokens become integers once per batch, then
each pair takes one pass over the candidate with the dynamic-programming row
held in the bits of one integer (Hyyro, "Bit-parallel LCS-length computation
revisited", 2004). Integers have no size limit, so whole texts are compared.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from qaprep.functions.stem import flatten, stem_words


def positions(reference: Sequence[int]) -> dict[int, int]:
    """Bit mask of the positions of every token of the reference."""
    masks: dict[int, int] = {}
    for index, token in enumerate(reference):
        masks[token] = masks.get(token, 0) | (1 << index)
    return masks


def lcs_length(candidate: Sequence[int], masks: dict[int, int], size: int) -> int:
    """LCS length of a candidate and a reference of `size` tokens."""
    full = (1 << size) - 1
    row = full
    for token in candidate:
        mask = masks.get(token)
        if mask:
            hits = row & mask
            row = ((row + hits) | (row - hits)) & full
    return size - row.bit_count()


def _bounds(lists: pa.Array) -> list[int]:
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return np.concatenate([[0], np.cumsum(lengths)]).tolist()


def _token_ids(tokens: list[pa.Array], stem: bool) -> list[list[int]]:
    """Integers that are equal exactly where the (stemmed) tokens are."""
    encoded = pa.concat_arrays(tokens).dictionary_encode()
    ids = encoded.indices.to_numpy()
    if stem:
        stems = pa.array(stem_words(encoded.dictionary.to_pylist()), pa.string())
        ids = stems.dictionary_encode().indices.to_numpy()[ids]
    ends = np.cumsum([len(t) for t in tokens])[:-1]
    return [part.tolist() for part in np.split(ids, ends)]


def _lcs_udf(stem: bool):
    @F.arrow_udf(ArrayType(IntegerType()))
    def lcs(candidates: pa.Array, reference: pa.Array) -> pa.Array:
        inner = flatten(candidates)
        rows, texts, refs = _bounds(candidates), _bounds(inner), _bounds(reference)
        left, right = _token_ids([flatten(inner), flatten(reference)], stem)
        lengths = []
        for row in range(len(reference)):
            ref = right[refs[row] : refs[row + 1]]
            masks = positions(ref)
            for text in range(rows[row], rows[row + 1]):
                words = left[texts[text] : texts[text + 1]]
                lengths.append(lcs_length(words, masks, len(ref)))
        offsets = pa.array(rows, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(lengths, pa.int32()))

    return lcs


def lcs_many(candidates: Column, reference: Column, stem: bool = False) -> Column:
    """LCS length of each token array in `candidates` with one reference."""
    return _lcs_udf(stem)(candidates, reference)


def lcs_len(a: Column, b: Column, stem: bool = False) -> Column:
    """LCS length of two token arrays."""
    return F.get(lcs_many(F.array(a), b, stem), F.lit(0))
