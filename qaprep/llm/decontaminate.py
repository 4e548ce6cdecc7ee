"""Benchmark decontamination by spaced seeds.

A mask looks at some of the words in a window and ignores the others, so that a
window still hits after words at ignored places were replaced. Windows of the
benchmark and of the documents are hashed under several masks and joined on
mask and hash. Around each hit the two texts are compared word by word along
the same diagonal, and the best stretch must be long and alike enough.

The benchmark's hashes go to the tasks, in blocks of bounded size. A benchmark of
one block is one scan that shuffles no documents. For more, documents are
written once with a number, each block is a job of its own that writes what it
finds, and findings are brought back by number. So neither the driver nor a task
holds more than one block, however large the benchmark.
"""

from __future__ import annotations

import itertools
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from qaprep.llm.common import append_columns, text_bytes, write_table
from qaprep.session import scratch_path

# Windows of nine places, six of them looked at.
MASKS = ("111010011", "110101101", "101100111", "111001101")
SPAN = 9
#: Words of a stretch at least; benchmark texts with fewer must be there whole.
LEAST_WORDS = 12
SIMILARITY = 0.8
#: Shorter benchmark texts say too little and match nothing.
SHORTEST = 5
#: Words of the benchmark in one block; its tables take about 40 bytes a word
#: and mask.
BLOCK_WORDS = 150_000

#: Hits that are spread out at once; windows of one repeated word hit as often as
#: the product of their numbers, but lie on few diagonals.
HITS = 1 << 20

_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_FACTORS = np.random.default_rng(41).integers(1, 1 << 63, SPAN, np.uint64) | np.uint64(1)
_SHIFT = np.uint64(42)
#: How the words of an item are kept in a table.
_WORD, _WORD_BYTES = np.dtype("<u4"), 4
_ROW = "__leak_row"


def tokens(text: bytes) -> np.ndarray:
    """CRC-32 of each word: lower case, without ASCII punctuation."""
    plain = text.decode("utf-8", "replace").lower().encode().translate(_PLAIN)
    words = plain.split()
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window of the words under a mask."""
    n = len(words) - len(mask) + 1
    total = np.full(max(n, 0), len(mask), np.uint64)
    for place, looked_at in enumerate(mask):
        if looked_at == "1" and n > 0:
            total += (words[place : place + n] + np.uint64(1)) * _FACTORS[place]
    return (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """Hashes of some benchmark texts under every mask."""

    def __init__(self, texts: list[np.ndarray]):
        self.texts = texts
        self.tables = []
        short = {len(t) for t in texts if SHORTEST <= len(t) < SPAN}
        for mask in [*MASKS, *("1" * n for n in sorted(short))]:
            keys, items, places = [], [], []
            for i, t in enumerate(texts):
                if len(t) == len(mask) if len(mask) < SPAN else len(t) >= SPAN:
                    h = hashes(t, mask)
                    keys.append(h)
                    items.append(np.full(len(h), i))
                    places.append(np.arange(len(h)))
            if keys:
                key = np.concatenate(keys)
                at = np.argsort(key, kind="stable")
                seen = np.zeros(1 << 22, bool)
                seen[(key >> _SHIFT).astype(np.int64)] = True
                self.tables.append(
                    (mask, key[at], np.concatenate(items)[at], np.concatenate(places)[at], seen)
                )

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Distinct (benchmark text, place in words minus place in it)."""
        found = []
        for mask, keys, items, places, seen in self.tables:
            h = hashes(words, mask)
            at = np.flatnonzero(seen[(h >> _SHIFT).astype(np.int64)])
            lo = np.searchsorted(keys, h[at], "left")
            n = np.searchsorted(keys, h[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            sums = np.cumsum(n)
            cuts = np.unique(np.searchsorted(sums, np.arange(0, n.sum(), HITS), "right"))
            for start, stop in itertools.pairwise([*cuts.tolist(), len(n)]):
                a, l, m = at[start:stop], lo[start:stop], n[start:stop]
                ends = np.cumsum(m)
                entry = np.arange(ends[-1]) + np.repeat(l - ends + m, m)
                pairs = np.stack([items[entry], np.repeat(a, m) - places[entry]], 1)
                found.append(np.unique(pairs, axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def verify(self, words: np.ndarray, item: int, shift: int) -> tuple[int, int, int] | None:
        """(start, end, equal words) of the best stretch on a diagonal, if good.

        Equal words gain 1 - SIMILARITY and others lose SIMILARITY, so the best
        stretch is at least that alike.
        """
        t = self.texts[item]
        lo, hi = max(0, shift), min(len(words), shift + len(t))
        if hi - lo < min(LEAST_WORDS, len(t)):
            return None
        same = words[lo:hi] == t[lo - shift : hi - shift]
        sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - SIMILARITY, -SIMILARITY))])
        low = np.minimum.accumulate(sums)
        end = int(np.argmax(sums - low))
        start = int(np.argmin(sums[: end + 1]))
        equal = int(same[start:end].sum())
        if end - start < min(LEAST_WORDS, len(t)) or equal < SIMILARITY * (end - start):
            return None
        return lo + start, lo + end, equal


def _match(words: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(benchmark text, start, end, equal words): the best stretch of each text."""
    best: dict[int, tuple[int, int, int]] = {}
    for item, shift in index.hits(words).tolist():
        found = index.verify(words, item, shift)
        if found and (item not in best or found[2] > best[item][2]):
            best[item] = found
    return [(i, *best[i]) for i in sorted(best)]


def with_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """documents with `leaks`: array of (item_id, start, end, matched).

    One entry for each benchmark text that a stretch of the document repeats,
    with the stretch in words and how many of them are equal. Benchmark rows
    with equal words count as one, under their smallest id; rows without text or
    with fewer than SHORTEST words match nothing. NULL and empty documents and
    an empty benchmark give empty arrays. Entries are in the order of their
    fields. A column named leaks is replaced.
    """
    kind = benchmark.schema[item_id].dataType
    entry = T.StructType(
        [
            T.StructField("item_id", kind),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("matched", T.IntegerType()),
        ]
    )
    items = write_table(distinct_items(benchmark, item_id, item_text), "benchmark")
    words = (items.agg(F.sum(F.length("words"))).first()[0] or 0) // _WORD_BYTES
    blocks = math.ceil(words / BLOCK_WORDS)
    if blocks <= 1:
        found = _scan_block(documents, text, items, entry)
        return found.withColumn("leaks", F.array_sort("leaks"))
    numbered = write_table(documents.drop("leaks").withColumn(_ROW, F.monotonically_increasing_id()), "documents")
    path = scratch_path(documents.sparkSession, "leaks")
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)
        found = _scan_block(numbered.select(_ROW, text), text, part, entry)
        found.select(_ROW, F.explode("leaks").alias("leak")).write.mode("append").parquet(path)
    every = documents.sparkSession.read.schema(T.StructType([numbered.schema[_ROW], T.StructField("leak", entry)])).parquet(path)
    leaks = every.groupBy(_ROW).agg(F.array_sort(F.collect_list("leak")).alias("leaks"))
    joined = numbered.join(leaks, _ROW, "left").drop(_ROW)
    return joined.withColumn("leaks", F.coalesce("leaks", F.array().cast(T.ArrayType(entry))))


def distinct_items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(words, id): the distinct token sequences of a benchmark that can match."""

    def make():
        def compute(texts: pa.Array) -> list:
            return [pa.array([tokens(t).astype(_WORD).tobytes() for t in text_bytes(texts)], pa.binary())]

        return compute

    given = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    coded = append_columns(given, "text", [T.StructField("words", T.BinaryType())], make)
    worth = coded.where(F.length("words") >= SHORTEST * _WORD_BYTES)
    return worth.groupBy("words").agg(F.min("id").alias("id"))


def _scan_block(df: DataFrame, text: str, items: DataFrame, entry: T.StructType) -> DataFrame:
    """df with `leaks` of the items, which must fit into the driver and a task."""
    arrow = pa.list_(to_arrow_type(entry))
    rows = items.collect()
    texts = [np.frombuffer(r.words, _WORD).astype(np.uint64) for r in rows]
    ids = [r.id for r in rows]

    def make():
        index = Index(texts)

        def compute(column: pa.Array) -> list:
            found = [
                [
                    {"item_id": ids[i], "start": s, "end": e, "matched": n}
                    for i, s, e, n in _match(tokens(t), index)
                ]
                for t in text_bytes(column)
            ]
            return [pa.array(found, arrow)]

        return compute

    return append_columns(df, text, [T.StructField("leaks", T.ArrayType(entry))], make)
