"""Runs: maximal stretches of words that repeat with a period.

The texts of a slice stand behind each other in one array of word numbers, with
unlike numbers between them. Every run of period p and of two periods at least
holds two neighbouring places of the grid 0, p, 2p, ...; so it is found from one
of the (n/1 + n/2 + ...) pairs of the grids whose words agree, by extending the
pair to both sides. How far a pair extends is one longest-common-extension
query: a few words are compared until both places are in a difference cover,
and the rest follows from the order of the sampled suffixes with a table of
range minima. The work of a text grows with n log n, whatever it repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from qaprep.llm.common import append_columns, text_bytes

#: Places modulo PERIOD that are sampled. Each difference modulo
#: PERIOD is that of two of them.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
#: Pairs of places that are extended at once.
PAIRS = 1 << 18
LEAST_LENGTH = 12

RUNS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False
)


def _shifts() -> np.ndarray:
    """For i and j - i, both modulo PERIOD, how far until both are sampled."""
    table = np.zeros((PERIOD, PERIOD), np.int64)
    for difference in range(PERIOD):
        first = next(c for c in COVER if (c + difference) % PERIOD in COVER)
        table[:, difference] = (first - np.arange(PERIOD)) % PERIOD
    return table


SHIFTS = _shifts()
SLOTS = np.full(PERIOD, -1)
SLOTS[list(COVER)] = np.arange(len(COVER))


class Extensions:
    """Longest common prefixes of the suffixes of an array of words."""

    def __init__(self, words: np.ndarray):
        # Unlike numbers behind the end, so that every sampled block is whole
        # and no two suffixes are equal.
        words = np.concatenate([words, words.max(initial=0) + 1 + np.arange(2 * PERIOD)])
        self.words = words
        blocks = len(words) // PERIOD - 1
        places = (np.arange(blocks)[:, None] * PERIOD + np.array(COVER)).ravel()
        levels = [_blocks(words, places)]
        reach = len(COVER)  # samples until the next one of the same residue
        while levels[-1].max(initial=0) + 1 < len(places):
            now = levels[-1].astype(np.int64)
            after = np.zeros(len(now), np.int64)
            after[:-reach] = now[reach:] + 1
            levels.append(np.unique(now * (len(now) + 1) + after, return_inverse=True)[1])
            reach *= 2
        self.rank = levels[-1]
        order = np.empty(len(places), np.int64)
        order[self.rank] = np.arange(len(places))
        self.minima = [_neighbours(levels, order)]
        width = 1
        while 2 * width <= len(self.minima[0]):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _agree(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words agree from i and j on, at most `limit`."""
        length = np.zeros(len(i), np.int64)
        active = np.arange(len(i))
        for t in range(PERIOD):
            active = active[limit[active] > t]
            active = active[self.words[i[active] + t] == self.words[j[active] + t]]
            if not len(active):
                break
            length[active] += 1
        return length

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and at j > i."""
        shift = SHIFTS[i % PERIOD, (j - i) % PERIOD]
        length = self._agree(i, j, shift)
        on = np.flatnonzero(length == shift)
        if len(on):
            a, b = i[on] + shift[on], j[on] + shift[on]
            blocks = self._equal_blocks(self._sample(a), self._sample(b)) * PERIOD
            rest = self._agree(a + blocks, b + blocks, np.full(len(on), PERIOD))
            length[on] += blocks + rest
        return length

    def _sample(self, places: np.ndarray) -> np.ndarray:
        return places // PERIOD * len(COVER) + SLOTS[places % PERIOD]

    def _equal_blocks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.sort([self.rank[a], self.rank[b]], axis=0)
        spread = high - low
        out = np.zeros(len(a), np.int64)
        level = np.frexp(np.maximum(spread, 1))[1] - 1
        for k in np.unique(level[spread > 0]).tolist():
            at = np.flatnonzero((level == k) & (spread > 0))
            table = self.minima[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return out


def _blocks(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers of the PERIOD words from each place on, equal where these are equal.

    They are grouped by a random sum; a group whose members differ is summed
    anew with other weights.
    """
    windows = np.lib.stride_tricks.sliding_window_view(words, PERIOD)[places]
    for seed in range(1 << 30):
        weights = np.random.default_rng(seed).integers(1, 1 << 62, PERIOD, dtype=np.int64) | 1
        with np.errstate(over="ignore"):
            sums = windows @ weights
        _, first, number = np.unique(sums, return_index=True, return_inverse=True)
        if np.array_equal(windows[first[number]], windows):
            return number
    raise AssertionError("no weights tell the blocks apart")


def _neighbours(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Common blocks of each sampled suffix and the next one in their order."""
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = len(COVER) << k
        inside = np.flatnonzero(np.maximum(a, b) < len(order))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        common[same] += 1 << k
        a[same] += step
        b[same] += step
    return common


def _grid_pairs(words: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of neighbours in the grids of all periods, if their words agree."""
    places, periods, held = [], [], 0
    for period in range(1, longest + 1):
        grid = words[::period]
        found = np.flatnonzero(grid[1:] == grid[:-1])
        if len(found):
            places.append(found * period)
            periods.append(np.full(len(found), period))
            held += len(found)
        if held >= PAIRS:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def runs_of(words: np.ndarray, longest: int, least: int = LEAST_LENGTH) -> tuple[np.ndarray, ...]:
    """(start, end, smallest period) of the runs, by start and period.

    `words` begins and ends with a number that occurs nowhere else; no run is
    sought with a period above `longest`.
    """
    n = len(words)
    forward = backward = None
    found = [np.zeros((3, 0), np.int64)]
    for i, period in _grid_pairs(words, longest):
        if forward is None:
            forward, backward = Extensions(words), Extensions(np.ascontiguousarray(words[::-1]))
        after = forward(i, i + period)
        before = backward(n - i - period, n - i)
        keep = before + after + period >= np.maximum(least, 2 * period)
        start = (i - before)[keep]
        end = (i + period + after)[keep]
        found.append(_smallest(np.stack([start, end, period[keep]])))
    start, end, period = _smallest(np.concatenate(found, axis=1))
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """The smallest period of each stretch; its multiples found the same one."""
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (runs[:2, 1:] != runs[:2, :-1]).any(axis=0)
    return runs[:, new]


def _laid_out(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts with unlike numbers around each, and their starts."""
    flat = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
    lengths = np.array([len(words) for words in texts], np.int64)
    # Other numbers than those of words occur once each.
    starts = np.cumsum(lengths + 1) - lengths
    out = len(flat.dictionary) + np.arange(1 + len(flat) + len(texts))
    if flat:
        inside = np.arange(len(flat)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        out[inside] = flat.indices.to_numpy()
    return out, starts


def _compute(texts: pa.Array, least: int) -> list:
    split = [t.split() for t in text_bytes(texts)]  # of bytes: parts at ASCII only
    sought = [k for k, words in enumerate(split) if len(words) >= least]
    collapsed = [b" ".join(words) for words in split]
    counts = np.zeros(len(split), np.int64)
    found = np.zeros((3, 0), np.int64)
    if sought:
        longest = max(len(split[k]) for k in sought) // 2
        words, starts = _laid_out([split[k] for k in sought])
        start, end, period = runs_of(words, longest, least)
        owner = np.searchsorted(starts, start, "right") - 1
        counts += np.bincount(np.array(sought)[owner], minlength=len(split))
        found = np.stack([start - starts[owner], end - start, period])
        inner = np.zeros(len(words) + 1, np.int64)
        np.add.at(inner, start + period, 1)
        np.add.at(inner, end, -1)
        dropped = np.cumsum(inner) > 0
        for o in np.unique(owner).tolist():
            own = split[sought[o]]
            gone = dropped[starts[o] : starts[o] + len(own)].tolist()
            collapsed[sought[o]] = b" ".join(w for w, g in zip(own, gone) if not g)
    fields = [pa.array(x, pa.int64()) for x in found]
    structs = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    kind = pa.list_(pa.field("element", structs.type, False))
    return [pa.ListArray.from_arrays(offsets, structs).cast(kind), pa.array(collapsed, pa.binary()).cast(pa.string())]


def with_runs(df: DataFrame, text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """df with `runs` and `collapsed`.

    Words are what the ASCII whitespace parts. A run is a stretch of at least
    `least` words and two periods that cannot be extended; it is reported once,
    with its smallest period, by start and then period. Runs may overlap.
    `collapsed` has the words that no run repeats, joined by one space: of each
    run the first period stays.

    NULL and empty texts have no runs and collapse to an empty text. Each row
    is treated by itself, so repeated rows get equal results. Columns of df
    named like the new ones are replaced.
    """
    fields = [T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    return append_columns(df, text, fields, lambda: lambda texts: _compute(texts, least))
