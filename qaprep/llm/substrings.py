"""Near-duplicate passages by compact windows.

Under one hash function, all passages of a text that have their smallest hash
at place c, and no more than [a, b] around it, share that signature: a compact
window (a, c, b). The windows are the nodes of the Cartesian tree over the
hashes of the text's word shingles whose range is a passage long. Windows of
different texts with one signature are joined; pairs of texts that meet under
enough hash functions are verified shingle by shingle.

Copies of a text are one text. All pairs of a signature with few windows are
listed. The windows of any other are members of a hub, the first text of the
signature, and the members of a hub are compared in tiles of two blocks, all
with all: pairs that share too few shingles for a passage are passed over, and
so are pairs whose link could only lie within passages that the links to the
hub, or to other members that all were compared with, have put in one class.

What is kept on disk grows with the texts and not with their pairs: a piece of a
text goes to a few tiles, whatever the number of blocks, a tile sends one link
for each of its passages, and shuffles are freed with the job that needed them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from qaprep.llm.common import append_columns, components, slices, text_bytes, write_table

SHINGLE = 5
#: Words of a passage at least.
PASSAGE = 50
SIMILARITY = 0.8
#: Hash functions, and how many of them two texts must meet under.
HASHES, ENOUGH = 5, 2
#: Windows of a signature up to which all their pairs are listed.
LISTED_WINDOWS = 16
#: Members and words of a block, about; two blocks are compared at a time.
BLOCK, BLOCK_WORDS = 2_048, 1_000_000
#: Parts of a hub up to which each holds one block. Of more blocks they hold
#: several, up to so many members and words: a piece goes to a tile for each part.
PARTS, PART, PART_WORDS = 4, 1 << 16, 1 << 24
#: Texts to fetch up to which their list goes to every task.
LISTED_TEXTS = 1_000_000
SLICE = 2 << 20
_SEEDS = np.random.default_rng(53).integers(1, 1 << 63, HASHES + SHINGLE, np.uint64) | np.uint64(1)
_M = np.uint64(0x94D049BB133111EB)


def numbers_of(text: bytes) -> np.ndarray:
    """A number for each word in lower case."""
    words = text.lower().split()
    return np.fromiter(map(crc32, words), np.uint32, len(words))


def shingles(text: bytes | np.ndarray) -> np.ndarray:
    """Hash of every SHINGLE words of a text, or of their numbers; none if there are fewer."""
    numbers = (numbers_of(text) if isinstance(text, bytes) else text).astype(np.uint64)
    n = len(numbers) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        total += (numbers[i : i + n] + np.uint64(1)) * _SEEDS[HASHES + i]
    return total ^ (total >> np.uint64(31))


def _run_min(h: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every `width` neighbours, by doubling."""
    size, now = 1, h
    while size * 2 <= width:
        now = pick(now[:-size], now[size:])
        size *= 2
    rest = width - size
    return pick(now[: len(now) - rest], now[rest:]) if rest else now


def compact_windows(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, c, b) of each node of the Cartesian tree whose range is `width` at least.

    `h` holds hashes above zero, with zeros between texts and at both ends. A
    node's range is `width` long if and only if it is the smallest of some
    `width` neighbours, and the next smaller places on its sides are such
    places too or zeros; so the tree is built over these places only. Of equal
    hashes the leftmost counts as the smallest.
    """
    if len(h) <= width:
        return (np.zeros(0, np.int64),) * 3
    least = _run_min(h, width, np.minimum)
    reach = np.concatenate([np.zeros(width - 1, h.dtype), least, np.zeros(width - 1, h.dtype)])
    places = np.flatnonzero((_run_min(reach, width, np.maximum) == h) | (h == 0))
    values, at = h[places].tolist(), places.tolist()
    left, right = [0] * len(at), [len(h)] * len(at)
    stack: list[int] = []
    for i, value in enumerate(values):
        while stack and values[stack[-1]] > value:
            right[stack.pop()] = at[i]
        if stack:
            left[i] = at[stack[-1]] + 1
        stack.append(i)
    a, b = np.array(left), np.array(right) - 1
    good = (h[places] > 0) & (b - a + 1 >= width)
    return a[good], places[good], b[good]


WINDOW = "key long, text long, place long"
#: A window as one number, its ends in 32 bits each: a text has fewer words.
_END = 32


def _packed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (low << _END) | high


def windows(documents: DataFrame) -> DataFrame:
    """WINDOW rows of a `text` column."""
    width = PASSAGE - SHINGLE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # texts of this task
        for batch in batches:
            for start, stop in slices(batch.column(0), SLICE):
                parts, texts, offset = [np.zeros(1, np.uint64)], [], [0]
                for t in text_bytes(batch.column(0).slice(start, stop - start)):
                    name = xxhash.xxh64_intdigest(t, 42)
                    if name in seen:
                        continue
                    seen.add(name)
                    s = shingles(t)
                    if len(s) >= width:
                        parts += [s, np.zeros(1, np.uint64)]
                        texts.append(name)
                        offset.append(offset[-1] + len(s) + 1)
                if texts:
                    yield _slice_windows(np.concatenate(parts), np.array(texts, np.uint64), np.array(offset), width)

    return documents.select("text").mapInArrow(run, WINDOW)


def _slice_windows(all_: np.ndarray, texts: np.ndarray, offset: np.ndarray, width: int) -> pa.RecordBatch:
    gap = all_ == 0
    keys, owners, places = [], [], []
    for k in range(HASHES):
        h = (all_ ^ _SEEDS[k]) * _M
        h = (h ^ (h >> np.uint64(29))) * _SEEDS[k]
        h |= np.uint64(1)
        h[gap] = 0
        a, c, b = compact_windows(h, width)
        if not len(c):
            continue
        owner = np.searchsorted(offset, c) - 1
        # Of windows of one text with one signature closer than a passage, the
        # first reaches over the others.
        order = np.lexsort((c, h[c], owner))
        o, v, at = owner[order], h[c][order], c[order]
        near = (o[1:] == o[:-1]) & (v[1:] == v[:-1]) & (at[1:] - at[:-1] < width)
        keep = order[np.concatenate([[True], ~near])]
        base = offset[owner[keep]] + 1
        keys.append(h[c[keep]] * np.uint64(HASHES) + np.uint64(k))
        owners.append(texts[owner[keep]])
        places.append(_packed(a[keep] - base, b[keep] - base))
    key = np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64)
    owner = np.concatenate(owners or [np.zeros(0, np.uint64)]).view(np.int64)
    place = np.concatenate(places or [np.zeros(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner), pa.array(place)], ["key", "text", "place"])


MEETING = "hubbed boolean, text long, place long, first_text long, first_place long"


def meetings(documents: DataFrame) -> DataFrame:
    """MEETING rows: every pair of windows of a signature with LISTED_WINDOWS at
    most; of any other each window, with the first text as hub (`hubbed`), which
    is a member of its own. Of two texts the smaller comes first."""
    sorted_ = windows(documents).repartition("key").sortWithinPartitions("key", "text", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((3, 0), np.int64)  # of a key that may go on
        hub: tuple[int, int] | None = None  # key and first text, if their rows are too many to keep
        for batch in batches:
            new = np.stack([batch.column(i).to_numpy() for i in range(3)])
            hub, rows, found = _met(np.concatenate([rows, new], 1), hub, False)
            yield found
        yield _met(rows, hub, True)[2]

    return sorted_.mapInArrow(run, MEETING)


def _met(rows: np.ndarray, hub: tuple[int, int] | None, last: bool) -> tuple[tuple[int, int] | None, np.ndarray, pa.RecordBatch]:
    """Meetings of sorted (key, text, place) columns, the rows to go on with,
    and the hub of a key whose rows were sent but which may go on."""
    fresh = np.ones(rows.shape[1], bool)
    fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)  # copies of a text in several tasks
    rows = rows[:, fresh]
    out = []

    def members(part: np.ndarray, first: np.ndarray) -> None:
        if part.shape[1]:
            out.append([np.ones(part.shape[1], bool), part[1], part[2], first, np.zeros(part.shape[1], np.int64)])

    if hub is not None and rows.shape[1]:
        n = int(np.searchsorted(rows[0], hub[0], "right"))
        members(rows[:, :n], np.full(n, hub[1]))
        rows = rows[:, n:]
        if rows.shape[1]:
            hub = None
    starts = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]])) if rows.shape[1] else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, rows.shape[1]))
    kept = rows[:, :0]
    if len(starts) and not last:
        kept = rows[:, starts[-1] :]
        if kept.shape[1] > LISTED_WINDOWS and kept[1, 0] != kept[1, -1]:
            hub, kept = (int(kept[0, 0]), int(kept[1, 0])), rows[:, :0]
        else:
            rows, starts, sizes = rows[:, : starts[-1]], starts[:-1], sizes[:-1]
    size, start = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    big = size > LISTED_WINDOWS
    one = np.repeat(rows[1, starts] == rows[1, starts + sizes - 1], sizes) if len(starts) else big
    members(rows[:, big & ~one], rows[1, start[big & ~one]])
    part, start = rows[:, (size > 1) & ~big & ~one], start[(size > 1) & ~big & ~one]
    for d in range(1, LISTED_WINDOWS):
        at = np.flatnonzero((start[d:] == start[:-d]) & (part[1, d:] != part[1, :-d]))
        if len(at):
            low, high = part[:, at], part[:, at + d]
            out.append([np.zeros(len(at), bool), high[1], high[2], low[1], low[2]])
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, bool)] + [np.zeros(0, np.int64)] * 4
    names = ["hubbed", "text", "place", "first_text", "first_place"]
    return hub, kept, pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


#: Two passages of equal length have the similarity 0.8 if this share of each is
#: found in the other.
SHARE = 2 * SIMILARITY / (1 + SIMILARITY)


def longest(found: np.ndarray, width: int) -> list[tuple[int, int]]:
    """From the left, the longest stretches of which SHARE is found."""
    starts, ends = _edges(found).T
    gained = np.cumsum(ends - starts)
    # Sums of found - SHARE up to the end and the start of each run of found places.
    high = gained - SHARE * ends
    low = gained - (ends - starts) - SHARE * starts
    after = np.maximum.accumulate(high[::-1])[::-1]  # falls from left to right
    ends = ends[len(after) - 1 - np.searchsorted(after[::-1], low - 1e-9)]
    out, last = [], 0
    long = ends - starts >= width
    for s, e in zip(starts[long].tolist(), ends[long].tolist()):
        if s >= last:
            out.append((s, e))
            last = e
    return out


def dense(found: np.ndarray, width: int) -> list[tuple[int, int]]:
    """The maximal stretches of `width` or more of which SHARE is found at least.

    A found place gains 1 - SHARE and any other loses SHARE. A stretch is
    maximal if neither a part of it nor a longer one around it scores more. One
    pass over the runs of found places.
    """
    kept: list[tuple[float, float, int, int]] = []  # sums before and after, start, end
    total, last = 0.0, 0
    for s, e in _runs(found):
        low = total - SHARE * (s - last)
        high = low + (1 - SHARE) * (e - s)
        total, last = high, e
        while True:
            at = len(kept) - 1
            while at >= 0 and kept[at][0] >= low:
                at -= 1
            if at < 0 or kept[at][1] >= high:
                kept.append((low, high, s, e))
                break
            low, s = kept[at][0], kept[at][2]
            del kept[at:]
    return [(s, e) for _, _, s, e in kept if e - s >= width]


def _edges(found: np.ndarray) -> np.ndarray:
    """(start, end) of each run of found places."""
    padded = np.zeros(len(found) + 2, bool)
    padded[1:-1] = found
    return (padded[1:] != padded[:-1]).nonzero()[0].reshape(-1, 2)


def _runs(found: np.ndarray) -> list[list[int]]:
    return _edges(found).tolist()


def whole(found: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches of `width` or more that are found without a gap."""
    return [(s, e) for s, e in _runs(found) if e - s >= width]


#: Shingles of one text that a passage shared with another one holds at least;
#: of the other text, if none stands in it twice: so many of so long a range.
_LEAST = int(np.ceil(SHARE * (PASSAGE - SHINGLE + 1) - 1e-6))
_LEAST_OTHER = int(np.ceil(SIMILARITY * np.ceil(SIMILARITY * (PASSAGE - SHINGLE + 1) - 1e-6) - 1e-6))


def mates_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first place in b of the value at each place of a, or -1."""
    order = np.argsort(b, kind="stable")
    values = b[order]
    at = np.minimum(np.searchsorted(values, a), len(b) - 1)
    return np.where(values[at] == a, order[at], -1)


def _distinct(values: np.ndarray) -> np.ndarray:
    """np.unique, faster for short arrays."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def verified(a: np.ndarray, b: np.ndarray, partner: np.ndarray | None = None, simple: bool = False) -> list[tuple[int, int, int, int]]:
    """Passages of two shingle arrays alike enough: (start, end) in each, in words.

    `partner` is `mates_of(a, b)`, if it is at hand; `simple`: that no shingle
    stands twice in a, and none in b, is known.
    """
    width = PASSAGE - SHINGLE + 1
    partner = mates_of(a, b) if partner is None else partner
    found = partner >= 0
    places = found.nonzero()[0]
    partner = partner[places]
    shifts = partner - places
    open_ = found.copy()
    out, tried = [], set()
    # What fails the test as one long passage may hold shorter ones. A stretch
    # of a later cut lies within one that an earlier cut finds in the same places.
    for cut in (longest, dense, whole):
        stretches = cut(open_, width) if np.count_nonzero(open_) >= _LEAST else []
        passed = len(out) + len(stretches)
        for s, e in stretches:
            if (s, e) in tried:
                continue
            tried.add((s, e))
            i, j = places.searchsorted((s, e))
            mates, shift = partner[i:j], shifts[i:j]
            if simple and shift.max() - shift.min() <= 8 + (e - s) // 8:
                # All mates are kept, and what the two share is these.
                s2, e2, both = int(mates.min()), int(mates.max()) + 1, len(mates)
                if both >= SIMILARITY * (e - s + e2 - s2 - both) and e2 - s2 >= SIMILARITY * width:
                    out.append((s, e + SHINGLE - 1, s2, e2 + SHINGLE - 1))
                    open_[s:e] = False
                continue
            mid, half = np.sort(shift), len(shift) // 2
            # The median, as a whole number towards zero.
            median = mid[half] if len(mid) % 2 else int((mid[half - 1] + mid[half]) / 2)
            mates = mates[np.abs(shift - median) <= 8 + (e - s) // 8]
            if not len(mates):
                continue
            s2, e2 = int(mates.min()), int(mates.max()) + 1
            one = _distinct(a[s:e])
            more = b[e2 : max(s2 + e - s, e2)]  # repeated shingles
            if len(more):
                there = one[np.minimum(np.searchsorted(one, more), len(one) - 1)] == more
                e2 += len(more) if there.all() else int(there.argmin())
            two = _distinct(b[s2:e2])
            both = len(one) + len(two) - len(_distinct(np.concatenate([one, two])))
            if both >= SIMILARITY * (len(one) + len(two) - both) and e2 - s2 >= SIMILARITY * width:
                out.append((s, e + SHINGLE - 1, s2, e2 + SHINGLE - 1))
                open_[s:e] = False
        # A later cut finds something only within what failed.
        if len(out) == passed:
            break
    return out


#: Columns of the matrices of shared shingles that are held at a time, and pairs
#: of places that are.
_COLUMNS, _PAIRS = 1_024, 1 << 21
#: A shingle goes to the matrices if over one in so many pairs have it.
_RARE = 32


#: Members of a tile that all others are compared with, at most, and open pairs
#: for each member up to which no further one is worth it.
REFERENCES, FEW = 24, 8


class _Shared:
    """Which shingles of a tile's arrays stand in several of them."""

    def __init__(self, arrays: list[np.ndarray]):
        self.m = len(arrays)
        sizes = np.array([len(x) for x in arrays])
        values, number = np.unique(np.concatenate(arrays), return_inverse=True)
        self.numbers = np.split(number, np.cumsum(sizes)[:-1])
        owner = np.repeat(np.arange(self.m), sizes)
        cells, self.at = np.unique(number * self.m + owner, return_inverse=True)
        number, owner = np.divmod(cells, self.m)
        #: Arrays without a shingle that stands in them twice.
        self.simple = np.bincount(owner, minlength=self.m) == sizes
        self._place, self._placed = np.full(len(values), -1, np.int32), -1
        self.common = np.bincount(number, minlength=len(values))[number] > 1
        self.owner, number = owner[self.common], number[self.common]
        new = np.concatenate([[False], number[1:] != number[:-1]]) if len(number) else np.zeros(0, bool)
        self.number = np.cumsum(new)
        #: Arrays that share enough with all others together to be linked with one.
        places = np.bincount(np.repeat(np.arange(self.m), sizes), self.common[self.at], self.m)
        self.able = places >= np.where(self.simple, _LEAST_OTHER, 1)

    def mates(self, x: int, y: int) -> np.ndarray:
        """`mates_of` the arrays x and y; fastest for one y after another."""
        if self._placed != y:
            if self._placed >= 0:
                self._place[self.numbers[self._placed]] = -1
            self._placed, own = y, self.numbers[y][::-1]
            self._place[own] = np.arange(len(own) - 1, -1, -1)
        return self._place[self.numbers[x]]

    def sums(self, left: np.ndarray, right: np.ndarray, weights: np.ndarray, there: np.ndarray | None = None) -> np.ndarray:
        """For (left, right) and (right, left): the weights of the one's places
        whose shingle the other has too (`there`: at such places).

        Shingles of many pairs are counted as products of matrices, and of any
        other the pairs that have it are listed."""
        out = np.zeros((2, len(left), len(right)), np.float32)
        if not len(self.number):
            return out
        weight = np.bincount(self.at, weights, len(self.common))[self.common]
        has = np.ones(len(weight), bool) if there is None else (np.bincount(self.at, there, len(self.common)) > 0)[self.common]
        row, column = np.full((2, self.m), -1)
        row[left], column[right] = np.arange(len(left)), np.arange(len(right))
        row, column = row[self.owner], column[self.owner]
        n = int(self.number[-1]) + 1
        rows, columns = np.bincount(self.number[row >= 0], minlength=n), np.bincount(self.number[column >= 0], minlength=n)
        often = rows * columns * _RARE > out[0].size
        self._products(out, often, row, column, weight, has)
        rare = ((rows > 0) & (columns > 0) & ~often)[self.number]
        one, two = np.flatnonzero(rare & (row >= 0)), np.flatnonzero(rare & (column >= 0))
        mates = columns[self.number[one]]
        begin = np.searchsorted(self.number[two], self.number[one])
        before = np.concatenate([[0], np.cumsum(mates)])
        i = 0
        while i < len(one):
            j = max(i + 1, int(np.searchsorted(before, before[i] + _PAIRS, "right")) - 1)
            x = np.repeat(one[i:j], mates[i:j])
            y = two[np.arange(len(x)) + np.repeat(begin[i:j] - before[i:j] + before[i], mates[i:j])]
            pair = row[x] * len(right) + column[y]
            for k, (a, b) in enumerate(((x, y), (y, x))):
                out[k] += np.bincount(pair, weight[a] * has[b], out[k].size).reshape(out[k].shape)
            i = j
        return out

    def _products(self, out: np.ndarray, often: np.ndarray, row: np.ndarray, column: np.ndarray, weight: np.ndarray, has: np.ndarray) -> None:
        cells = np.flatnonzero(often[self.number])
        number = (np.cumsum(often) - 1)[self.number[cells]]
        for first in range(0, int(often.sum()), _COLUMNS):
            a, b = np.searchsorted(number, (first, first + _COLUMNS))
            sides = []
            for place, size in ((row, out.shape[1]), (column, out.shape[2])):
                cell = cells[a:b][place[cells[a:b]] >= 0]
                at = place[cell], (number[a:b] - first)[place[cells[a:b]] >= 0]
                heavy, holds = np.zeros((2, size, min(_COLUMNS, int(often.sum()) - first)), np.float32)
                heavy[at], holds[at] = weight[cell], has[cell]
                sides.append((heavy, holds))
            out[0] += sides[0][0] @ sides[1][1].T
            out[1] += sides[0][1] @ sides[1][0].T


def linked_pairs(shared: _Shared, arrays: list[np.ndarray], names: np.ndarray, left: np.ndarray, right: np.ndarray, between) -> Iterator[tuple[int, int, list]]:
    """(x, y, links) of pairs of `left` and `right`, and of both with references.
    Of a pair, the text with the larger name is searched in the other.

    Array 0, the hub, is the first reference; others are members with many open
    pairs. A pair is left out if it shares fewer shingles than a passage, or if
    its links could only lie within one passage found so far of each, and links
    found so far tie these. So it is if outside of these passages the two share
    too little for a link, nothing near enough for a longer one, and nothing of
    the other's passage. `between(x, y)` gives (start, stop, start in y, stop in
    y), in words.
    """
    members = np.union1d(left, right)
    ends = np.cumsum([0] + [len(x) for x in arrays])
    every = np.ones(ends[-1])

    def enough(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        sums = shared.sums(one, two, every)
        return np.where(names[one][:, None] > names[two], sums[0], sums[1]) >= _LEAST

    open_ = np.zeros((len(left), len(right)), bool)
    able = shared.able[left], shared.able[right]
    open_[np.ix_(*able)] = enough(left[able[0]], right[able[1]])
    if left is right:
        open_ &= left[:, None] < right[None]
    out, ref, tried = [], 0, np.zeros(len(arrays), bool)
    while True:
        tried[ref] = True
        open_[left == ref] = False
        open_[:, right == ref] = False
        near_ref = enough(members, np.array([ref]))[:, 0]
        out += [(x, ref, found) for x in members[near_ref & (members != ref)].tolist() if (found := between(x, ref))]
        if not open_.any():
            break
        inside, near = np.zeros((2, ends[-1]), bool)
        group = -1 - np.arange(len(arrays))
        for x, (start, stop, number) in _main_passages(out).items():
            group[x] = number
            start, stop = ends[x] + start, ends[x] + stop - SHINGLE + 1
            # A stretch that leaves the passage bridges no more than its share.
            reach = int((stop - start + _LEAST) * (1 - SHARE) / SHARE) + 2
            near[max(start - reach, ends[x]) : min(stop + reach, ends[x + 1])] = True
            inside[start:stop] = True
        # Only of members with open pairs.
        at = np.ix_(open_.any(1), open_.any(0))
        some = left[open_.any(1)], right[open_.any(0)]
        more = shared.sums(*some, ~inside) >= _LEAST
        more |= (shared.sums(*some, near & ~inside) > 0) | (shared.sums(*some, ~inside, inside) > 0)
        open_[at] &= (group[some[0]][:, None] != group[some[1]]) | more.any(0)
        now = int(open_.sum())
        if now <= FEW * len(members) or tried.sum() >= REFERENCES:
            break
        degree = np.bincount(left, open_.sum(1), len(arrays)) + np.bincount(right, open_.sum(0), len(arrays))
        ref = int(np.argmax(np.where(tried, -1, degree)))
    yield from out
    for i in np.flatnonzero(open_.any(1)).tolist():
        x = int(left[i])
        for y in right[open_[i]].tolist():
            yield x, y, between(x, y)


def _main_passages(found: list[tuple[int, int, list]]) -> dict[int, tuple[int, int, int]]:
    """Of each linked array the longest passage, merged from overlapping ends of
    links, and the number of its class."""
    flat = np.array([(x, *link[:2], y, *link[2:]) for x, y, passages in found for link in passages], np.int64)
    if not len(flat):
        return {}
    text, start, stop, root = _passages(flat)
    order = np.lexsort((start, start - stop, text))
    first = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
    return dict(zip(text[first].tolist(), zip(*(c[first].tolist() for c in (start, stop, root)))))


def _passages(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, stop) of the passages that the ends of LINK rows overlap to,
    in this order, and the number of the first passage of each one's class."""
    text, start, stop = np.concatenate([flat[:, :3], flat[:, 3:]]).T
    order = np.lexsort((start, text))
    text, start, stop = text[order], start[order], stop[order]
    new = np.concatenate([[True], text[1:] != text[:-1]])
    # The furthest stop so far: that of earlier texts is below any of this one.
    base = np.cumsum(new) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + base) - base
    new[1:] |= start[1:] >= reach[:-1]
    at = np.flatnonzero(new)
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(new) - 1
    one, two = node.reshape(2, -1)
    root = np.arange(len(at))
    while len(one):
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root = root[root]
        one, two = root[one], root[two]
        one, two = one[one != two], two[one != two]
    return text[at], start[at], reach[np.append(at[1:], len(new)) - 1], root


def compare(hubbed: bool, diagonal: bool, rows: list[tuple[int, int, int, bytes | np.ndarray]]) -> list[tuple]:
    """LINK rows of (text, side, start, piece), sorted by side and text.

    A piece is text, or the numbers of its words.
    Without a hub the rows are one pair. With one, the hub has the side -1; the
    members of the sides 0 and 1, or if `diagonal` all, are compared.
    """
    return list(_compared(hubbed, diagonal, rows))


def _compared(hubbed: bool, diagonal: bool, rows: list[tuple[int, int, int, bytes | np.ndarray]]) -> Iterator[tuple]:
    names, sides, starts = ([r[i] for r in rows] for i in range(3))
    arrays = [shingles(r[3]) for r in rows]
    shared = _Shared(arrays) if hubbed else None

    def between(x: int, y: int) -> list[tuple[int, int, int, int]]:
        if names[x] < names[y]:  # always asked the same way
            return [(s, e, s2, e2) for s2, e2, s, e in between(y, x)]
        if not len(arrays[x]) or not len(arrays[y]):
            return []
        if shared is None:
            return verified(arrays[x], arrays[y])
        return verified(arrays[x], arrays[y], shared.mates(x, y), shared.simple[x] and shared.simple[y])

    if shared is not None:
        sides_ = np.array(sides)
        left = np.flatnonzero(sides_ == 0)
        right = left if diagonal else np.flatnonzero(sides_ == 1)
        if not len(left) or not len(right):
            return
        found: Iterable = linked_pairs(shared, arrays, np.array(names), left, right, between)
    else:
        found = [(0, 1, between(0, 1))]
    for x, y, passages in found:
        for s, e, s2, e2 in passages:
            ends = (names[x], starts[x] + s, starts[x] + e), (names[y], starts[y] + s2, starts[y] + e2)
            yield max(ends) + min(ends)


def _blocks(rows: list[tuple]) -> list[list[tuple]]:
    """Rows of (text, side, start, piece) in blocks of equal numbers."""
    n = max(-(-len(rows) // BLOCK), -(-sum(len(r[3]) for r in rows) // BLOCK_WORDS))
    return [rows[len(rows) * i // n : len(rows) * (i + 1) // n] for i in range(n)]


def compare_tile(diagonal: bool, rows: list[tuple[int, int, int, np.ndarray]]) -> Iterator[tuple]:
    """LINK rows of a hub's tile, whose sides may hold several blocks."""
    hub, sides = rows[0], [_blocks([r for r in rows[1:] if r[1] == side]) for side in (0, 1)]
    for i, one in enumerate(sides[0]):
        if diagonal:
            yield from _compared(True, True, [hub, *one])
        for other in sides[0][:i] if diagonal else sides[1]:
            yield from _compared(True, False, [hub, *one, *[(t, 1, s, p) for t, _, s, p in other]])


def compare_listed(rows: list[tuple[int, int, int, np.ndarray, int, int]]) -> Iterator[tuple]:
    """LINK rows of a text, the first row, and each of its partners; a partner's
    row ends with the part of the first one that their windows span."""
    first, _, begin, words, _, _ = rows[0]
    for text, _, start, piece, lo, hi in rows[1:]:
        own = max(lo - PASSAGE, 0)
        one = words[own - begin : hi + PASSAGE + SHINGLE - 1 - begin]
        yield from _compared(False, True, [(first, -1, own, one), (text, 0, start, piece)])


#: Links that are held before they are reduced, and up to which they are not.
_HELD, _FEW_LINKS = 50_000, 64


def reduced(found: Iterable[tuple]) -> list[tuple]:
    """LINK rows with the passages and classes of those given, fewer if they are many."""
    held: list[tuple] = []
    most = _HELD
    for row in found:
        held.append(row)
        if len(held) >= most:
            held = forest(held)
            most = _HELD + 2 * len(held)
    return forest(held) if len(held) > _FEW_LINKS else held


def forest(found: list[tuple]) -> list[tuple]:
    """LINK rows that tie the same passages: ends that overlap in a text are one,
    and each is tied to the smallest of its class."""
    text, start, stop, root = _passages(np.array(found, np.int64).reshape(-1, 6))
    tied = np.flatnonzero(root != np.arange(len(root)))
    ends = [c[i].tolist() for i in (tied, root[tied]) for c in (text, start, stop)]
    return list(zip(*ends))


LINK = "text long, start int, stop int, first_text long, first_start int, first_stop int"
TILE = ["hubbed", "one", "tile", "diagonal"]


def tiles(met: DataFrame) -> DataFrame:
    """(hubbed, one, parts, part, text, lo, hi, first_lo, first_hi): for each text
    of a pair, and for each member of a hub, what its tiles follow from. The first
    text of listed pairs and of a hub, `one`, is in the part -1."""
    pairs = met.where(~F.col("hubbed") & (F.col("meets") >= ENOUGH))
    none = [F.lit(0).alias("first_lo"), F.lit(0).alias("first_hi")]
    partners = pairs.select(
        "hubbed", F.col("first_text").alias("one"), F.lit(1).alias("parts"), F.lit(0).alias("part"), "text",
        F.col("lo").cast("int"), F.col("hi").cast("int"), F.col("first_lo").cast("int"), F.col("first_hi").cast("int"),
    )
    firsts = pairs.groupBy("hubbed", F.col("first_text").alias("one")).agg(F.min("first_lo").alias("lo"), F.max("first_hi").alias("hi")).select(
        "hubbed", "one", F.lit(1).alias("parts"), F.lit(-1).alias("part"), F.col("one").alias("text"),
        F.col("lo").cast("int"), F.col("hi").cast("int"), *none,
    )
    spokes = met.where("hubbed").select("hubbed", F.col("first_text").alias("one"), "text", "lo", "hi")
    n, words = F.count("*"), F.sum(F.col("hi") - F.col("lo"))
    blocks = F.greatest(F.ceil(n / BLOCK), F.ceil(words / BLOCK_WORDS))
    parts = F.least(blocks, F.greatest(F.lit(PARTS), F.ceil(n / PART), F.ceil(words / PART_WORDS)))
    sizes = spokes.groupBy("one").agg(parts.cast("int").alias("parts"))
    part = F.when(F.col("text") == F.col("one"), -1).otherwise(F.pmod(F.xxhash64("text", F.lit(7)), "parts"))
    members = spokes.join(sizes, "one").select(
        "hubbed", "one", "parts", part.cast("int").alias("part"), "text", F.col("lo").cast("int"), F.col("hi").cast("int"), *none
    )
    return partners.union(firsts).union(members)


#: Frees the shuffles of a job when it ends.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _saved(df: DataFrame, name: str) -> DataFrame:
    """`write_table`; the shuffles that led to the table are not kept with it."""
    conf = df.sparkSession.conf
    before = conf.get(_FREED, None)
    conf.set(_FREED, "true")
    try:
        return write_table(df, name)
    finally:
        conf.unset(_FREED) if before is None else conf.set(_FREED, before)


def _numbered(texts: DataFrame) -> DataFrame:
    """(text, words): the numbers of the words of (text_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1), SLICE):
                part = batch.slice(start, stop - start)
                words = [numbers_of(t).tobytes() for t in text_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.binary())], ["text", "words"])

    return texts.select("text_id", "text").mapInArrow(run, "text long, words binary")


def links(documents: DataFrame) -> DataFrame:
    """LINK rows: passages of two texts of one class. Their ends are all that was
    verified, or what such ends overlap to. `documents` has (text_id, text)."""
    met = _saved(
        meetings(documents).groupBy("hubbed", "text", "first_text").agg(
            F.count("*").alias("meets"),
            F.min(_low("place")).alias("lo"), F.max(_high("place")).alias("hi"),
            F.min(_low("first_place")).alias("first_lo"), F.max(_high("first_place")).alias("first_hi"),
        ).where(F.col("hubbed") | (F.col("meets") >= ENOUGH)),
        "pairs",
    )
    ends = tiles(met)
    need = _saved(met.select(F.col("text").alias("text_id")).union(met.select("first_text")).distinct(), "texts")
    if need.count() <= LISTED_TEXTS:
        numbered = _numbered(documents.join(F.broadcast(need), "text_id", "left_semi"))
    else:
        numbered = _numbered(documents).join(need.withColumnRenamed("text_id", "text"), "text", "left_semi")
    own = numbered.groupBy("text").agg(F.first("words").alias("words"))
    # Of each text only the numbers of the words around its windows go to its tiles.
    fields = ["hubbed", "one", "parts", "part", "text", "lo", "hi", "first_lo", "first_hi"]
    schema = "hubbed boolean, one long, parts int, part int, text long, first_lo int, first_hi int, start int, piece binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, pieces = [], []
            for lo, hi, words in zip(*(batch.column(i).to_pylist() for i in (5, 6)), batch.column(9)):
                starts.append(max(lo - PASSAGE, 0))
                numbers = np.frombuffer(words.as_buffer(), np.uint32)
                pieces.append(numbers[starts[-1] : hi + PASSAGE + SHINGLE - 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in (0, 1, 2, 3, 4, 7, 8)), pa.array(starts, pa.int32()), pa.array(pieces, pa.binary())],
                [*fields[:5], *fields[7:], "start", "piece"],
            )

    pieces = ends.join(own, "text").select(*fields, "words").mapInArrow(cut, schema)
    n, part = F.col("parts"), F.col("part")
    with_all = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.least(part, o) * n + F.greatest(part, o))
    of_first = F.filter(F.sequence(F.lit(0), n * n - 1), lambda t: F.floor(t / n) <= t % n)
    spread = pieces.withColumn("tile", F.explode(F.when(part < 0, of_first).otherwise(with_all)))
    high, low = F.floor(F.col("tile") / n), F.col("tile") % n
    side = F.when(part < 0, -1).when(part == high, 0).otherwise(1)
    dealt = spread.select(
        "hubbed", "one", "tile", (high == low).alias("diagonal"), side.alias("side"), "text", "start", "piece",
        "first_lo", "first_hi",
    ).repartition(*TILE).sortWithinPartitions(*TILE, "side", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["text", "start", "stop", "first_text", "first_start", "first_stop"]
        kinds = [pa.int64(), pa.int32(), pa.int32()] * 2
        tile, held, found = None, [], []

        def links_of(tile: tuple, held: list[tuple]) -> list[tuple]:
            return reduced(compare_tile(tile[3], [r[:4] for r in held]) if tile[0] else compare_listed(held))

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kinds[i]) for i in range(6)], names)

        for batch in batches:
            for *now, side_, text, start, piece, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                if now != tile:
                    if held:
                        found += links_of(tile, held)
                    tile, held = now, []
                    if len(found) > 10_000:
                        yield done()
                        found = []
                held.append((text, side_, start, np.frombuffer(piece, np.uint32), lo, hi))
        if held:
            found += links_of(tile, held)
        yield done()

    # Two texts may be members of several hubs.
    return dealt.mapInArrow(run, LINK).distinct()


def _low(place: str):
    return F.shiftright(place, _END)


def _high(place: str):
    return F.col(place).bitwiseAND(F.lit((1 << _END) - 1)) + 1


def duplicate_passages(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, stop, class_id): each passage that another row has too.

    Places are words, the end is exclusive. `class_id` is the smallest id of a
    row with a passage of the same class; classes are connected by verified
    links. Texts of under PASSAGE words, NULL and empty ones have no passages. A
    text that stands in several rows is one passage as a whole. A class whose
    rows have no id has a NULL one. Other columns are not read.
    """
    documents = df.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("text_id", F.xxhash64("text"))
    rows = _saved(
        append_columns(documents, "text", [T.StructField("n_words", T.IntegerType())], _counter).drop("text"),
        "texts",
    )
    linked = _saved(links(documents), "links")
    whole = (
        rows.groupBy("text_id").agg(F.count("*").alias("n"), F.max("n_words").alias("stop"))
        .where((F.col("n") > 1) & (F.col("stop") >= PASSAGE))
        .select(F.col("text_id").alias("text"), F.lit(0).alias("start"), "stop")
    )
    ends = linked.select("text", "start", "stop").union(
        linked.select("first_text", "first_start", "first_stop")
    ).union(whole)
    # At most one row for each word of a text.
    longest = ends.groupBy("text", "start").agg(F.max("stop").alias("stop"))
    by = W.partitionBy("text").orderBy("start")
    before = F.max("stop").over(by.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") >= before), F.col("start"))
    merged = longest.withColumn("opens", opens).withColumn(
        "passage", F.last("opens", ignorenulls=True).over(by)
    )
    merged = _saved(
        merged.select("text", "start", "stop", "passage", F.xxhash64("text", "passage").alias("node")), "passages"
    )
    nodes = merged.select("text", "start", "node")
    edges = (
        linked.select("text", "start", "first_text", "first_start")
        .join(nodes, ["text", "start"])
        .join(
            nodes.select(F.col("text").alias("first_text"), F.col("start").alias("first_start"), F.col("node").alias("other")),
            ["first_text", "first_start"],
        )
        .select("node", "other")
    )
    groups = components(edges)
    passages = merged.groupBy("text", "node").agg(F.min("passage").alias("start"), F.max("stop").alias("stop"))
    labelled = passages.join(groups, "node", "left").select(
        "text", "start", "stop", F.coalesce("component", "node").alias("class")
    )
    held = _saved(
        rows.join(labelled, rows.text_id == labelled.text).select("id", "start", "stop", "class"), "held"
    )
    least = held.groupBy("class").agg(F.min("id").alias("class_id"))
    return held.join(least, "class").select(F.col("id").alias(id_column), "start", "stop", "class_id")


#: Whether a byte parts words.
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\v\f"))


def _counter():
    def compute(texts: pa.Array) -> list:
        parts = text_bytes(texts)
        # Words start after a space; each text is given one in front.
        space = _SPACE[np.frombuffer(b" " + b" ".join(parts), np.uint8)]
        starts = np.concatenate([[0], np.cumsum(space[:-1] & ~space[1:])])
        ends = np.cumsum([len(t) + 1 for t in parts])
        return [pa.array(np.diff(starts[ends - 1], prepend=0), pa.int32())]

    return compute
