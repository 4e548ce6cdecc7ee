"""Spelling variants: words one edit apart, and the usual form of each word.

One inserted, deleted or replaced letter changes the vector of letter counts by
an L1 distance of two at most. For each length there is a k-d tree over the
vectors of the words of that length. A word is sought in the tree of its own
length (one count up and one down) and in that of the next length (one count
up); a branch is entered only if its box can be reached with the counts that may
still change. Words that are left are compared letter by letter.

The upper part of the trees, fitted on a sample, deals the words to cells; what
a cell holds is searched by a tree of its own. The sample decides how even the
cells are and nothing else.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaprep.llm.common import slices, text_bytes, write_table

#: Letters a-z and U+00C0 to U+00FF as UTF-8, after A-Z were lower-cased.
LETTERS = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: Letters a-z have a count each; all others share the rest of them.
COUNTS = 32
#: Words that a cell of the upper trees should hold.
CELL = 8_000
#: Words that one task holds of a cell; a larger cell is cut into such blocks.
BLOCK = 32_768
#: Words the upper trees are fitted on.
SAMPLE = 50_000
LEAF = 160
#: Pairs of a leaf that are compared at once.
COMPARED = 1 << 17
#: Words that search a cell at once.
SEARCHED = 2_048
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000

Tree = tuple | int


def count_words(
    df: DataFrame,
    text: str = "text",
    id_column: str | None = None,
    change: Callable[[str, bytes], bytes] | None = None,
) -> DataFrame:
    """(word, n): runs of Latin letters in all texts, A-Z lower-cased.

    `change(id, word)` may replace a word of a document, in UTF-8. It is not
    asked where the id is NULL. NULL texts have no words, repeated rows count
    again, and other columns are not read.
    """
    named = F.col(id_column).cast("string") if id_column else F.lit(None).cast("string")
    rows = df.select(F.col(text).alias("text"), named.alias("id"))

    def out(counts: Counter) -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                part = batch.slice(start, stop - start)
                for body, name in zip(text_bytes(part.column(0)), part.column(1).to_pylist()):
                    found = LETTERS.findall(body.lower())
                    if change is None or name is None:
                        counts.update(found)
                        continue
                    for word, n in Counter(found).items():
                        counts[change(name, word)] += n
                if len(counts) > COUNTED:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    parts = rows.mapInArrow(run, "word string, n long").where(F.col("word") != "")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def drop_letter(name: str, word: bytes) -> bytes:
    """The word without a letter that a hash of document and word chooses, or as it is."""
    number = zlib.crc32(word, zlib.crc32(f"{name}:".encode()))
    if number % 97:
        return word
    letters = word.decode()
    at = number % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.array(words, dtype=np.str_).view(np.uint32).reshape(len(words), -1)


def _vectors(points: np.ndarray) -> np.ndarray:
    """Letter counts of each row of code points."""
    letters = points.astype(np.int64) - ord("a")
    letters = np.where((letters >= 0) & (letters < 26), letters, 26 + letters % (COUNTS - 26))
    at = letters + np.arange(len(points))[:, None] * COUNTS
    return np.bincount(at.ravel(), minlength=len(points) * COUNTS).reshape(-1, COUNTS).astype(np.int16)


def _split(vectors: np.ndarray) -> tuple[int, int] | None:
    """(letter, count) that parts the vectors most evenly; None if all are equal."""
    best = None
    for value in range(int(vectors.max(initial=0))):
        low = (vectors <= value).sum(axis=0)
        uneven = np.abs(2 * low - len(vectors))
        letter = int(uneven.argmin())
        if uneven[letter] < (len(vectors) if best is None else best[0]):
            best = int(uneven[letter]), letter, value
    return best and best[1:]


def grow(vectors: np.ndarray, most: float) -> tuple[Tree, list[np.ndarray]]:
    """A k-d tree with at most `most` of the vectors in a leaf, unless they are equal.

    An inner node is (letter, count, up to it, above it); a leaf is the number of
    its list of vectors.
    """
    leaves: list[np.ndarray] = []

    def node(rows: np.ndarray) -> Tree:
        cut = _split(vectors[rows]) if len(rows) > most else None
        if cut is None:
            leaves.append(rows)
            return len(leaves) - 1
        letter, count = cut
        low = vectors[rows, letter] <= count
        return letter, count, node(rows[low]), node(rows[~low])

    return node(np.arange(len(vectors))), leaves


def reached(tree: Tree, vectors: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows of `vectors`) whose box of changes meets the leaf's box.

    Up to `up` counts may grow by one, and up to `down` may shrink by one. To
    enter the far side of a cut uses such a change up.
    """
    rows = np.arange(len(vectors))
    todo = [(tree, rows, vectors, np.full(len(rows), up), np.full(len(rows), down))]
    while todo:
        node, rows, own, ups, downs = todo.pop()
        if not len(rows):
            continue
        if isinstance(node, int):
            yield node, rows
            continue
        letter, count, low, high = node
        value = own[:, letter]
        under = value <= count
        rise = (value == count) & (ups > 0)
        fall = (value == count + 1) & (downs > 0)
        for child, stay, cross, step in ((low, under, fall, -1), (high, ~under, rise, 1)):
            moved = own[cross].copy()
            moved[:, letter] += step
            todo.append(
                (
                    child,
                    np.concatenate([rows[stay], rows[cross]]),
                    np.concatenate([own[stay], moved]),
                    np.concatenate([ups[stay], ups[cross] - (step > 0)]),
                    np.concatenate([downs[stay], downs[cross] - (step < 0)]),
                )
            )


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether each pair of rows of code points is exactly one edit apart."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    before = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    after = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= short.shape[1]


class Cell:
    """The words of one cell, which are all of one length, behind a k-d tree."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.words, self.counts = words, counts
        self.points = _matrix(words)
        self.vectors = _vectors(self.points)
        self.floats = self.vectors.astype(np.float32)
        self.lengths = (self.floats**2).sum(axis=1)
        self.tree, self.leaves = grow(self.vectors, LEAF)

    def near(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of `words`, row of the cell) of words one edit apart."""
        points = _matrix(words)
        same = points.shape[1] == self.points.shape[1]
        vectors = _vectors(points)
        # Counts of words of one length that are no more than two apart differ
        # by one up and one down, so the squares of the distances tell as much
        # as L1 distances, and they come from one product of matrices.
        wanted, length = (2 if same else 1), (vectors.astype(np.float32) ** 2).sum(axis=1)
        own = vectors.astype(np.float32)
        for leaf, rows in reached(self.tree, vectors, 1, int(same)):
            members = self.leaves[leaf]
            width = max(1, COMPARED // len(members))
            for start in range(0, len(rows), width):
                part = rows[start : start + width]
                product = own[part] @ self.floats[members].T
                distance = length[part][:, None] + self.lengths[members] - 2 * product
                i, j = np.nonzero(distance <= wanted)
                i, j = part[i], members[j]
                fits = _one_edit(points[i], self.points[j])
                yield i[fits], j[fits]


def _best(of: np.ndarray, words: list[str], other: np.ndarray, others: list[str], counts: np.ndarray):
    """For each word: how many near words, and the one of largest count, then smallest."""
    ranks = np.empty(len(others), np.int64)
    ranks[np.array(sorted(range(len(others)), key=others.__getitem__), np.int64)] = np.arange(len(others))
    order = np.lexsort((ranks[other], -counts[other], of))
    of, other = of[order], other[order]
    found, first, n_near = np.unique(of, return_index=True, return_counts=True)
    best = other[first]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[i] for i in found.tolist()], pa.string()),
            pa.array(n_near.astype(np.int64)),
            pa.array(counts[best].astype(np.int64)),
            pa.array([others[i] for i in best.tolist()], pa.string()),
        ],
        ["word", "n_near", "best_n", "best"],
    )


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the rows of each unit, whose stored words come first."""
    unit, stored, cell = None, [], None
    for batch in batches:
        units, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        change = np.flatnonzero((units[1:] != units[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for start, stop in zip([0, *change.tolist()], [*change.tolist(), len(units)]):
            if start == stop:
                continue
            if units[start] != unit:
                unit, stored, cell = units[start], [], None
            words = batch.column(2).slice(start, stop - start).to_pylist()
            counts = batch.column(3).slice(start, stop - start).to_numpy()
            if kinds[start]:
                stored.append((words, counts))
                continue
            if not stored:
                continue
            if cell is None:
                cell = Cell([w for part, _ in stored for w in part], np.concatenate([n for _, n in stored]))
            for low in range(0, len(words), SEARCHED):
                yield from _near_batches(cell, words[low : low + SEARCHED], counts[low : low + SEARCHED])


def _near_batches(cell: Cell, words: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        own = [words[i] for i in rows.tolist()]
        pairs = list(cell.near(own))
        i, j = (np.concatenate(x) if pairs else np.array([], np.int64) for x in (zip(*pairs) if pairs else ((), ())))
        if not len(i):
            continue
        yield _best(i, own, j, cell.words, cell.counts)
        if length != cell.points.shape[1]:  # seen from the longer words too
            yield _best(j, cell.words, i, own, counts[rows])


def _upper_trees(words: DataFrame) -> dict[int, Tree]:
    """For each length a tree whose leaves should hold CELL words, from a sample."""
    total = words.count()
    sample = words.orderBy(F.xxhash64("word"), "word").limit(SAMPLE).select("word")
    by_length: dict[int, list[str]] = {}
    for row in sample.collect():
        by_length.setdefault(len(row.word), []).append(row.word)
    share = max(1.0, CELL * min(SAMPLE, total) / max(1, total))
    # With too few words of the sample in a leaf a cut says little.
    return {n: grow(_vectors(_matrix(found)), max(share, 8.0))[0] for n, found in by_length.items()}


def _dealt(trees: dict[int, Tree]):
    """Rows of words as (cell, stored, word, n): one stored, and one for each cell to search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            counts = batch.column(1).to_numpy()
            lengths = np.array([len(w) for w in words], np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                vectors = _vectors(_matrix([words[i] for i in rows.tolist()]))
                for to, up, down, kind in ((length, 0, 0, True), (length, 1, 1, False), (length + 1, 1, 0, False)):
                    for leaf, at in reached(trees.get(to, 0), vectors, up, down):
                        n = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(n, (to << 32) + leaf, np.int64)),
                                pa.array([kind] * n, pa.bool_()),
                                pa.array([words[i] for i in rows[at].tolist()], pa.string()),
                                pa.array(counts[rows[at]]),
                            ],
                            ["cell", "stored", "word", "n"],
                        )

    return run


def _units(dealt: DataFrame) -> DataFrame:
    """The rows by unit; a cell with very many words is cut into blocks of them.

    Each block meets all words that search the cell.
    """
    sizes = dealt.where("stored").groupBy("cell").count()
    large = sizes.where(F.col("count") > BLOCK).select("cell", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    large = write_table(large, "cells")
    side = F.broadcast(large) if large.count() <= 100_000 else large
    rows = dealt.join(side, "cell", "left")
    own = F.array(F.pmod(F.xxhash64("word"), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    block = F.explode(
        F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("stored"), own).otherwise(every)
    )
    rows = rows.select("cell", "stored", "word", "n", block.alias("block"))
    return rows.select(F.xxhash64("cell", "block").alias("unit"), "stored", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words with a near word.

    `words` has distinct (word, n). `form` is the near word with the largest n,
    the smallest in code-point order on ties. NULL and empty words are ignored.
    """
    rows = words.where(F.length("word") > 0).select("word", "n")
    dealt = write_table(rows.mapInArrow(_dealt(_upper_trees(rows)), "cell long, stored boolean, word string, n long"), "dealt")
    together = _units(dealt).repartition("unit").sortWithinPartitions("unit", F.desc("stored"))
    parts = together.mapInArrow(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    found = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row for each of `words`.

    `words` has distinct (word, n). Words are near if one letter inserted,
    deleted or replaced makes one of the other. `form` is the near word with the
    largest n if that is `ratio` times the word's n at least, the smallest in
    code-point order on ties, else NULL. `root` is where following forms ends,
    the word itself without a form. `n_near` is 0 for a word without near words.
    An empty table gives an empty one; rows without word or n are dropped.

    Each form has a larger n than its word, so following them ends; the chains
    are halved in each round, and rounds go on until none is left.
    """
    known = (F.length("word") > 0) & F.col("n").isNotNull()
    words = write_table(words.where(known).select("word", "n"), "words")
    joined = words.join(near_words(words), "word", "left")
    usual = F.col("form_n") >= ratio * F.col("n")
    joined = write_table(
        joined.select(
            "word",
            F.when(usual, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(usual, F.col("form_n")).alias("form_n"),
        ),
        "variants",
    )
    links = joined.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = write_table(moved, "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return joined.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
