"""Byte-pair encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of each distinct word. A sequence is
the one that merging would give exactly if each adjacent pair is compatible,
that is if merging the two tokens' bytes alone gives these two tokens back
(the merges of a pair's two sides only meet at their border). All pairs of all
words of a slice are tested together by undoing merges in step, in numpy. Only
words with an incompatible pair are merged one merge at a time.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from qaprep.llm.common import append_columns, text_bytes

#: Words whose tokens a worker remembers; the memory is emptied when it is full.
REMEMBERED_WORDS = 250_000
#: Longer words are merged exactly at once, by a method that is not quadratic.
LONG_WORD = 256
HASH_BASE, HASH_SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(42)

# Fixed value: how byte-level vocabularies part a text.
BYTE_LEVEL_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizer:
    """Encodes and decodes with a byte-level tokenizer file.

    The file's added tokens are single ids wherever they stand in a text, as
    they are for the library that the file is written for.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        known = {
            bytes(letters[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if all(c in letters for c in token)
        }
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*known.values(), *added.values()])
        self.id_of = known
        self.bytes_of = [b""] * size
        for token, i in known.items():
            self.bytes_of[i] = token
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.added = added
        self.added_pattern = (
            regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)))
            if added
            else None
        )
        self.words = regex.compile(BYTE_LEVEL_PATTERN)
        self.longest = max(map(len, known))
        self._tables(spec["model"]["merges"], letters, size)
        self.byte_id = [known[bytes([b])] for b in range(256)]
        lengths = np.array([len(t) for t in self.bytes_of], np.int64)
        self.lengths, self.starts = lengths, np.concatenate([[0], np.cumsum(lengths)])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self._prepare_proposals()
        self.forget()

    def _tables(self, merges: list, letters: dict[str, int], size: int) -> None:
        """Order of merges, the pair behind each token, and pairs by key."""
        self.size = size
        self.order = np.full(size, -1, np.int64)  # -1: a single byte
        self.left = np.arange(size)
        self.right = np.arange(size)
        self.made: list[int] = []  # what each merge makes
        self.no_rank = len(merges)
        keys, ranks = [], []
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = (bytes(letters[c] for c in side) for side in (a, b))
            i, j, out = self.id_of[x], self.id_of[y], self.id_of[x + y]
            self.made.append(out)
            keys.append(i * size + j)
            ranks.append(rank)
            if self.order[out] < 0:
                self.order[out], self.left[out], self.right[out] = rank, i, j
        self.rank_of = dict(zip(keys, ranks)).get
        at = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.append(np.array(keys, np.int64)[at], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(ranks, np.int64)[at], -1)

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging a with b; a very large number where there is none."""
        keys = a * self.size + b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b leaves the border between them.

        Going back in time from the finished tokens: the later of the two
        border tokens' merges is undone. A merge across the border at some
        point in time would have been taken if it ranks before the merges that
        ended both border tokens' stay there, on the right side also when the
        ranks are equal, because the leftmost pair is merged first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        ends = np.full(len(a), np.iinfo(np.int64).max - 1)
        while len(open_):
            across = self._rank_of(a, b)
            crossed = across < ends
            good[open_[crossed]] = False
            undo_a = self.order[a] > self.order[b]
            rank = np.where(undo_a, self.order[a], self.order[b])
            keep = ~crossed & (rank >= 0)
            ends = np.where(undo_a, rank, rank + 1)[keep]
            new_a = np.where(undo_a, self.right[a], a)[keep]
            b = np.where(undo_a, b, self.left[b])[keep]
            a, open_ = new_a, open_[keep]
        return good

    def _propose(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches in all words at once: (tokens, sizes of words).

        Each step takes the longest token at the front of what is left of every
        word. Parts are found by their hash; `learn` compares the bytes.
        """
        lengths = np.array([len(w) for w in raw], np.int64)
        width = int(lengths.max(initial=0))
        letters = np.zeros((len(raw), width), np.uint64)
        inside = np.arange(width) < lengths[:, None]
        letters[inside] = np.frombuffer(b"".join(raw), np.uint8)
        letters[inside] += np.uint64(1)
        at = np.zeros(len(raw), np.int64)
        open_ = np.flatnonzero(lengths > 0)
        steps = []
        while len(open_):
            found = np.full(len(open_), -1, np.int64)
            left = np.minimum(lengths[open_] - at[open_], self.longest)
            key = np.zeros(len(open_), np.uint64)
            row = np.arange(len(open_))
            for size in range(1, int(left.max()) + 1):
                row = row[left[row] >= size]
                key[row] = (key[row] + letters[open_[row], at[open_[row]] + size - 1]) * HASH_BASE
                maybe = row[self.seen[(key[row] >> HASH_SHIFT).astype(np.int64)]]
                place = np.searchsorted(self.token_keys, key[maybe])
                hit = self.token_keys[place] == key[maybe]
                found[maybe[hit]] = self.token_ids[place[hit]]
                row = row[self.begins[(key[row] >> HASH_SHIFT).astype(np.int64)]]
            steps.append((open_, found))
            at[open_] += self.lengths[found]
            open_ = open_[at[open_] < lengths[open_]]
        words = np.concatenate([w for w, _ in steps] or [np.array([], np.int64)])
        tokens = np.concatenate([t for _, t in steps] or [np.array([], np.int64)])
        return tokens[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(raw))

    def _prepare_proposals(self) -> None:
        """Hashes of tokens, and bit tables of which hashes are or begin tokens."""
        keys = {}
        self.seen = np.zeros(1 << (64 - int(HASH_SHIFT)), bool)
        self.begins = self.seen.copy()
        for token, i in self.id_of.items():
            key = 0
            for n, byte in enumerate(token, 1):
                key = (key + byte + 1) * int(HASH_BASE) % (1 << 64)
                if n < len(token):
                    self.begins[key >> int(HASH_SHIFT)] = True
            keys[key] = i
            self.seen[key >> int(HASH_SHIFT)] = True
        ordered = sorted(keys)
        self.token_keys = np.array([*ordered, (1 << 64) - 1], np.uint64)
        self.token_ids = np.array([*(keys[k] for k in ordered), -1], np.int64)

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the pair of the lowest rank first, the leftmost of ties."""
        return self._merged_long(word) if len(word) > LONG_WORD else self._merged_short(word)

    def _merged_short(self, word: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in word]
        rank_of, size, none = self.rank_of, self.size, self.no_rank
        ranks = [rank_of(a * size + b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            ids[i : i + 2] = [made := self.made[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] * size + made, none)
            if i < len(ranks):
                ranks[i] = rank_of(made * size + ids[i + 1], none)
        return ids

    def _merged_long(self, word: bytes) -> list[int]:
        """The same with a heap, so that a word of any length takes n log n steps."""
        ids = [self.byte_id[b] for b in word]
        n, none = len(ids), self.no_rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.rank_of(ids[i] * self.size + ids[j], none)) < none:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [i for i in ids if i >= 0]

    def learn(self, words: list[str]) -> None:
        """Find the tokens of words that are not in memory, together."""
        raw = [w.encode() for w in words]
        short = [w if len(w) <= LONG_WORD else b"" for w in raw]
        flat, sizes = self._propose(short)
        owner = np.repeat(np.arange(len(raw)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        keys, inverse = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(keys // self.size, keys % self.size)
        wrong = np.zeros(len(raw), bool)
        wrong[owner[inner[~good[inverse]]]] = True
        spelled = self._spell(flat)
        if spelled != b"".join(short):  # two parts of one hash
            wrong[:] = True
        wrong |= np.array([len(w) > LONG_WORD for w in raw], bool)
        exact = {i: self.merged(raw[i]) for i in np.flatnonzero(wrong).tolist()}
        kept = flat[~wrong[owner]]
        order = np.concatenate([np.flatnonzero(~wrong), np.fromiter(exact, np.int64, len(exact))])
        sizes = np.concatenate([sizes[~wrong], [len(t) for t in exact.values()]]).astype(np.int64)
        more = np.fromiter((i for t in exact.values() for i in t), np.int64)
        first = len(self.slot_sizes)
        self.memory.update((words[i], first + n) for n, i in enumerate(order.tolist()))
        self.slot_tokens = np.concatenate([self.slot_tokens, kept, more]).astype(np.int32)
        self.slot_sizes = np.concatenate([self.slot_sizes, sizes])
        self.slot_starts = np.cumsum(self.slot_sizes) - self.slot_sizes

    def forget(self) -> None:
        self.memory: dict[str, int] = {}
        self.slot_tokens = np.array([], np.int32)
        self.slot_sizes = np.array([], np.int64)
        self.slot_starts = np.array([], np.int64)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        parted = [self._parts(t) for t in texts]
        new = {w for parts in parted for words, _ in parts for w in words} - self.memory.keys()
        if new and len(self.memory) + len(new) > REMEMBERED_WORDS:
            self.forget()
            new = {w for parts in parted for words, _ in parts for w in words}
        if new:
            self.learn(list(new))
        get = self.memory.__getitem__
        out = []
        for parts in parted:
            pieces = []
            for words, special in parts:
                slots = np.fromiter(map(get, words), np.int64, len(words))
                pieces.append(self.slot_tokens[ragged(self.slot_starts[slots], self.slot_sizes[slots])])
                if special is not None:
                    pieces.append(np.array([special], np.int32))
            out.append(np.concatenate(pieces) if len(pieces) > 1 else pieces[0])
        return out

    def _parts(self, text: str) -> list[tuple[list[str], int | None]]:
        """Words before each added token, with the token; None after the last."""
        if not self.added_pattern or not (found := list(self.added_pattern.finditer(text))):
            return [(self.words.findall(text), None)]
        parts, at = [], 0
        for m in found:
            parts.append((self.words.findall(text[at : m.start()]), self.added[m.group()]))
            at = m.end()
        return [*parts, (self.words.findall(text[at:]), None)]

    def _spell(self, ids: np.ndarray) -> bytes:
        return self.flat[ragged(self.starts[ids], self.lengths[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; bytes that are not UTF-8 become U+FFFD."""
        return self._spell(ids).decode("utf-8", "replace")


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + sizes, sizes)


@functools.cache
def load(file: str) -> Tokenizer:
    return Tokenizer(file)


def encode_decode(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """df with `ids` (array of int), the tokens of each text, and `decoded`.

    `tokenizer` is the path of a byte-level BPE file on the driver; Spark ships
    it to the executors. NULL and empty texts have no ids and decode to ''.
    Repeated rows are kept. Columns named ids or decoded are replaced.
    """
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def make():
        coder = load(SparkFiles.get(name))

        def compute(texts: pa.Array) -> list:
            words = [t.decode("utf-8", "replace") for t in text_bytes(texts)]
            ids = coder.encode(words)
            sizes = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.array([], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, pa.int32()))
            return [lists, pa.array([coder.decode(i) for i in ids], pa.string())]

        compute.close = coder.forget
        return compute

    fields = [
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
    ]
    return append_columns(df, text, fields, make)
