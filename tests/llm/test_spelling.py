"""Spelling variants against all pairs in plain Python, and on odd input."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from qaprep.llm import queries, spelling


def one_edit(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts: dict[str, int]):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    best = {w: min(found, key=lambda x: (-counts[x], x)) for w, found in near.items() if found}
    form = {w: x for w, x in best.items() if counts[x] >= 2 * counts[w]}

    def root(word):
        while word in form:
            word = form[word]
        return word

    return sorted(
        ((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()),
        key=lambda r: r[0],
    )


def made_up(seed: int, n: int) -> dict[str, int]:
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        word = [rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))]
        for _ in range(rng.randint(1, 5)):
            words.add("".join(word))
            at = rng.randrange(len(word))
            word[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "ñ"])
            word = word or ["a"]
    return {w: rng.choice([1, 2, 3, 4, 8, 20, 50]) for w in words if w}


@pytest.mark.parametrize("settings", [{}, {"CELL": 20, "LEAF": 4, "SAMPLE": 200}, {"BLOCK": 16}], ids=["usual", "deep", "blocks"])
def test_equals_all_pairs(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(spelling, name, value)
    counts = made_up(3, 500)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert sorted(map(tuple, spelling.variants(words).collect())) == plain(counts)


def test_a_tree_reaches_every_word_one_edit_away():
    words = [w for w in made_up(5, 800) if len(w) == 6]
    vectors = spelling._vectors(spelling._matrix(words))
    tree, leaves = spelling.grow(vectors, 5)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(len(words)))
    met = {(i, j) for leaf, rows in spelling.reached(tree, vectors, 1, 1) for i in rows.tolist() for j in leaves[leaf].tolist()}
    assert all((i, j) in met for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b))


def test_equal_vectors_are_one_leaf():
    vectors = spelling._vectors(spelling._matrix(["stone", "notes", "onset"] * 200))
    assert spelling.grow(vectors, 10)[0] == 0


def test_query_equals_plain_python(spark, tmp_path):
    rng = random.Random(6)
    pool = [*made_up(9, 300), "Ébène", "STRASSE", "naïveté", "x÷y"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(80)) + ", 12 l'été.") for i in range(120)]
    rows += [(7, "again again again"), (500, None), (501, ""), (None, "withoutid " * 4), (502, "z" * 20_000 + " ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{name}:{word}".encode())
            if h % 97 == 0 and name is not None:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    want = plain({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    assert sorted(map(tuple, queries.op13_spelling(spark, str(tmp_path)).collect())) == want


def test_odd_words(spark):
    schema = "word string, n long, form string"
    none = spark.createDataFrame([], schema)
    assert spelling.variants(none).count() == 0
    rows = [(None, 3, ""), ("", 4, ""), ("abcde", None, ""), ("abcdf", 2, ""), ("abcd", 4, ""), ("abc", 8, ""), ("abx", 8, "")]
    found = sorted(map(tuple, spelling.variants(spark.createDataFrame(rows, schema)).collect()))
    assert found == [
        ("abc", None, "abc", 8, 2, None),
        ("abcd", "abc", "abc", 4, 2, 8),
        ("abcdf", "abcd", "abc", 2, 1, 4),
        ("abx", None, "abx", 8, 1, None),
    ]
