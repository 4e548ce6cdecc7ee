"""The similarity join against all pairs in plain Python, and on odd input."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from qaprep.llm import jaccard

SHAPES = [3, 5, 8, 12, 15, 20, 30, 60, 200]


def shingles(text: str | None) -> set[str]:
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain(rows):
    """All pairs; a row of the result for each row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(rows)]


def families(seed: int):
    """Texts of all lengths with near copies on both sides of the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(20):
        base = [rng.choice(words) for _ in range(rng.choice(SHAPES))]
        for _ in range(rng.choice([2, 5, 25])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, len(text) // 50])):
                i, how = rng.randrange(len(text)), rng.random()
                if how < 0.4:
                    text[i] = rng.choice(words)
                elif how < 0.7:
                    text.insert(i, rng.choice(words))
                elif len(text) > 1:
                    del text[i]
            rows.append((len(rows) + 100, " ".join(text)))
    return rows


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, jaccard.similar_documents(df).collect()), key=str)


@pytest.mark.parametrize(
    "settings", [{}, {"BLOCK": 7}, {"SEEN": 1, "HOT": 5}, {"SENT_IDS": 0}], ids=["usual", "blocks", "salts", "joined"]
)
def test_equals_all_pairs(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = families(4)
    assert found(spark, rows) == sorted(plain(rows), key=str)


def test_sets_that_link_share_the_promised_keys():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(7, 400))
        one = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        most = jaccard.most_differing(2 * len(one), 85) // 2
        gone = rng.integers(0, most + 1) if most else 0
        two = np.unique(np.concatenate([one[gone:], rng.integers(0, 1 << 62, gone).astype(np.uint64)]))
        differ = len(np.setxor1d(one, two))
        if not 0 < differ <= jaccard.most_differing(len(one) + len(two), 85):
            continue
        level = np.searchsorted(jaccard.LADDER, jaccard.least_parts(jaccard.most_differing(len(one) + len(two), 85)))
        assert level in jaccard.part_levels(len(one), 85) and level in jaccard.part_levels(len(two), 85)
        parts = jaccard.LADDER[level]
        shared = np.intersect1d(jaccard.part_keys(one, parts), jaccard.part_keys(two, parts))
        assert len(shared) >= parts - differ


def test_bitmaps_bound_the_overlap_from_above():
    rng = np.random.default_rng(3)
    one, two = (np.unique(rng.integers(0, 500, 300).astype(np.uint64) << np.uint64(17)) for _ in range(2))
    for bits in (64, 512, 4096):
        a, b = jaccard._bitmaps([one, two], bits)
        bound = (len(one) + len(two) - int(np.bitwise_count(a ^ b).sum())) // 2
        assert bound >= len(np.intersect1d(one, two))


def test_odd_rows(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [
        (5, None), (6, ""), (6, " \t\n"), (7, "One two"), (8, "one  TWO"), (None, text), (3, text), (3, text),
        (None, "x y z x y z x y z"), (9, "é" * 9000), (10, "the " * 30_000), (11, "THE the the the"),
    ]
    assert found(spark, rows) == sorted(plain(rows), key=str)


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id string, text string, row long, node long, n string, component_id long, tiles string"
    none = spark.createDataFrame([], schema)
    assert jaccard.similar_documents(none).columns == ["doc_id", "n_shingles", "component_id"]
    assert jaccard.similar_documents(none).count() == 0
    some = spark.createDataFrame([("b", "u v w x y", 1, 1, "", 1, ""), ("a", "u v w x y", 1, 1, "", 1, "")], schema)
    assert sorted(map(tuple, jaccard.similar_documents(some).collect())) == [("a", 2, "a"), ("b", 2, "a")]
