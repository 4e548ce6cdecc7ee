"""Runs of words against a scan of all periods, and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from qaprep.llm import periodic, queries


def plain_runs(words, least=12):
    found = {}
    for period in range(1, len(words) // 2 + 1):
        i = 0
        while i + period < len(words):
            j = i
            while j + period < len(words) and words[j] == words[j + period]:
                j += 1
            if j > i and j + period - i >= max(least, 2 * period):
                found.setdefault((i, j + period), period)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed: int, n: int):
    rng = random.Random(seed)
    for _ in range(n):
        kinds, length = rng.choice([1, 2, 3, 60]), rng.choice([0, 5, 12, 40, 120, 300])
        words = [f"w{rng.randrange(kinds)}" for _ in range(length)]
        if words and rng.random() < 0.6:
            first = rng.randrange(length)
            period = 1 + (length - first) // rng.randint(2, 9)
            words = [words[first + (i - first) % period] if i >= first else w for i, w in enumerate(words)]
        yield words


def test_equals_plain_python(spark):
    given = list(texts(1, 150))
    rows = [(i, " \n".join(words)) for i, words in enumerate(given)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for row in periodic.with_runs(df).collect():
        runs = [tuple(r) for r in row.runs]
        assert runs == plain_runs(given[row.doc_id])
        assert row.collapsed == plain_collapsed(given[row.doc_id], runs)


def test_extensions_equal_comparison():
    rng = np.random.default_rng(5)
    words = np.concatenate([np.tile(rng.integers(0, 3, 70), 6), rng.integers(0, 2, 300)])
    extend = periodic.Extensions(words)
    i, j = np.sort(rng.integers(0, len(words), (2, 4000)), axis=0)
    i, j = i[i < j], j[i < j]
    for a, b, got in zip(i.tolist(), j.tolist(), extend(i, j).tolist()):
        same = words[a : a + len(words) - b] == words[b:]
        assert got == (len(same) if same.all() else int(same.argmin()))


def test_cover_has_every_difference():
    cover, period = periodic.COVER, periodic.PERIOD
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_odd_rows(spark):
    long = "the " * 30_000
    rows = [(1, None, "x"), (1, "", "x"), (None, " \t ", None), (2, "a b " * 6, "x"), (2, "a b " * 6, "x"), (3, long, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Runs string")
    found = periodic.with_runs(df).orderBy("text").collect()
    assert [len(r.runs) for r in found] == [0, 0, 0, 1, 1, 1]
    assert [r.collapsed for r in found] == ["", "", "", "a b", "a b", "the"]
    assert tuple(found[5].runs[0]) == (0, 30_000, 1)
    assert periodic.with_runs(df.limit(0)).columns == ["doc_id", "text", "runs", "collapsed"]
    assert periodic.with_runs(df.limit(0)).count() == 0


def test_query_equals_plain_python(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "b", "cc", "d,"]) for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(500, None), (None, "a " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: tuple(r) for r in queries.op12_runs(spark, str(tmp_path)).collect()}
    for name, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(name).encode()), len(words)
        if h % 10 == 0 and n and name is not None:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{k},{p}\n" for s, k, p in runs)
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (listed, plain_collapsed(words, runs)))
        assert found[name] == (name, len(runs), *told, *digests)


@pytest.mark.parametrize("least", [2, 20])
def test_least_length(spark, least):
    words = "x y x y p q r p q r p q r p q r p q r p q r s".split()
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    runs = [tuple(r) for r in periodic.with_runs(df, least=least).first().runs]
    assert runs == plain_runs(words, least)
