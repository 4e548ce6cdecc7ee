"""Each operator against plain Python, and on odd input."""

from __future__ import annotations

import hashlib
import os
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from qaprep.llm import (
    bpe, common, decontaminate, langid, pii, quality, queries, rules, secrets, simhash, substrings, warc,
)

SMALL = "/root/testdata/sf0.001"
HAS_VOCABULARY = os.path.exists(queries.tokenizer_path())
WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "sa", "ti") for b in ("r", "nd", "st", "ll", "x", "ve", "mp")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


ODD = [
    None, "", " \t\n ", "a", "a", "é日本🙂", "x" * 300, prose(1, 80), prose(1, 80), prose(2, 9000),
    "the the the " * 60, "12 34.5", "<|endoftext|> it's  two\n\nlines",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NEW = "ids string, decoded string, score string, simhash string, kept string, findings string, leaks string, n_words string, lang_pred string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, NULL ids and columns, and columns named like new ones."""
    clash = ("old",) * len(NEW.split(", "))
    rows = [
        (None if i == 5 else i, t, ("en", "de", None)[i % 3], (None, "s")[i % 2], 0, *clash)
        for i, t in enumerate(ODD)
    ]
    return spark.createDataFrame(rows, f"{SCHEMA}, {NEW}")


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(13)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, prose(7, 30)), (2, prose(7, 30)), (3, None), (4, "too short"), (5, prose(8, 6))],
        "item_id long, text string",
    )


# Encoding


@pytest.mark.skipif(not HAS_VOCABULARY, reason="no vocabulary file")
def test_encoding_matches_the_library(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    rows = bpe.encode_decode(odd, queries.tokenizer_path()).select("text", "ids", "decoded").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)


@pytest.mark.skipif(not HAS_VOCABULARY, reason="no vocabulary file")
def test_random_words_and_both_ways_of_merging():
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(queries.tokenizer_path()), bpe.load(queries.tokenizer_path())
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeihnorst'A1 é.\n") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    word = ("the" * 40).encode()
    assert coder._merged_short(word) == coder._merged_long(word)


@pytest.mark.skipif(not HAS_VOCABULARY, reason="no vocabulary file")
def test_compatible_pairs_are_those_that_merging_keeps():
    coder = bpe.load(queries.tokenizer_path())
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 30_000, (2, 4000))
    got = coder.compatible(a, b)
    for x, y, good in zip(a.tolist(), b.tolist(), got.tolist()):
        merged = coder.merged(coder.bytes_of[x] + coder.bytes_of[y])
        assert good == (merged == [x, y])


# Near duplicates


def plain_fingerprint(text: str | None) -> int:
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(grams))


def plain_components(numbers: list[int], distance: int) -> list[int]:
    root = list(range(len(numbers)))
    for i in range(len(numbers)):
        for j in range(i):
            if (numbers[i] ^ numbers[j]).bit_count() <= distance:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash_on_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    want = {i: plain_fingerprint(t) for i, t in enumerate(ODD)}
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD)
    for i, r in got.items():
        if i is not None:
            assert r.simhash % (1 << 64) == want[i]
    assert got[0].component_id == got[1].component_id == got[2].component_id == 0
    assert got[4].component_id == got[3].component_id and got[8].component_id == got[7].component_id == 7
    assert simhash.near_duplicates(none).count() == 0


def test_the_radius_follows_the_number_of_fingerprints():
    assert [simhash.ball_radius(4, 10**k) for k in (0, 6, 9, 12)] == [1, 1, 1, 2]
    for distance in range(1, 12):
        for radius in (1, 2):
            parts = simhash.segments(distance, radius)
            assert distance // len(parts) <= radius and sum(w for _, w in parts) == 64


@pytest.mark.parametrize(
    ("distance", "block", "radius"), [(4, 2048, 1), (4, 16, 1), (3, 2048, 1), (1, 2048, 1), (4, 2048, 2), (5, 16, 2)]
)
def test_links_give_the_components_of_all_pairs(spark, monkeypatch, distance, block, radius):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(distance)
    numbers = {0, (1 << 64) - 1}
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(12):
            flips = rng.sample(range(64), rng.randint(0, 6))
            numbers.add(centre ^ sum(1 << f for f in flips))
    numbers = sorted(numbers)
    signed = [n - (1 << 64) if n >> 63 else n for n in numbers]
    prints = spark.createDataFrame([(n,) for n in signed], "simhash long")
    found = {r.node: r.component for r in common.components(simhash.links(prints, distance, radius)).collect()}
    groups: dict[int, set] = {}
    for n, r in zip(signed, plain_components(numbers, distance)):
        groups.setdefault(r, set()).add(n)
    want = {frozenset(g) for g in groups.values()}
    mine: dict[int, set] = {}
    for n in signed:
        mine.setdefault(found.get(n, n), set()).add(n)
    assert {frozenset(g) for g in mine.values()} == want


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b").union(spark.range(1).selectExpr("900 as a", "900 as b"))
    found = common.components(edges).collect()
    assert {r.component for r in found} == {0} and len(found) == 300


# Quality and language


def test_quality_scores_every_row(odd, none, labels):
    model = quality.fit(odd, labels, ~common.held_out("doc_id", 5, 0))
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert rows[7].score == rows[8].score
    empty = quality.fit(none, labels.limit(0), F.lit(True))
    assert quality.score(none, empty).count() == 0
    assert {r.score for r in quality.score(odd, empty).collect()} == {0.5}


def test_quality_held_out_accuracy(spark):
    rows = [(i, prose(i, 40 + i % 50) if i % 4 else " ".join(w + "###" for w in prose(i, 50).split())) for i in range(400)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in rows], "doc_id long, quality int")
    scored = queries.scored(documents, labelled).where(common.held_out("doc_id", 5, 0)).collect()
    right = sum((r.score >= 0.3) == (r.doc_id % 4 > 0) for r in scored)
    assert len(scored) > 40 and right >= 0.97 * len(scored)


def test_pooled_is_the_rising_mean():
    sums, counts = np.array([1.0, 3, 0, 4, 2]), np.array([4.0, 4, 4, 4, 4])
    assert quality.pooled(sums, counts).tolist() == pytest.approx([0.25, 0.375, 0.375, 0.75, 0.75])


def test_language_held_out_accuracy_and_odd_rows(spark, odd, none):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(documents, ~common.held_out("doc_id", 3, 1))
    rows = langid.identify(documents, model).where(common.held_out("doc_id", 3, 1)).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    found = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2, 11))
    assert found[7].lang_pred in model.languages
    nothing = langid.fit(none, F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


@pytest.mark.parametrize("count", [2, 4, 6, 9, 30])
def test_codewords_differ(count):
    code = langid.codewords(count)
    apart = (code[:, None] != code[None]).sum(2) + 99 * np.eye(count, dtype=int)
    assert apart.min() >= max(1, code.shape[1] // 4)


# Rules


def plain_counts(text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, again = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {
        j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)
    }
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside)


def test_rule_counts_and_odd_rows(odd, none):
    for text in [*ODD, "a b\na b\n\n \nc # $", prose(4, 30) + "\n" + prose(4, 30)]:
        assert rules.count((text or "").encode())[:5] == plain_counts(text)
    rows = rules.apply_rules(odd).collect()
    assert len(rows) == len(ODD)
    assert not any(r.kept for r in rows if r.n_words < 20) and all(r.text in ODD for r in rows)
    assert rules.apply_rules(none, keep_text=False).count() == 0


def test_fences_follow_the_group(spark):
    noisy = [(i, " ".join(w + ("##" if j % 2 == 0 else "") for j, w in enumerate(prose(i, 60).split())), "code") for i in range(60)]
    clean = [(100 + i, prose(i, 60), "news") for i in range(60)]
    odd_one = [(200, noisy[0][1], "news")]
    df = spark.createDataFrame([(i, t, "en", s) for i, t, s in noisy + clean + odd_one], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in rules.apply_rules(df).where("kept").collect()}
    assert kept == set(range(60)) | set(range(100, 160))


def plain_fences(groups: dict) -> dict:
    """Fences of (lang, source) -> buckets of one rate's values, at the level of 99."""

    def parts_like(masses):
        total, upto, out = sum(masses.values()), 0, Counter()
        for b in sorted(masses):
            before, upto = upto, upto + masses[b]
            out[b] = upto * 10_000 // total - before * 10_000 // total
        return out

    thousand = lambda c: Counter({b: 1000 * n for b, n in c.items()})
    langs: dict = {}
    for (lang, _), c in groups.items():
        langs[lang] = langs.get(lang, Counter()) + c
    corpus = parts_like(sum(langs.values(), Counter()))
    tongues = {lang: parts_like(thousand(c) + corpus) for lang, c in langs.items()}
    found = {}
    for key, c in groups.items():
        masses = thousand(c) + tongues[key[0]]
        total = sum(masses.values())

        def at(share):
            upto = 0
            for b in sorted(masses):
                upto += masses[b]
                if upto * 100 >= total * share:
                    return b

        found[key] = at(99) + 3 * (at(99) - at(50))
    return found


def test_fences_come_from_blended_sketches(spark):
    rng = random.Random(12)
    rows = []
    for lang, source, n in [("en", "a", 300), ("en", "b", 5), ("en", None, 70), (None, "a", 40), ("fr", "c", 1)]:
        for _ in range(n):
            upper = min(63, int(rng.expovariate(0.1) * (3 if source == "b" else 1)))
            # Rates below 64 are buckets of their own.
            rows.append((lang, source, 100, 1000, 0, 0, 0, 1, 0, upper))
    counted = spark.createDataFrame(rows, "g_lang string, g_source string, " + ", ".join(f"{c} long" for c in rules.COUNTS))
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[:2], Counter())[r[9]] += 1
    got = {(r.g_lang, r.g_source): r.ends["upper_rate"].high for r in rules.group_fences(counted).collect()}
    assert got == plain_fences(groups) and len(set(got.values())) > 2


def test_rules_agree_with_sql(spark, tmp_path):
    import duckdb

    from qaprep.llm import sql

    rng = random.Random(3)
    rows = [
        (i, prose(i, rng.randint(5, 60)) + rng.choice(["", "\n#$%&* <<>>" * rng.randint(1, 20), "\nsame line here" * rng.randint(2, 9), "! WHY? " * 30]),
         rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", None]))
        for i in range(400)
    ]
    rows += rows[:5] + [(900, None, "en", "s1"), (901, "", None, None)]
    path = str(tmp_path / "documents.parquet")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.write.parquet(path)
    got = sorted(tuple(r) for r in queries.op5_rules(spark, str(tmp_path)).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        want = sorted(con.execute(sql.ORACLES["op5_rules"]).fetchall())
    assert got == want and 0 < sum(r[7] for r in got) < sum(not r[6] for r in got)


def test_buckets_are_narrow(spark):
    rows = spark.range(1, 5000).select("id", rules.bucket(F.col("id")).alias("b")).collect()
    assert all(r.b <= r.id < r.b + max(1, r.b / 32 + 1) for r in rows)


# Secrets


def test_secrets_are_found_and_plain_words_stay(spark, odd, none):
    rng = random.Random(1)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'{prose(i, 30)} token = "{key(40)}" {prose(i + 900, 20)} {"".join(prose(i, 4).split())}') for i in range(80)]
    rows += [(i, f"{prose(i, 60)} 4539148803436467 number") for i in range(80, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("path", F.lit("src/a.py"))
    model = secrets.fit(df, path="path")
    for r in secrets.scan(df, model, path="path").collect():
        found = [r.text[f.start : f.end] for f in r.findings if f.secret]
        want = re.findall(r'token = "(\w+)"', r.text)
        assert found == want
        assert r.redacted == re.sub(r'(token = ")\w+"', r"\1[SECRET]\"".replace("\\\"", '"'), r.text)
    got = secrets.scan(odd, model).collect()
    assert [r.redacted for r in got] == ODD and got[0].findings is None
    assert secrets.scan(none, secrets.fit(none)).count() == 0


def test_dictionary_holds_every_word_with_its_share(spark):
    """A word whose occurrences are spread thinly over tasks is counted whole."""
    rare = lambda i: " ".join(f"w{i}x{j}" for j in range(8_500))
    texts = [f"harbour {rare(i)} Harbour" for i in range(6)]
    least = sum(len(t.split()) for t in texts) // secrets.DICTIONARY
    counts = Counter(w.encode() for t in texts for w in t.lower().split())
    assert counts[b"harbour"] == least == 12
    df = spark.createDataFrame(spark.sparkContext.parallelize([(t,) for t in texts], 6), "text string")
    for held in (secrets.COUNTED_WORDS, 100):
        corpus = secrets.corpus_statistics(df, held_words=held)
        assert corpus.words == {w for w, n in counts.items() if n >= least} == {b"harbour"}


# Decontamination


def test_leaks_tolerate_substitutions(spark, odd, none, benchmark):
    item = prose(7, 30).split()
    swapped = [w if i % 11 != 5 else "other" for i, w in enumerate(item)]
    texts = [
        prose(20, 50) + " " + " ".join(item) + " " + prose(21, 50),
        prose(22, 10) + " " + " ".join(swapped).upper() + ", " + prose(23, 10),
        prose(24, 200) + " " + " ".join(item[:8]),
        "x " + prose(8, 6) + ". y",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x.item_id, x.start, x.end, x.matched) for x in r.leaks] for r in decontaminate.with_leaks(df, benchmark).collect()}
    assert got[0] == [(1, 50, 80, 30)]
    assert len(got[1]) == 1 and got[1][0][0] == 1 and got[1][0][3] >= 24
    assert got[2] == [] and got[3] == [(5, 1, 7, 6)] and got[4] == []
    assert all(r.leaks == [] for r in decontaminate.with_leaks(odd, benchmark).collect())
    assert decontaminate.with_leaks(none, benchmark.limit(0)).count() == 0


def test_repeated_words_hit_in_bounded_pieces(spark, monkeypatch):
    words = decontaminate.tokens(b"again " * 300)
    index = decontaminate.Index([decontaminate.tokens(b"again " * 40), decontaminate.tokens(prose(7, 30).encode())])
    at_once = index.hits(words)
    monkeypatch.setattr(decontaminate, "HITS", 50)
    assert index.hits(words).tolist() == at_once.tolist()
    assert {tuple(x) for x in at_once.tolist()} == {(0, s) for s in range(-31, 292)}


def test_blocks_give_the_same(spark, monkeypatch, benchmark):
    df = spark.createDataFrame([(0, prose(7, 30)), (1, prose(8, 6))], "doc_id long, text string")
    once = decontaminate.with_leaks(df, benchmark).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)
    again = decontaminate.with_leaks(df, benchmark).collect()
    assert [sorted(r.leaks) for r in once] == [sorted(r.leaks) for r in again]


def plain_leaks(document: str, items: list) -> set:
    """(item_id, matched) of each item whose best stretch on any diagonal is good."""
    words = decontaminate.tokens((document or "").encode()).tolist()
    found = set()
    for number, item in items:
        least = min(decontaminate.LEAST_WORDS, len(item))
        best = None
        for shift in range(-len(item) + 1, len(words)):
            lo, hi = max(0, shift), min(len(words), shift + len(item))
            same = [words[k] == item[k - shift] for k in range(lo, hi)]
            top = (0.0, 0, 0)
            for i in range(len(same)):
                total = 0.0
                for j in range(i, len(same)):
                    total += 0.2 if same[j] else -0.8
                    if total > top[0] + 1e-9:
                        top = (total, i, j + 1)
            equal = sum(same[top[1] : top[2]])
            if top[2] - top[1] >= least and equal >= 0.8 * (top[2] - top[1]) and equal > (best or 0):
                best = equal
        if best:
            found.add((number, best))
    return found


def test_leaks_are_those_of_every_diagonal(spark, monkeypatch):
    """Against all diagonals of all texts, in one block and in many."""
    rng = random.Random(31)
    items = [(i, prose(500 + i, rng.randint(14, 28))) for i in range(10)]
    items += [(50, "  " + items[2][1].upper().replace(" ", "\n ")), (51, None), (52, "too short"), (None, items[3][1])]
    texts = []
    for i in range(60):
        item = rng.choice(items[:10])[1].split()
        one = i % 3 == 0
        swapped = [("zz" if one and k % 12 == 7 else w) for k, w in enumerate(item)]
        cut = swapped if i % 4 else swapped[: rng.randint(3, len(swapped))]
        texts.append(" ".join([prose(900 + i, 15), *cut, prose(990 + i, 15)]))
    texts += [texts[0], None, "", "word"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("leaks", F.lit(1))
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    coded = [(i, decontaminate.tokens(t.encode()).tolist()) for i, t in items[:10]]
    once = {r.doc_id: r.leaks for r in decontaminate.with_leaks(df, benchmark).collect()}
    assert len(once) == len(texts)
    for i, t in enumerate(texts):
        assert {(x.item_id, x.matched) for x in once[i]} == plain_leaks(t, coded)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    many = decontaminate.with_leaks(df, benchmark)
    assert many.columns == ["doc_id", "text", "leaks"]
    assert {r.doc_id: r.leaks for r in many.collect()} == once


# Passages


def plain_windows(h: list[int], width: int) -> set:
    out = set()
    for c, v in enumerate(h):
        if v:
            a = b = c
            while a and h[a - 1] > v:
                a -= 1
            while b + 1 < len(h) and h[b + 1] >= v:
                b += 1
            if b - a + 1 >= width:
                out.add((a, c, b))
    return out


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(3)
    for width in (2, 5, 46):
        h = rng.integers(1, 60, 400).astype(np.uint64)
        h[[0, 150, 399]] = 0
        a, c, b = substrings.compact_windows(h, width)
        assert set(zip(a.tolist(), c.tolist(), b.tolist())) == plain_windows(h.tolist(), width)


def test_passages_shared_by_documents(spark, odd, none):
    shared, other = prose(50, 60), prose(51, 70).split()
    near = " ".join(w if i != 30 else "changed" for i, w in enumerate(other))
    rows = [(i, f"{prose(100 + i, 40 + i)} {shared} {prose(200 + i, 30)}") for i in range(12)]
    rows += [(20, " ".join(other) + " " + prose(61, 80)), (21, prose(62, 33) + " " + near)]
    rows += [(30 + i, prose(300 + i, 120)) for i in range(10)] + [(40, prose(70, 90)), (41, prose(70, 90)), (42, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got: dict[int, list] = {}
    for r in substrings.duplicate_passages(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.stop, r.class_id))
    for i in range(12):
        [(start, stop, k)] = got[i]
        assert k == 0 and abs(start - 40 - i) <= 4 and abs(stop - 100 - i) <= 4
    assert got[20][0][2] == got[21][0][2] == 20 and got[21][0][0] in range(30, 37)
    assert got[40] == got[41] == [(0, 90, 40)]
    assert set(got) == set(range(12)) | {20, 21, 40, 41}
    ids = {r.doc_id for r in substrings.duplicate_passages(odd).collect()}
    assert ids == {7, 8}
    assert substrings.duplicate_passages(none).count() == 0


def test_passages_around_a_common_phrase_are_all_linked(spark):
    """Windows around a phrase of all texts have one signature; each text has one partner."""
    phrase = prose(400, 36)
    def text(i):
        return f"{prose(500 + i, 60)} {prose(900 + i // 2, 9)} {phrase} {prose(1300 + i // 2, 9)} {prose(1700 + i, 60)}"
    df = spark.createDataFrame([(i, text(i)) for i in range(120)], "doc_id long, text string").repartition(3)
    got: dict[int, list] = {}
    for r in substrings.duplicate_passages(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.stop, r.class_id))
    for i in range(120):
        [(start, stop, k)] = got[i]
        assert k == i // 2 * 2 and abs(start - 60) <= 4 and abs(stop - 114) <= 4


def test_pairs_left_out_of_a_tile_change_nothing():
    """Passages and classes are those of all pairs of the members."""
    rng = random.Random(5)
    hubs = [prose(2000, 70).split(), prose(2001, 60).split()]
    rows = [(0, -1, 0, " ".join(hubs[0] + prose(2002, 40).split() + hubs[1]).encode())]
    for i in range(1, 40):
        words = prose(2100 + i, 20).split()
        for part in rng.choice((hubs[:1], hubs[1:], hubs)):
            part = [w if rng.random() > 0.01 else f"v{rng.randrange(4)}" for w in part]
            words += part + prose(2200 + i % 7, rng.choice((0, 15, 60))).split() + prose(2300 + i, 10).split()
        rows.append((i, 0, i, " ".join(words).encode()))

    def result(found):
        covered, parent = {}, {}
        for t, s, e, f, s2, e2 in found:
            for text, a, b in ((t, s, e), (f, s2, e2)):
                covered.setdefault(text, set()).update(range(a, b))
        nodes = {}
        for text, words in covered.items():  # maximal stretches
            for w in sorted(words):
                nodes[text, w] = nodes[text, w - 1] if w - 1 in words else (text, w)

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for t, s, _, f, s2, _ in found:
            a, b = sorted((root(nodes[t, s]), root(nodes[f, s2])))
            parent[b] = a
        return {w: root(n) for w, n in nodes.items()}

    tiled = substrings.compare(True, True, rows)
    plain = []
    for x in rows:
        for y in rows[: x[0]]:
            plain += substrings.compare(False, True, [y, x])
    assert set(tiled) < set(plain) and result(tiled) == result(plain)
    # Two sides of a tile and their diagonals are the whole.
    sides = [rows[0], *rows[1:20], *[(t, 1, s, p) for t, _, s, p in rows[20:]]]
    parts = substrings.compare(True, False, sides)
    parts += substrings.compare(True, True, rows[:20]) + substrings.compare(True, True, rows[:1] + rows[20:])
    assert set(parts) <= set(plain) and result(parts) == result(plain)


def passages_and_classes(found):
    """Of each covered word of a text its class, from LINK rows."""
    found, ends = list(found), {}
    for t, s, e, f, s2, e2 in found:
        ends.setdefault(t, set()).add((s, e))
        ends.setdefault(f, set()).add((s2, e2))
    node, parent = {}, {}
    for t, own in ends.items():
        opens = stop = -1
        for s, e in sorted(own):
            opens, stop = (s, e) if s >= stop else (opens, max(stop, e))
            node[t, s] = t, opens

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for t, s, _, f, s2, _ in found:
        a, b = sorted((root(node[t, s]), root(node[f, s2])))
        parent[b] = a
    return {(t, w): root(node[t, s]) for t, own in ends.items() for s, e in own for w in range(s, e)}


def near_copies(n, seed, length=150, edits=6):
    """Texts of one length with words changed at random places."""
    rng, words = random.Random(seed), prose(seed, length).split()
    return [" ".join(w if rng.random() > edits / length else f"v{rng.randrange(9)}" for w in words) for _ in range(n)]


def test_links_of_a_tile_are_as_many_as_its_passages(monkeypatch):
    rng = random.Random(31)
    for size, spans in ((5, 3), (60, 40), (400, 200)):
        found = []
        for _ in range(size):
            t, f = rng.sample(range(-4, 6), 2)
            s, s2 = rng.randrange(spans) * 20, rng.randrange(spans) * 20
            found.append((t, s, s + rng.choice((15, 20, 30)), f, s2, s2 + rng.choice((15, 20, 30))))
        fewer = substrings.forest(found)
        want = passages_and_classes(found)
        assert passages_and_classes(fewer) == want
        nodes = {r[:3] for r in fewer} | {r[3:] for r in fewer}
        assert len(fewer) == len(nodes) - len(set(want.values()))
        monkeypatch.setattr(substrings, "_HELD", 7)
        assert passages_and_classes(substrings.reduced(iter(found))) == want


def test_tiles_of_several_blocks_compare_all_members(monkeypatch):
    texts = near_copies(40, 2750) + [f"{prose(2800 + i, 30)} {prose(2900 + i % 8, 60)}" for i in range(40)]
    rows = [(i, -1 if i == 0 else 0, 0, substrings.numbers_of(t.encode())) for i, t in enumerate(texts)]
    want = passages_and_classes([r for x in rows for y in rows[: x[0]] for r in substrings.compare(False, True, [y, x])])
    halves = [(t, int(side == 0 and t % 2), s, p) for t, side, s, p in rows[1:]]
    halves = [rows[0], *sorted(halves, key=lambda r: (r[1], r[0]))]
    for block in (7, 16, 1_000):
        monkeypatch.setattr(substrings, "BLOCK", block)
        assert passages_and_classes(substrings.compare_tile(True, rows)) == want
        parts = list(substrings.compare_tile(False, halves))
        for side in (0, 1):
            parts += substrings.compare_tile(True, [rows[0], *((t, 0, s, p) for t, k, s, p in halves[1:] if k == side)])
        assert passages_and_classes(parts) == want


def test_pieces_of_a_large_hub_go_to_few_tiles(spark, monkeypatch):
    """However many blocks it has, and texts of pairs go to the tile of the first one."""
    monkeypatch.setattr(substrings, "BLOCK", 4)
    hub = [(True, i, 3, 1, 10, 80, 0, 1) for i in range(3, 403)] + [(True, i, 2, 1, 10, 80, 0, 1) for i in range(2, 8)]
    pairs = [(False, i, 1, 2, 5, 60 + i, 10 - i, 70) for i in range(2, 9)]
    met = spark.createDataFrame(
        hub + pairs, "hubbed boolean, text long, first_text long, meets long, lo long, hi long, first_lo long, first_hi long"
    )
    rows = substrings.tiles(met).collect()
    parts = {(r.hubbed, r.one): r.parts for r in rows}
    assert parts == {(True, 3): substrings.PARTS, (True, 2): 2, (False, 1): 1}
    assert {r.part for r in rows if r.hubbed and r.one == 3} == {-1, 0, 1, 2, 3}
    listed = sorted((r.part, r.text, r.lo, r.hi, r.first_lo, r.first_hi) for r in rows if not r.hubbed)
    assert listed == [(-1, 1, 2, 70, 0, 0)] + [(0, i, 5, 60 + i, 10 - i, 70) for i in range(2, 9)]


def test_links_of_near_copies_grow_with_the_copies(spark):
    """Not with their pairs."""
    texts = near_copies(90, 2760)
    df = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("xxhash64(text) text_id", "text")
    found = [tuple(r) for r in substrings.links(df).collect()]
    pieces = sorted((r.text_id, 0, 0, substrings.numbers_of(r.text.encode())) for r in df.collect())
    plain = [r for i, x in enumerate(pieces) for y in pieces[:i] for r in substrings.compare(False, True, [y, x])]
    assert passages_and_classes(found) == passages_and_classes(plain)
    assert len(found) < 4 * len(texts) < len(plain) / 4


def test_shuffles_that_led_to_a_table_are_not_kept(spark):
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def kept():
        return {f for d in dirs for _, _, names in os.walk(d) for f in names if re.match(r"shuffle_.*\.data", f)}

    before, setting = kept(), spark.conf.get(substrings._FREED, None)
    saved = substrings._saved(spark.range(50_000).repartition(3, "id"), "freed")
    for _ in range(50):
        if not (more := kept() - before):
            break
        time.sleep(0.1)
    assert not more and saved.count() == 50_000 and spark.conf.get(substrings._FREED, None) == setting


def test_verification_with_known_mates_changes_nothing():
    rng = np.random.default_rng(17)
    found = 0
    for i in range(600):
        a = rng.integers(0, rng.choice([3, 30, 100_000]), 160).astype(np.uint32)
        s, t, m = rng.integers(0, 100, 3)
        b = np.concatenate([a[:t], a[s : s + m], a[t:]]) if i % 3 else np.delete(a, slice(s, s + m // 4))
        for _ in range(rng.integers(0, 8)):
            b[rng.integers(0, len(b))] = rng.integers(0, 100)
        shared = substrings._Shared([substrings.shingles(x) for x in (a, b)])
        x, y = (substrings.shingles(v) for v in (a, b))
        assert shared.simple.tolist() == [len(set(v.tolist())) == len(v) for v in (x, y)]
        for one, two, p, q in ((0, 1, x, y), (1, 0, y, x), (0, 1, x, y)):
            mates = [next((j for j, w in enumerate(q.tolist()) if w == v), -1) for v in p.tolist()]
            assert shared.mates(one, two).tolist() == substrings.mates_of(p, q).tolist() == mates
            plain = substrings.verified(p, q)
            assert substrings.verified(p, q, shared.mates(one, two), shared.simple.all()) == plain
            assert not plain or shared.able.all()
            found += len(plain)
    assert found > 600


def test_words_are_counted_as_split():
    rng = random.Random(18)
    for _ in range(200):
        texts = [rng.choice((None, "", "".join(rng.choice("ab \t\n\r\v\f\x1c\u00a0é ") for _ in range(rng.randrange(25))))) for _ in range(5)]
        [got] = substrings._counter()(common.strings(texts))
        assert got.to_pylist() == [len((t or "").encode().split()) for t in texts]


def test_members_that_share_too_little_are_not_verified(monkeypatch):
    """Neither with one another nor with the hub; pieces may be numbers of words."""
    phrase = prose(2400, 20)
    texts = [f"{prose(2500 + i, 30)} {phrase} {prose(2600 + i // 2, 40)} {prose(2700 + i, 30)}".encode() for i in range(60)]
    rows = [(i, -1 if i == 0 else 0, 0, t) for i, t in enumerate(texts)]
    asked, plain = [], substrings.verified
    monkeypatch.setattr(substrings, "verified", lambda *args: asked.append(1) or plain(*args))
    found = substrings.compare(True, True, rows)
    assert len(asked) <= 35 and {(r[0], r[3]) for r in found} == {(i + 1, i) for i in range(0, 60, 2)}
    assert substrings.compare(True, True, [(*r[:3], substrings.numbers_of(r[3])) for r in rows]) == found


def test_shared_shingles_are_counted_in_matrices_and_lists(monkeypatch):
    rng = np.random.default_rng(12)
    arrays = [np.unique(rng.integers(0, 40, rng.integers(0, 25)) ** 2).astype(np.uint64) for _ in range(30)]
    ends = np.cumsum([0] + [len(x) for x in arrays])
    weights, there = rng.random(ends[-1]) < 0.5, rng.random(ends[-1]) < 0.5
    parts = [(x, weights[e : e + len(x)], there[e : e + len(x)]) for x, e in zip(arrays, ends)]
    left, right = np.arange(3, 14), np.arange(10, 30)
    want = [[[w[np.isin(x, y[t])].sum() for y, _, t in (parts[j] for j in right)] for x, w, _ in (parts[i] for i in left)],
            [[w[np.isin(y, x[t])].sum() for y, w, _ in (parts[j] for j in right)] for x, _, t in (parts[i] for i in left)]]
    for rare, pairs, columns in ((0, 1, 7), (1, 1 << 21, 7), (4, 5, 7), (1 << 20, 7, 3)):
        monkeypatch.setattr(substrings, "_RARE", rare)
        monkeypatch.setattr(substrings, "_PAIRS", pairs)
        monkeypatch.setattr(substrings, "_COLUMNS", columns)
        assert np.array_equal(substrings._Shared(arrays).sums(left, right, weights, there), want)


def test_meetings_are_all_pairs_or_members_of_a_hub():
    rng = np.random.default_rng(8)
    rows = np.unique(rng.integers(0, [[30], [25], [3]], (3, 900)), axis=1)
    rows = np.concatenate([rows[:, rows[0] != 4], np.stack([np.full(5, 40), np.arange(5), np.arange(5)])], 1)
    rows = rows[:, np.lexsort(rows[::-1])]
    twice = np.repeat(rows, 2, axis=1)
    want = set()
    for key in np.unique(rows[0]):
        own = [(int(t), int(p)) for k, t, p in rows.T if k == key]
        if len(own) > substrings.LISTED_WINDOWS:
            want |= {(True, t, p, own[0][0], 0) for t, p in own}
        else:
            want |= {(False, t, p, f, q) for f, q in own for t, p in own if f < t}
    for size in (1, 7, 100, 5_000):
        got, hub, kept = [], None, rows[:, :0]
        for i in range(0, twice.shape[1], size):
            hub, kept, found = substrings._met(np.concatenate([kept, twice[:, i : i + size]], 1), hub, False)
            got += [tuple(r.values()) for r in found.to_pylist()]
        got += [tuple(r.values()) for r in substrings._met(kept, hub, True)[2].to_pylist()]
        assert set(got) == want


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text: str) -> list:
    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            twice = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(twice) % 10 == 0
        return kind != "phone" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m.group())]


def test_entities_are_those_of_the_patterns(spark):
    rng = random.Random(9)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "001.02.3.255", "10.0.0.1", "0.00.000.0", "0256.1.1.1", "4539 1488 0343 6467", "4539148803436467",
              "+1 (555) 123-4567", "+12", " ", "é", "🙂", "-", ".", "12", "word", "_%+", "a@b.c.d_e@f.gh", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    texts += ["a" * 40_000, "1" * 40_000, "a." * 9000 + "@b" + ".c" * 9000, "1 " * 20_000, "+" * 5000 + "1-" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.sanitise(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = [(k, s.start, s.end) for k in pii.KINDS for s in r[k]]
        assert got == plain_spans(texts[r.doc_id])


def test_terms_that_give_entities_away(spark, odd, none):
    rows = []
    for i in range(12):
        rows.append((i, f"{prose(i, 30)} write to zyxwvut person at boss@corp.example now {prose(90 + i, 30)}"))
    rows += [(100 + i, prose(400 + i, 60) + " write to a person at once now") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.sanitise(df).collect():
        terms = [s.value for s in r.remove]
        assert ('zyxwvut' in terms) == (r.doc_id < 100) and len(terms) <= 4
        if r.doc_id < 100:
            assert "zyxwvut" not in r.sanitised and "[EMAIL]" in r.sanitised
        else:
            assert r.sanitised is None
    assert pii.sanitise(odd).count() == len(ODD)
    assert pii.sanitise(none).count() == 0


def test_terms_of_a_domain_are_those_of_plain_counts(spark):
    """Each address stands once, so only their domain can tie a term to them."""
    rng = random.Random(21)
    common = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    some = lambda n: [rng.choice(common) for _ in range(n)]
    rows = []
    for i in range(300):
        words = some(14)
        if i % 10 == 0:
            words += ["Quillon" if i % 20 else "QUILLON", f"u{i}@corp.example"] + some(8)
        elif i % 25 == 0:
            words += ["quillon", f"v{i}@other.example"] + some(8)
        elif i % 30 == 1:
            words += ["vexford"]
        if i % 40 == 0:
            words = some(9) + ["vexford", f"x{i}@corp.example"] + some(9)
        rows.append((i, " ".join(words)))
    rows += rows[:11]  # copies are documents, but no contexts of their own
    entity = lambda w: w.split("@")[1] if "@" in w else None
    n = len(rows)
    texts = [t.split() for _, t in rows]
    has_entity, has_term, both, contexts = Counter(), Counter(), Counter(), {}
    for words in texts:
        has_entity.update({entity(w) for w in words if "@" in w})
        has_term.update(set(re.findall("[a-z0-9]+", " ".join(words).lower())))
        near = set()
        for i, w in enumerate(words):
            if "@" in w:
                before, after = words[max(0, i - 6) : i], words[i + 1 : i + 7]
                for x in [v.lower() for v in before + after if v.isalpha()]:
                    near.add((entity(w), x))
                    contexts.setdefault((entity(w), x), set()).add((*before, "|", *after))
        both.update(near)
    share = {
        (e, t): math.log2(both[e, t] * n / (has_entity[e] * has_term[t])) / math.log2(n / has_entity[e])
        for e, t in both if len(contexts[e, t]) >= 3
    }
    want = {k: s for k, s in share.items() if s >= 0.6}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.sanitise(df).collect()
    assert {t for _, t in want} >= {"quillon"} and len(want) >= 2
    for r in found:
        words = rows[r.doc_id][1].split()
        held = {entity(w) for w in words if "@" in w}
        best: dict = {}
        for (e, t), s in want.items():
            if e in held and t in [w.lower() for w in words]:
                best[t] = max(s, best.get(t, 0))
        assert {s.value.lower() for s in r.remove} == {t for t, s in best.items() if s >= 0.8}
        assert {s.value.lower() for s in r.generalise} == {t for t, s in best.items() if s < 0.8}
        if r.sanitised is not None:
            assert "example" not in r.sanitised
        for s in r.generalise:
            mark = "[ACRONYM]" if s.value.isupper() else "[NAME]" if s.value[0].isupper() else "[WORD]"
            assert mark in r.sanitised
    assert any(r.generalise for r in found)


def test_an_entity_of_all_documents_discloses_nothing(spark):
    rows = [(i, f"{prose(i, 9)} zyxwvut writes from boss@corp.example {prose(50 + i, 9)}") for i in range(5)]
    found = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 5 and all(len(r.email) == 1 and r.remove == r.generalise == [] for r in found)


def test_pii_has_no_python_node(spark, odd):
    plan = pii.sanitise(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# WARC


def test_derivatives_refer_to_their_response(spark):
    html = "<html lang='en'><head><title>A &amp; B</title><script>x='<p>'</script></head><body><p>One <b>two</b></p><a href='/x'>three</a><!-- no --></body></html>"
    pages = spark.createDataFrame([(1, "http://a", html), (1, "http://a", html), (2, None, None)], "page_id long, url string, html string")
    source = warc.responses(pages)
    rows = warc.derive(source).collect()
    assert len(rows) == 6
    ids = {r.record_id for r in source.collect()}
    assert {r.refers_to for r in rows} == ids and len(ids) == 2
    text = next(r for r in rows if r.source_id == 1 and r.warc_type == "conversion")
    assert text.content == "One two\nthree"
    assert text.block_digest == "sha256:" + hashlib.sha256(text.content.encode()).hexdigest()
    assert text.source_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert f"Content-Length: {len(html)}" in text.source_header
    about = next(r for r in rows if r.source_id == 1 and r.warc_type == "metadata")
    assert "title: A & B" in about.content and "outlink: /x" in about.content
    assert all(r.content == "" for r in rows if r.source_id == 2 and r.warc_type == "conversion")
    assert warc.derive(source.limit(0)).count() == 0
    record = warc.rendered(warc.derive(source)).first().value
    assert record.startswith("WARC/1.0\r\n") and "WARC-Refers-To: <urn:uuid:" in record
    assert "X-Source-Header: HTTP/1.1 200 OK\r\nX-Source-Header: Content-Type: " in record
    assert "WARC-Date" not in record


@pytest.mark.parametrize(
    "html, text",
    [
        ("caf&eacute; &mdash; it&#8217;s &#x1F600;&#X41;", "café — it’s 😀A"),
        ("&amp;lt; &amp &; &nosuch; &#0; &#xD800; &#1114112; &&lt;&", "&lt; &amp &; &nosuch; &#0; &#xD800; &#1114112; &<&"),
        ("a&nbsp;b&#65279;c&apos;", "a bc'"),
        ("a<script>b < c; d", "a"),
        ("a<!-- b <p>c", "a"),
        ("a<style>b{}</style>c<title>d", "ac"),
        ("a<STYLE>b</Style >c<!-->d-->e", "ace"),
        ("&lt;b&gt;x&lt;/b&gt;", "<b>x</b>"),
        ("", ""),
        ("w&eacute; " * 200_000, ("wé " * 200_000).strip()),
    ],
)
def test_text_of_a_page(spark, html, text):
    rows = spark.createDataFrame([(html,)], "html string")
    assert rows.select(warc.plain_text(F.col("html")).alias("t")).first().t == text


def test_every_reference_of_the_standard_is_resolved(spark):
    import html.entities

    names = {n: c for n, c in html.entities.name2codepoint.items() if c != 160}
    rows = spark.createDataFrame([(f"&{n};", chr(c)) for n, c in names.items()], "r string, c string")
    assert rows.where(warc.unescaped(F.col("r")) != F.col("c")).count() == 0


def test_derivatives_read_no_clashing_column(spark):
    pages = spark.createDataFrame(
        [(1, "http://a", "<p>x", "own", "y", "2026-01-02T03:04:05Z"), (None, None, None, None, None, None)],
        "page_id long, url string, html string, record_id string, content string, date string",
    )
    plain = warc.derive(warc.responses(pages.select("page_id", "url", "html"))).collect()
    assert warc.derive(warc.responses(pages)).collect() == plain
    dated = warc.derive(warc.responses(pages, date="date"))
    assert {r.date for r in dated.collect()} == {"2026-01-02T03:04:05Z", None}
    assert any("WARC-Date: 2026-01-02T03:04:05Z" in r.value for r in warc.rendered(dated).collect())


# Queries and pipeline


def test_folds_are_those_of_crc32(spark):
    rows = spark.range(50).select("id", common.fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_pipeline_stages(spark, odd, none, labels, benchmark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "encoding"]
    for docs in (odd.select(*[c.split()[0] for c in SCHEMA.split(", ")]), none):
        for name, stage in pipeline.STAGES:
            if name == "encoding" and not HAS_VOCABULARY:
                continue
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= docs.count()
            if name != "encoding":
                assert out.columns == docs.columns


def test_near_duplicate_stage_keeps_one_of_each_group(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b = prose(1, 200), prose(2, 200)
    df = spark.createDataFrame([(1, a), (2, a), (2, a), (3, b), (3, b), (4, prose(3, 100)), (None, a)], "doc_id long, text string")
    kept = sorted((r.doc_id for r in pipeline.near_duplicates(spark, df, "").collect()), key=str)
    assert kept == [1, 3, 4, None]


def test_near_duplicate_stage_knows_rows_by_id_and_text(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b = prose(1, 200), prose(2, 200)
    rows = [(1, a, "x", 1), (5, b, "y", 2), (5, a, "z", 3), (7, b + " end", "x", 4), (7, None, "", 5), (8, "", "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SimHash string, component long")
    out = pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [rows[0], rows[1], rows[4]]


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in __import__("qaprep.llm.sql", fromlist=["x"]).ORACLES])
def test_sql_counterpart(spark, name):
    from tests.compare import compare, connect
    from qaprep.llm.sql import ORACLES

    assert compare(connect(SMALL), queries.QUERIES[name](spark, SMALL), ORACLES[name]) == ""


def test_places_of_very_long_texts(spark):
    low = np.array([0, 5, 2_097_152, 5_000_000, 2**31 - 2])
    high = low + np.array([0, 3_000_000, 60, 2_500_000, 1])
    df = spark.createDataFrame([(int(p),) for p in substrings._packed(low, high)], "place long")
    found = df.select(substrings._low("place"), substrings._high("place")).collect()
    assert [tuple(r) for r in found] == [(a, b + 1) for a, b in zip(low.tolist(), high.tolist())]
