from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from qaprep.functions import stem as stemmer
from qaprep.functions.counts import clipped_matches
from qaprep.functions.lcs import lcs_length, positions
from qaprep.functions.stem import porter_stem
from qaprep.functions.stem_rules import stem_vocabulary, with_stems
from qaprep.functions.text import rouge_tokens
from qaprep.operators import scoring
from qaprep.operators.oracle import oracle_reference, select_oracle
from qaprep.plans.evaluate import evaluate, evaluate_saved, text_metrics
from tests import brute

WORDS = "the cat sat on a mat running happily relational hopes hoped a the".split()


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(7)
    rows = [
        (
            i,
            f"base_seed{i % 3}",
            " ".join(rng.choices(WORDS, k=rng.randint(0, 12))),
            " ".join(rng.choices(WORDS, k=rng.randint(0, 90))),
        )
        for i in range(120)
    ]
    rows.append((120, "base_seed0", "the cat sat on a mat", "the cat sat on a mat"))
    schema = "row_id long, run string, predicted string, reference string"
    return spark.createDataFrame(rows, schema), rows


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("agreed", "agre"),
        ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"),
        ("relational", "relat"), ("vietnamization", "vietnam"), ("goodness", "good"),
        ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("cease", "ceas"),
        ("dying", "die"), ("skies", "sky"), ("enjoy", "enjoy"), ("hopefully", "hope"),
    ],
)
def test_porter_stem(word, stem):
    assert porter_stem(word) == stem


def test_lcs_length_against_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 90))]
        b = [rng.randint(0, 5) for _ in range(rng.randint(0, 150))]
        expected = brute.lcs(a, b)
        assert lcs_length(a, positions(b), len(b)) == expected
        assert lcs_length(b, positions(a), len(a)) == expected


def test_clipped_matches(pairs):
    df, rows = pairs
    tokens = [rouge_tokens(F.col(c)) for c in ("predicted", "reference")]
    got = {r[0]: r[1] for r in df.select("row_id", clipped_matches(*tokens)).collect()}
    for i, _, a, b in rows:
        shared = brute.grams(brute.tokens(a), 1) & brute.grams(brute.tokens(b), 1)
        assert got[i] == shared.total()


@pytest.mark.parametrize("stem", [False, True])
def test_rouge_of_rows(pairs, stem):
    from qaprep.plans.evaluate import with_rouge

    df, rows = pairs
    got = {r["row_id"]: r for r in with_rouge(df, stem).collect()}
    for i, _, p, r in rows:
        a, b = brute.tokens(p, stem), brute.tokens(r, stem)
        assert got[i]["rouge1"] == pytest.approx(brute.rouge_n(a, b, 1))
        assert got[i]["rouge2"] == pytest.approx(brute.rouge_n(a, b, 2))
        assert got[i]["rougeL"] == pytest.approx(brute.rouge_l(a, b))
        assert 0 <= got[i]["rougeL"] <= 1


@pytest.mark.parametrize("mode", ["ws", "13a"])
def test_bleu(pairs, mode):
    df, rows = pairs
    split = [(i, run, p.split(), r.split()) for i, run, p, r in rows]
    floor = 1 if mode == "ws" else 0
    corpus = {r["run"]: r["bleu"] for r in scoring.corpus_bleu(df, ["run"], mode).collect()}
    for run in corpus:
        assert corpus[run] == pytest.approx(
            brute.bleu([(p, r) for _, g, p, r in split if g == run], floor)
        )
    each = {r["row_id"]: r["bleu_score"] for r in scoring.sentence_bleu(df, mode).collect()}
    for i, _, p, r in split:
        assert each[i] == pytest.approx(brute.bleu([(p, r)], floor))


def test_identical_pair(spark):
    df = spark.createDataFrame([("hello world",) * 2], "predicted string, reference string")
    row = text_metrics(df).first()
    assert row["rougeL"] >= 0.9
    assert row["bleu"] == 0.0  # two words have no 3-grams and BLEU is not smoothed


def test_empty_table_scores_zero(spark):
    df = spark.createDataFrame([], "predicted string, reference string")
    assert list(text_metrics(df).first()) == [0.0] * 4
    assert list(evaluate(df).first()) == [0.0] * 5


def test_exact_match(spark):
    rows = [("a", "a"), ("a", "b"), (None, ""), ("", "x")]
    df = spark.createDataFrame(rows, "predicted string, reference string")
    assert scoring.exact_match(df).first()[0] == 0.5


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([("a",)], "predicted string")
    with pytest.raises(ValueError, match="reference"):
        evaluate(df)


def test_oracle_ties_keep_the_earlier_sentence(spark):
    text = ["x x x x same", "y y y y same", "z z z z same", "w w w w same", "same"]
    df = spark.createDataFrame([(text, "same"), ([], "same"), (["too short"], "same")], "s array<string>, r string")
    rows = [r["o"] for r in df.select(select_oracle(F.col("s"), F.col("r")).alias("o")).collect()]
    assert rows[0]["text"] == " ".join(text[:3])
    assert [(r["text"], r["score"]) for r in rows[1:]] == [("", 0.0)] * 2


def test_oracle_reference_modes(one):
    def reference(mode):
        return lambda q, label: oracle_reference(q, label, mode)

    assert one(reference("label"), "q", "l") == "l"
    assert one(reference("query_only"), "q", "l") == "q"
    assert one(reference("query_label"), "q", "l") == "q l"
    with pytest.raises(ValueError):
        oracle_reference(None, None, "title")


def test_three_ways_of_stemming_agree(spark):
    """Arrow batches, built-in functions and SQL, on words made of known endings."""
    rng = random.Random(1)
    ends = [*[old for old, _ in stemmer.DERIVED + stemmer.ADJECTIVAL], *stemmer.RESIDUAL, "s", "es", "ies", "sses", "ied"]
    ends += ["eed", "ed", "ing", "y", "yy", "e", "ll", "logi", "alli", "ting", "bled", "ized", "hopping", ""]
    words = {*stemmer.IRREGULAR, "", "a", "sky", "ied", "ieds", "syzygy"}
    for _ in range(8000):
        start = "".join(rng.choice("aeiouybcdlmnrstwxz1") for _ in range(rng.randint(0, 6)))
        words.add(start + "".join(rng.choice(ends) for _ in range(rng.choice([0, 1, 1, 2]))))
    given = sorted(words)
    want = stemmer.stem_words(given)
    assert list(brute.stemmed(tuple(given))) == want
    df = spark.createDataFrame([(w, "old") for w in given], "token string, stem string")
    assert {r.token: r.stem for r in with_stems(df).collect()} == dict(zip(given, want))


def test_stems_of_nothing(spark):
    df = spark.createDataFrame([(None,), ("",), ("Running RUNS",)], "text string")
    found = {r.token: (r.stem, r.n) for r in stem_vocabulary(df).collect()}
    assert found == {"running": ("run", 1), "runs": ("run", 1)}
    assert stem_vocabulary(df.limit(0)).count() == 0
    assert with_stems(spark.createDataFrame([(None,)], "token string")).first().stem is None


def test_rows_and_means_come_from_one_table(spark, tmp_path):
    rows = [(1, "a", "the cat sat on mats", "the cats sat on a mat", 9), (2, "a", None, "", 9), (3, "b", "x y z w", "x y z w", 9)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "row_id int, run string, predicted string, reference string, rouge1 int, kept string")
    means = {r.run: r for r in evaluate_saved(df, str(tmp_path / "rows"), ["run"]).collect()}
    saved = {r.row_id: r for r in spark.read.parquet(str(tmp_path / "rows")).collect()}
    assert [saved[k].exact_match for k in (1, 2, 3)] == [0.0, 1.0, 1.0]
    assert [saved[k].bleu_score for k in (2, 3)] == [0.0, 1.0] and saved[1].kept == "old"
    a, b = brute.tokens(rows[0][2], True), brute.tokens(rows[0][3], True)
    assert saved[1].rougeL == pytest.approx(brute.rouge_l(a, b))
    assert saved[1].rouge2 == pytest.approx(brute.rouge_n(a, b, 2))
    whole = {r.run: r for r in evaluate(df.drop("rouge1"), ["run"]).collect()}
    assert set(means) == set(whole)
    for run, row in means.items():
        assert tuple(row)[1:] == pytest.approx(tuple(whole[run])[1:])
    none = evaluate_saved(df.limit(0), str(tmp_path / "none")).first()
    assert tuple(none) == (0.0,) * 5
