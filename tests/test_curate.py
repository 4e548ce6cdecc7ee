from __future__ import annotations

import pytest

from qaprep.plans.curate import CLEAN, VARIANT, CurateOptions, curate, curation_report
from qaprep.plans.tables import raw_qa
from tests import brute
from tests.conftest import plan_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    rows = [r.asDict() for r in raw_qa(spark, SF).collect()]
    extra = [
        ("What holds?", None, "", "five words are in here"),
        ("What holds?", "", "Five words are in here. Yes.", "“Five words are in here”"),
        (None, "A title", "It was relating to relational tables and joins.", "relate relational tables and joins"),
        ("q", "t", "abc", None),
    ]
    for i, (query, title, abstract, label) in enumerate(extra):
        rows.append(
            {"row_id": -1 - i, "query": query, "title": title, "abstract": abstract, "label": label}
        )
    schema = "row_id long, query string, title string, abstract string, label string"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    return df, rows


@pytest.mark.parametrize("stem", [False, True])
def test_clean_curation(raw, stem):
    df, rows = raw
    got = {r["row_id"]: r for r in curate(df, CurateOptions(stem=stem), ("row_id",)).collect()}
    expected = {}
    for row in rows:
        cheap, text, score = brute.curate(row, stem=stem)
        if cheap and score >= 0.15 and text:
            expected[row["row_id"]] = (text, score)
    assert got.keys() == expected.keys()
    for key, (text, score) in expected.items():
        assert got[key]["oracle_text"] == got[key]["target_text"] == text
        assert got[key]["oracle_rougeL"] == pytest.approx(score)


def test_variant_curation(raw):
    df, rows = raw
    got = {r["row_id"]: r for r in curate(df, VARIANT, ("row_id",)).collect()}
    expected = {r["row_id"]: brute.curate(r, "full") for r in rows}
    assert got.keys() == {k for k, v in expected.items() if v[0]}
    for key, row in got.items():
        assert row["oracle_text"] == expected[key][1]


def test_target_styles(raw):
    df, _ = raw
    base = {"scope": "full", "score_filter": False}
    label = curate(df, CurateOptions(target_style="label", **base)).collect()
    assert all(r["target_text"] == r["label"] for r in label)
    bullets = curate(df, CurateOptions(target_style="bullets", **base)).collect()
    assert any(r["target_text"].count("\n- ") == 2 for r in bullets)
    ended = curate(df, CurateOptions(end_token="[END]")).collect()
    assert all(r["target_text"] == f"{r['oracle_text']} [END]" for r in ended)


def test_prompt_leaves_out_an_empty_title(raw):
    df, _ = raw
    for row in curate(df).collect():
        assert (" Title: " in row["input_text"]) == bool(row["title"])
        assert row["input_text"].startswith("Instruction: Answer the question")


def test_report_adds_up(raw):
    df, rows = raw
    report = curation_report(df, CLEAN).first()
    assert report["rows_before"] == len(rows)
    assert report["rows_after"] == curate(df).count()
    drops = [v for k, v in report.asDict().items() if k.startswith("dropped_")]
    assert sum(drops) == report["dropped"]


def test_curation_scores_once_and_does_not_shuffle(spark, tmp_path, raw):
    df, _ = raw
    path = str(tmp_path / "raw")
    df.write.parquet(path)
    plan = plan_text(curate(spark.read.parquet(path)))
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan


def test_options_are_checked(raw):
    with pytest.raises(ValueError):
        CurateOptions(scope="half")
    with pytest.raises(ValueError):
        CurateOptions(target_style="poem")
    with pytest.raises(ValueError, match="label"):
        curate(raw[0].drop("label"))
