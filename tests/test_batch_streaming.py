from __future__ import annotations

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from qaprep.operators import batch, runs
from qaprep.plans.curate import CLEAN, curate
from qaprep.plans.tables import raw_qa
from qaprep.sources.writers import write_csv
from qaprep.streaming import evaluations
from qaprep.streaming.curation import RAW_SCHEMA, curate_stream
from tests.conftest import plan_text

SF = "/root/testdata/sf0.001"


def test_batches_have_the_given_size_and_rows_keep_their_prediction(spark):
    def make():
        def predict(texts):
            return np.array([f"{t}:{len(texts)}" for t in texts])

        return predict

    df = spark.range(0, 47, 1, 1).select("id", F.col("id").cast("string").alias("t"))
    rows = batch.batch_score(df, ["t"], make, batch_size=20).collect()
    assert all(r["prediction"].split(":")[0] == r["t"] for r in rows)
    assert max(int(r["prediction"].split(":")[1]) for r in rows) <= 20
    assert len(rows) == 47


def test_augment_prompts_and_checks(spark):
    def make():
        return lambda texts: np.array([t.upper() for t in texts])

    df = spark.createDataFrame([("abc",), (None,)], "target_text string")
    got = [r["target_text_paraphrase"] for r in batch.augment(df, make).collect()]
    assert sorted(got) == ["PARAPHRASE: ", "PARAPHRASE: ABC"]
    with pytest.raises(ValueError, match="target_text"):
        batch.augment(df.withColumnRenamed("target_text", "x"), make)


def test_score_pairs_takes_missing_text_as_empty(spark):
    def make():
        def predict(premises, hypotheses):
            pairs = zip(premises, hypotheses)
            return np.array([[len(p), len(h), 0] for p, h in pairs], dtype=np.float32)

        return predict

    df = spark.createDataFrame([("ab", None), ("a", "xyz")], "predicted string, reference string")
    rows = batch.score_pairs(df, make).collect()
    assert sorted((r["entailment"], r["neutral"]) for r in rows) == [(0.0, 2.0), (3.0, 1.0)]


def test_scores_to_columns(spark):
    scores = [("ENTAILMENT", 0.9), ("Neutral", 0.1), ("neutral", 0.2)]
    df = spark.createDataFrame([(scores,), ([],), (None,)], "s array<struct<label string, score double>>")
    columns = batch.scores_to_columns(F.col("s"))
    rows = [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]
    assert rows == [(0.9, 0.2, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_model_scores_may_be_vectors(spark):
    def make():
        return lambda texts: np.array([[1.0, 2.0] for _ in texts], dtype=np.float32)

    df = spark.createDataFrame([("a",)], "t string")
    row = batch.batch_score(df, ["t"], make, ArrayType(FloatType())).first()
    assert row["prediction"] == [1.0, 2.0]


def test_stream_gives_the_batch_result_once(spark, tmp_path):
    raw = raw_qa(spark, SF).select("query", "title", "abstract", "label")
    source, target, checkpoint = [str(tmp_path / n) for n in ("in", "out", "check")]
    write_csv(raw, source)
    for _ in range(2):
        curate_stream(spark, source, target, checkpoint).awaitTermination()
    back = spark.read.parquet(target)
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
    expected = curate(spark.read.schema(RAW_SCHEMA).options(**options).csv(source), CLEAN)
    assert sorted(map(str, back.collect())) == sorted(map(str, expected.collect()))
    assert back.count() > 0


def test_stream_finds_columns_by_name(spark, tmp_path):
    raw = raw_qa(spark, SF).select("label", "abstract", F.lit("x").alias("extra"), "title", "query")
    source, target, checkpoint = [str(tmp_path / n) for n in ("in", "out", "check")]
    write_csv(raw, source)
    curate_stream(spark, source, target, checkpoint).awaitTermination()
    expected = curate(raw.select("query", "title", "abstract", "label"), CLEAN)
    back = spark.read.parquet(target)
    assert back.count() == expected.count() > 0


def test_a_filter_does_not_run_the_model_twice(spark):
    def make():
        return lambda texts: np.array([float(len(t)) for t in texts])

    df = spark.createDataFrame([("a", "b")], "predicted string, reference string")
    scored = batch.batch_score(df, ["predicted"], make, DoubleType()).where("prediction > 0")
    assert plan_text(scored).count("ArrowEvalPython [") == 1
    assert scored.count() == 1


def _arrivals(folder, batches):
    """One JSON file for each batch of rows, each a second younger than the last."""
    folder.mkdir(exist_ok=True)
    have = len(list(folder.iterdir()))
    for i, rows in enumerate(batches, have):
        file = folder / f"{i}.json"
        file.write_text("".join(json.dumps(dict(zip(("run", "step", "metric"), r))) + "\n" for r in rows))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))


def _status(spark, folder, patience, greater):
    names = [str(folder / n) for n in ("in", "out", "checkpoint")]
    evaluations.early_stop_stream(spark, *names, patience, greater, files_per_trigger=1).awaitTermination()
    return evaluations.latest_status(spark.read.parquet(names[1]))


@pytest.mark.parametrize("greater", [True, False])
def test_early_stops_as_evaluations_arrive(spark, tmp_path, greater):
    rng = random.Random(4)
    value = lambda: rng.choice([float(rng.randint(0, 9)), float(rng.randint(0, 9)), math.nan, None])
    # Steps repeat within a batch, runs have a step now and then, one run has no name.
    batches = [
        [(run, 10 * b + rng.randint(0, 6), value()) for run in ("a", "b", None) for _ in range(rng.randint(0, 5))]
        for b in range(5)
    ]
    batches[0] += [("nan", 1, math.nan), ("nan", 2, math.nan), ("short", 3, 1.0)]
    rows = [r for b in batches for r in b]
    _arrivals(tmp_path / "in", batches[:3])
    _status(spark, tmp_path, 3, greater)
    _arrivals(tmp_path / "in", batches[3:])  # a second start goes on from the state
    found = _status(spark, tmp_path, 3, greater)
    expected = runs.early_stop(spark.createDataFrame(rows, evaluations.EVAL_SCHEMA), 3, greater=greater)
    assert sorted(map(repr, found.drop("n_late").collect())) == sorted(map(repr, expected.collect()))
    assert found.agg(F.sum("n_late")).first()[0] == 0


def test_late_evaluations_are_counted_and_change_nothing(spark, tmp_path):
    _arrivals(tmp_path / "in", [[("a", 5, 1.0), ("a", 6, 0.5)], [("a", 5, 9.0), ("a", 4, 9.0), ("a", 7, 0.5)], []])
    row = _status(spark, tmp_path, 2, True).collect()
    assert [tuple(r) for r in row] == [("a", 7, 3, 1.0, 5, 2)]
