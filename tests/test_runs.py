from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from qaprep.operators import runs
from qaprep.operators.running import CHUNK, balanced, number_rows
from tests.conftest import plan_text

WIDTH = 7


@pytest.fixture(scope="module")
def log(spark):
    """One hot run, some small ones and rows without a run."""
    rng = random.Random(3)
    sizes = {0: 400, 1: 60, 2: 1, 3: 35, None: 30}
    rows = [
        (run, step, float(rng.randint(0, 60)))
        for run, size in sizes.items()
        for step in rng.sample(range(1, 2 * size + 1), size)
    ]
    return spark.createDataFrame(rows, "run int, step long, metric double"), rows


def _by_run(rows):
    grouped = {}
    for run, step, metric in sorted(rows, key=lambda r: r[1]):
        grouped.setdefault(run, []).append((step, metric))
    return grouped


@pytest.mark.parametrize("greater", [True, False])
def test_running_best(log, greater):
    df, rows = log
    got = {
        (r["run"], r["step"]): (r["best_before"], r["improved"])
        for r in runs.running_best(df, greater=greater, width=WIDTH).collect()
    }
    assert len(got) == len(rows)
    for run, evals in _by_run(rows).items():
        best = None
        for step, metric in evals:
            better = best is None or (metric > best if greater else metric < best)
            assert got[run, step] == (best, better)
            best = metric if better else best


@pytest.mark.parametrize(("patience", "greater"), [(1, True), (5, True), (5, False), (1000, True)])
def test_early_stop_and_best_checkpoint(log, patience, greater):
    df, rows = log
    stops = {r["run"]: r for r in runs.early_stop(df, patience, greater=greater, width=WIDTH).collect()}
    best_rows = runs.best_checkpoint(df, patience, greater=greater, width=WIDTH).collect()
    best_steps = {r["run"]: r["best_step"] for r in best_rows}
    for run, evals in _by_run(rows).items():
        best = best_step = stop = None
        waited = seen = 0
        for step, metric in evals:
            seen += 1
            if best is None or (metric > best if greater else metric < best):
                best, best_step, waited = metric, step, 0
            else:
                waited += 1
            if waited >= patience:
                stop = step
                break
        row = stops[run]
        assert (row["stop_step"], row["n_evals"]) == (stop, seen)
        assert (row["best_metric"], row["best_step"]) == (best, best_step)
        assert best_steps[run] == best_step


def test_best_checkpoint_without_a_stop(log):
    df, rows = log
    got = {r["run"]: (r["best_metric"], r["best_step"]) for r in runs.best_checkpoint(df).collect()}
    for run, evals in _by_run(rows).items():
        best = max(m for _, m in evals)
        assert got[run] == (best, min(s for s, m in evals if m == best))


def test_no_window_is_over_the_run_alone(log):
    df, _ = log
    plan = plan_text(runs.running_best(df, width=WIDTH))
    windows = [line for line in plan.splitlines() if " Window [" in line]
    row_windows = [w for w in windows if "_value" in w.split("windowspecdefinition")[0]]
    assert row_windows
    assert all("_chunk" in w.split("windowspecdefinition")[1].split(" ASC")[0] for w in row_windows)


def test_number_rows(log):
    df, rows = log
    chunk = F.floor(F.col("step") / WIDTH)
    numbered = number_rows(df, ["run"], [F.col("step")], chunk, "n")
    got = {(r["run"], r["step"]): r["n"] for r in numbered.collect()}
    for run, evals in _by_run(rows).items():
        for n, (step, _) in enumerate(evals, 1):
            assert got[run, step] == n


def test_step_profile(spark):
    """Repeated steps and steps that fall back are skipped, as in a live log."""
    rng = random.Random(5)
    rows = []
    for run in range(3):
        clock = 100.0
        for _ in range(80):
            clock += rng.randint(1, 9) / 4
            rows.append((run, max(0, int(clock) - 100 - rng.randint(0, 6)), clock))
    df = spark.createDataFrame(rows, "run int, step long, ts_s double")
    got = {
        (r["run"], r["step"]): (r["step_time_sec"], r["steps_per_sec"])
        for r in runs.step_profile(df, width=WIDTH).collect()
    }
    expected = {}
    for run in range(3):
        logs = [(s, t) for g, s, t in rows if g == run]
        zeros = [t for s, t in logs if s == 0]
        last_step, last_time = 0, min(zeros) if zeros else logs[0][1]
        for step, ts in logs:
            if step == 0 or step <= last_step:
                continue
            each = (ts - last_time) / (step - last_step)
            rate = round(1.0 / each, 4) if each > 0 else None
            expected[run, step] = (round(each, 4), rate)
            last_step, last_time = step, ts
    assert got.keys() == expected.keys()
    for key, (seconds, rate) in expected.items():
        assert got[key][0] == pytest.approx(seconds, abs=1.1e-4)
        assert got[key][1] == pytest.approx(rate, abs=1.1e-4)


def test_step_profile_without_a_start(spark):
    df = spark.createDataFrame([(1, 5, 10.0), (1, 10, 15.0)], "run int, step long, ts_s double")
    rows = sorted(tuple(r) for r in runs.step_profile(df).collect())
    assert rows == [(1, 5, 0.0, None), (1, 10, 1.0, 1.0)]


@pytest.mark.parametrize("by", [[], ["team"]])
def test_pareto(spark, by):
    rng = random.Random(9)
    rows = [
        (i, rng.choice(["a", "a", "b", None]), float(rng.randint(0, 25)), float(rng.randint(0, 25)))
        for i in range(150)
    ]
    df = spark.createDataFrame(rows, "id int, team string, latency double, rougeL double")
    got = {r["id"] for r in runs.pareto(df, by, chunks=5).collect()}
    expected = {
        i
        for i, team, lat, q in rows
        if not any(
            (not by or other == team) and a <= lat and b >= q and (a < lat or b > q)
            for _, other, a, b in rows
        )
    }
    assert got == expected


def test_compare_runs_and_seed_variance(spark):
    rows = [
        ("big_seed1", "bleu", 0.5), ("big_seed2", "bleu", 0.7), ("big_seed1", "loss", 2.0),
        ("small", "bleu", 0.25), ("gone", None, None),
    ]
    df = spark.createDataFrame(rows, "run string, metric string, value double")
    table = {r["run"]: r for r in runs.compare_runs(df, baseline="small").collect()}
    assert set(table) == {"big_seed1", "big_seed2", "small", "gone"}
    assert table["big_seed1"]["bleu_ratio"] == 2.0
    assert table["big_seed1"]["loss_ratio"] is None
    assert table["gone"]["bleu"] is None
    spread = {(r["config"], r["metric"]): r for r in runs.seed_variance(df).collect()}
    assert spread["big", "bleu"]["n_runs"] == 2
    assert spread["big", "bleu"]["mean"] == pytest.approx(0.6)
    assert spread["big", "bleu"]["stddev"] == pytest.approx(0.02**0.5)
    assert ("small", "bleu") not in spread


def test_mean_loss_is_over_batches(spark):
    df = spark.createDataFrame(
        [("r", 1, 2.0), ("r", 1, 4.0), ("r", 2, 1.0)], "run string, epoch int, loss double"
    )
    assert sorted(tuple(r) for r in runs.mean_loss(df).collect()) == [("r", 1, 3.0), ("r", 2, 1.0)]


def test_nan_and_null_never_improve(spark):
    nan = float("nan")
    data = [("r", i, v) for i, v in enumerate([None, 1.0, nan, 3.0, None, 4.0], 1)]
    df = spark.createDataFrame(data, "run string, step long, metric double")
    for greater, wanted in ((True, {2, 4, 6}), (False, {2})):
        best = runs.running_best(df, greater=greater).where("improved").collect()
        assert {r["step"] for r in best} == wanted
        stop = runs.early_stop(df, 9, greater=greater).first()
        assert (stop["best_metric"], stop["best_step"]) == ((4.0, 6) if greater else (1.0, 2))
        mark = runs.best_checkpoint(df, greater=greater).first()
        assert mark["best_step"] == (6 if greater else 2)


def test_points_without_latency_are_left_out(spark):
    nan = float("nan")
    data = [(None, 0.9), (nan, 0.95), (1.0, 0.5), (2.0, 0.7), (3.0, nan), (4.0, None), (5.0, 0.6)]
    df = spark.createDataFrame(data, "latency double, rougeL double")
    assert sorted(tuple(r) for r in runs.pareto(df).collect()) == [(1.0, 0.5), (2.0, 0.7)]


def test_a_metric_may_be_named_null(spark):
    data = [("a", "null", 2.0), ("b", "null", 4.0), ("b", None, 9.0), ("c", None, 1.0)]
    df = spark.createDataFrame(data, "run string, metric string, value double")
    rows = {r["run"]: r["null_ratio"] for r in runs.compare_runs(df, baseline="a").collect()}
    assert rows == {"a": 1.0, "b": 2.0, "c": None}


def _chunk_sizes(df, width):
    placed = balanced(df, ["run"], "step", width)
    return {tuple(r[CHUNK]): r["count"] for r in placed.groupBy(CHUNK).count().collect()}


@pytest.mark.parametrize(
    "step",
    [
        "id",
        "id * 1000000",  # wide gaps
        "id % 2",  # all rows on two steps
        "7",  # and on one
        "if(id < 1900, id % 3, id * 1000000000000)",  # dense, then far away
        "if(id % 4 > 0, id * 5 - 3000, null)",  # NULL and negative steps
    ],
    ids=["each", "gaps", "two", "one", "dense", "null"],
)
def test_chunks_are_even_whatever_the_steps(spark, step):
    rows = spark.range(2000).select(
        F.lit(1).alias("run"), F.expr(step).cast("long").alias("step"), (F.xxhash64("id") % 97).cast("double").alias("metric"), "id"
    )
    sizes = _chunk_sizes(rows, 50)
    assert sum(sizes.values()) == 2000
    assert max(sizes.values()) <= 150 and len(sizes) >= 20
    ordered = sorted(rows.select("step", "metric", F.xxhash64("run", "step", "metric", "id").alias("h")).collect(),
                     key=lambda r: (r.step is not None, r.step, r.h))
    best, want = None, []
    for r in ordered:
        want.append((r.step, r.metric, best, best is None or r.metric > best))
        best = r.metric if best is None else max(best, r.metric)
    got = [tuple(r) for r in runs.running_best(rows, width=50).select("step", "metric", "best_before", "improved").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_equal_rows_have_one_result(spark):
    """Rows of one step in a fixed order, however they are dealt."""
    rows = [("r", 1, m) for m in (3.0, 1.0, 2.0, 2.0, None)] + [("r", 2, 2.5), (None, 1, 1.0), (None, None, 4.0)]
    df = spark.createDataFrame(rows, "run string, step long, metric double")
    results = []
    for n in (1, 3, 7):
        best = runs.running_best(df.repartition(n), width=2).collect()
        stop = runs.early_stop(df.repartition(n), 2, width=2).collect()
        results.append((sorted(map(str, best)), sorted(map(str, stop))))
    assert results[0] == results[1] == results[2]


def test_an_empty_log(spark):
    df = spark.createDataFrame([], "run string, step long, metric double, ts_s double")
    assert runs.running_best(df).count() == runs.early_stop(df, 3).count() == runs.step_profile(df).count() == 0


def test_latency_percentiles_are_near_the_exact_ones(spark):
    rng = random.Random(8)
    sizes = {"hot": 3000, "one": 1, "few": 7}
    rows = [(run, rng.lognormvariate(0, 4) * rng.choice([1, 1, -1])) for run, n in sizes.items() for _ in range(n)]
    odd = [("hot", None), ("hot", float("nan")), ("hot", float("inf")), ("none", None), (None, 2.0)]
    df = spark.createDataFrame(rows + odd, "run string, latency double")
    found = {r.run: r for r in runs.latency_percentiles(df, percents=(1, 50, 95, 100)).collect()}
    assert set(found) == {"hot", "one", "few", None} and found[None].p50 == pytest.approx(2, rel=1 / 128)
    for run, size in sizes.items():
        values = sorted(v for r, v in rows if r == run)
        assert found[run].n_runs == size
        for p in (1, 50, 95, 100):
            exact = values[-(-size * p // 100) - 1]
            assert abs(found[run][f"p{p}"] - exact) <= abs(exact) / 128 + 1e-6
            assert abs(found[run][f"p{p}"]) <= abs(exact)


def test_latency_sketches_add_up(spark):
    df = spark.range(5000).selectExpr("id % 3 AS run", "id / 7 AS latency", "id")
    halves = [runs.latency_sketch(df.filter(F.col("id") % 2 == k)) for k in (0, 1)]
    merged = runs.sketch_quantiles(halves[0].union(halves[1])).collect()
    assert sorted(merged) == sorted(runs.latency_percentiles(df).collect())
    assert runs.latency_percentiles(df.limit(0)).count() == 0
