"""Analysis of run logs: one job over many runs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from qaprep.operators.running import (
    ROWS_PER_CHUNK,
    balanced,
    chunked,
    ordered_by,
    running_before,
    unchunked,
)

SEED_PATTERN = r"^(.*)_seed(\d+)$"
FRONTIER_CHUNKS = 256
#: Parts of a group whose own frontiers are taken first.
FRONTIER_PARTS = 4096
#: Leading bits that a latency in microseconds keeps in a quantile sketch.
SKETCH_BITS = 8


def _direction(metric: str, greater: bool) -> Column:
    """The metric with its sign set so that larger is always better.

    NaN compares with nothing, so it becomes NULL and never counts as better.
    """
    value = F.col(metric) if greater else -F.col(metric)
    return F.when(~F.isnan(F.col(metric).cast("double")), value)


def running_best(
    df: DataFrame,
    run: str = "run",
    step: str = "step",
    metric: str = "metric",
    greater: bool = True,
    width: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add the best metric of earlier steps and whether this step improves it.

    Only a strict improvement counts; the first value of a run improves. NULL
    and NaN are no values. Rows of one step come one after another, in the order
    of a hash of their content. A run is cut into chunks of about `width` rows.
    """
    how = F.max if greater else F.min
    rows = balanced(df, [run], step, width)
    scanned = running_before(rows, ordered_by(step), "best_before", _direction(metric, True), how)
    best = unchunked(scanned, [run])
    value, before = _direction(metric, greater), _direction("best_before", greater)
    return best.withColumn("improved", F.coalesce(value > before, value.isNotNull()))


def early_stop(
    df: DataFrame,
    patience: int,
    run: str = "run",
    step: str = "step",
    metric: str = "metric",
    greater: bool = True,
    width: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Per run: the first step with `patience` evaluations since the best one.

    `stop_step` is NULL for a run that never stops. `best_metric` and
    `best_step` look at the steps up to the stop, the earliest step on ties.
    Evaluations of one step come one after another, in the order of a hash of
    step and metric. A run is cut into chunks of about `width` rows.
    """
    evals = df.filter(F.col(metric).isNotNull()).select(run, step, metric)
    rows, order = balanced(evals, [run], step, width), ordered_by(step)
    ranked = running_before(rows, order, "_rank", F.lit(1).cast("bigint"), F.sum)
    entry = F.struct(
        _direction(metric, greater).alias("score"),
        (-F.col("_rank")).alias("place"),
        F.col(step).alias("step"),
    )
    scanned = running_before(ranked, order, "_best", entry, F.max)
    state = F.struct(
        F.col(step).alias("step"),
        (F.col("_rank") + 1).alias("n_evals"),
        F.greatest(F.col("_best"), entry).alias("best"),
    )
    states = scanned.withColumn("_state", state)
    waited = F.col("_rank") + F.col("_state.best.place")
    # The state at the stop, or at the end of a run that never stops, holds
    # everything there is to report.
    ends = unchunked(states, [run]).groupBy(run).agg(
        F.min(F.when(waited >= patience, F.col("_state"))).alias("_stop"),
        F.max("_state").alias("_last"),
    )
    end = F.coalesce(F.col("_stop"), F.col("_last"))
    best = end["best"]["score"]
    return ends.select(
        run,
        F.col("_stop.step").alias("stop_step"),
        end["n_evals"].alias("n_evals"),
        (best if greater else -best).alias("best_metric"),
        end["best"]["step"].alias("best_step"),
    )


def best_checkpoint(
    df: DataFrame,
    patience: int | None = None,
    run: str = "run",
    step: str = "step",
    metric: str = "metric",
    greater: bool = True,
    width: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Best step of each run up to its early stop, the earliest on ties."""
    if patience is not None:
        stopped = early_stop(df, patience, run, step, metric, greater, width)
        return stopped.select(run, "best_step", "best_metric")
    evals = df.filter(_direction(metric, greater).isNotNull())
    entry = F.struct(
        _direction(metric, greater).alias("score"), (-F.col(step)).alias("place")
    )
    best = evals.groupBy(run).agg(F.max(entry).alias("_best"))
    score = F.col("_best.score") if greater else -F.col("_best.score")
    return best.select(
        run, (-F.col("_best.place")).alias("best_step"), score.alias("best_metric")
    )


def step_profile(
    df: DataFrame,
    run: str = "run",
    step: str = "step",
    ts: str = "ts_s",
    width: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Seconds per step and steps per second between logs of growing steps.

    A log counts only if its step is larger than that of every earlier log.
    Step 0 sets the start time and is not reported. Without it the start is
    unknown, and the first log reports 0 seconds and no rate.
    """
    first = df.groupBy(run, step).agg(F.min(ts).alias(ts))
    rows, order = balanced(first, [run], step, width), ordered_by(step)
    later = running_before(rows, order, "_later", F.col(ts), F.min, reverse=True)
    kept = later.filter(F.col("_later").isNull() | (F.col(ts) <= F.col("_later")))
    log = F.struct(F.col(step).alias("step"), F.col(ts).alias("ts"))
    paired = running_before(kept, order, "_previous", log, F.max)
    elapsed = F.col(ts) - F.coalesce(F.col("_previous.ts"), F.col(ts))
    steps = F.col(step) - F.coalesce(F.col("_previous.step"), F.lit(0))
    timed = paired.filter(F.col(step) > 0).withColumn("_seconds", elapsed / steps)
    rate = F.when(F.col("_seconds") > 0, F.round(1.0 / F.col("_seconds"), 4))
    return unchunked(timed, [run]).select(
        run,
        step,
        F.round("_seconds", 4).alias("step_time_sec"),
        rate.alias("steps_per_sec"),
    )


def compare_runs(
    df: DataFrame, metrics: Sequence[str] | None = None, baseline: str | None = None
) -> DataFrame:
    """Runs side by side from `(run, metric, value)` rows, one column a metric.

    A metric that a run lacks stays NULL, and a value logged more than once
    counts with its maximum. With a baseline run, `<metric>_ratio` is the value
    over the baseline's. Give `metrics` to save the job that lists them.
    """
    named = df.filter(F.col("metric").isNotNull())
    wide = named.groupBy("run").pivot("metric", list(metrics) if metrics else None)
    # Runs all of whose metrics lack a name stay, with NULL everywhere.
    table = df.select("run").distinct().withColumnRenamed("run", "_run")
    wide = wide.agg(F.max("value"))
    table = table.join(wide, F.col("_run").eqNullSafe(F.col("run")), "left").select(
        F.col("_run").alias("run"), *[F.col(f"`{c}`") for c in wide.columns if c != "run"]
    )
    if baseline is None:
        return table
    names = [c for c in table.columns if c != "run"]
    ratio = [(F.col(f"`{c}`") / F.col("_base")[c]).alias(f"{c}_ratio") for c in names]
    values = named.filter(F.col("run") == baseline).groupBy("metric").agg(F.max("value").alias("value"))
    # One row: a map from metric to the baseline's value.
    base = values.agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("_base")
    )
    return table.withColumn("_base", base.scalar()).select(
        "run", *[F.col(f"`{c}`") for c in names], *ratio
    )


def seed_variance(df: DataFrame) -> DataFrame:
    """Mean and spread over seeds of runs named `<config>_seed<n>`."""
    named = df.select(
        F.regexp_extract("run", SEED_PATTERN, 1).alias("config"),
        F.regexp_extract("run", SEED_PATTERN, 2).alias("_seed"),
        "metric",
        "value",
    ).filter(F.col("_seed") != "")
    return named.groupBy("config", "metric").agg(
        F.count("value").alias("n_runs"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("stddev"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def pareto(
    df: DataFrame,
    by: Sequence[str] = (),
    latency: str = "latency",
    quality: str = "rougeL",
    chunks: int = FRONTIER_CHUNKS,
) -> DataFrame:
    """Rows that no other row of the group beats in latency and quality.

    A row whose latency or quality is NULL or NaN is no point and never kept.
    Rows are reduced to the best quality of each latency, and these to the
    frontiers of `FRONTIER_PARTS` parts of each group. Only what is left of a
    group is scanned, in chunks between approximate latency quantiles.
    """
    keys = list(by)
    known = _direction(latency, True).isNotNull() & _direction(quality, True).isNotNull()
    points = df.filter(known).groupBy(*keys, latency).agg(F.max(quality).alias("_top"))
    # What its own part beats is beaten in the group. All rows of a latency are in one part.
    part = F.pmod(F.xxhash64(latency), F.lit(FRONTIER_PARTS))
    faster = W.partitionBy(*keys, part).orderBy(latency).rowsBetween(W.unboundedPreceding, -1)
    local = points.withColumn("_faster", F.max("_top").over(faster))
    points = local.filter(F.col("_faster").isNull() | (F.col("_top") > F.col("_faster"))).drop("_faster")
    cuts = [i / chunks for i in range(1, chunks)]
    bounds = points.groupBy(*keys).agg(
        F.percentile_approx(latency, F.array(*[F.lit(c) for c in cuts]), 10 * chunks).alias(
            "_bounds"
        )
    )
    if keys:
        named = bounds.withColumnsRenamed({k: f"_of_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
        placed = points.join(named, same, "left").drop(*[f"_of_{k}" for k in keys])
    else:
        placed = points.withColumn("_bounds", bounds.scalar())
    position = F.size(F.filter("_bounds", lambda b: b < F.col(latency)))
    rows = chunked(placed, keys, position).drop("_bounds")
    scanned = running_before(rows, [F.col(latency)], "_faster", F.col("_top"), F.max)
    front = scanned.filter(
        F.col("_faster").isNull() | (F.col("_top") > F.col("_faster"))
)
    front = unchunked(front, keys).select(*keys, latency, F.col("_top").alias(quality))
    on = [*keys, latency, quality]
    renamed = front.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]
    return df.join(renamed, same, "left_semi")


def mean_loss(
    df: DataFrame, by: Sequence[str] = ("run", "epoch"), loss: str = "loss"
) -> DataFrame:
    """Mean over batches of the batch loss."""
    return df.groupBy(*by).agg(F.avg(loss).alias("mean_loss"))


def latency_summary(
    df: DataFrame, by: Sequence[str] = ("run",), latency: str = "latency"
) -> DataFrame:
    """Average latency and the number of measurements of each group."""
    return df.groupBy(*by).agg(
        F.avg(latency).alias("avg_latency"), F.count(latency).alias("n_runs")
    )


def latency_sketch(
    df: DataFrame, by: Sequence[str] = ("run",), latency: str = "latency"
) -> DataFrame:
    """`(by, bucket, n)`: how many latencies lie in each bucket, in microseconds.

    Sketches of the same groups are merged by adding the counts of equal
    buckets. Values that are NULL, NaN or beyond 64 bits are no measurements.
    """
    micros = F.expr("try_cast(_seconds * 1000000 AS bigint)")
    known = df.withColumn("_seconds", F.nanvl(F.col(latency).cast("double"), F.lit(None).cast("double")))
    size = F.abs("_micros")
    dropped = F.greatest(F.length(F.bin(size)) - SKETCH_BITS, F.lit(0))
    unit = F.pow(F.lit(2.0), dropped).cast("bigint")
    rows = known.select(*by, micros.alias("_micros")).filter(F.col("_micros").isNotNull())
    bucket = F.signum("_micros").cast("bigint") * (size - size % unit)
    return rows.groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def sketch_quantiles(
    sketch: DataFrame, by: Sequence[str] = ("run",), percents: Sequence[int] = (50, 95)
) -> DataFrame:
    """Per group `n_runs` and `p<percent>`, in seconds.

    A percentile is the smallest bucket that this share of the values does not
    exceed. It is nearer to zero than the value of that rank by less than one
    part in 128, or one microsecond.
    """
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*by)
    ranked = merged.select(
        *by,
        "bucket",
        F.sum("n").over(group.orderBy("bucket")).alias("_upto"),
        F.sum("n").over(group).alias("_all"),
    )
    reached = [
        F.min(F.when(F.col("_upto") * 100 >= F.col("_all") * p, F.col("bucket") / 1_000_000)).alias(f"p{p}")
        for p in percents
    ]
    return ranked.groupBy(*by).agg(F.max("_all").alias("n_runs"), *reached)


def latency_percentiles(
    df: DataFrame,
    by: Sequence[str] = ("run",),
    latency: str = "latency",
    percents: Sequence[int] = (50, 95),
) -> DataFrame:
    """Percentiles of each group's latencies from a sketch; see `sketch_quantiles`."""
    return sketch_quantiles(latency_sketch(df, by, latency), by, percents)
