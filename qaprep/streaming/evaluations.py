"""Early stops of runs while their evaluations arrive.

Each run keeps a few numbers as keyed state, so the work of a micro-batch
depends on its own rows and not on the history of the run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVAL_SCHEMA = "run string, step long, metric double"
STATE = (
    "last_step long, n_evals long, n_late long, stop_step long, "
    "best double, best_step long, best_at long"
)
STATUS = (
    "run string, stop_step long, n_evals long, best_metric double, best_step long, n_late long"
)


def early_stop_status(evals: DataFrame, patience: int, greater: bool = True) -> DataFrame:
    """Per micro-batch, the status of every run with new rows of `EVAL_SCHEMA`.

    The columns are those of `runs.early_stop`, and `n_late`. Rows of a
    micro-batch are taken in the order of that job: by step, and by a hash of
    their content within a step. A step that does not lie after all steps of
    earlier micro-batches is late: it is counted and changes nothing else. So
    without late rows the last status equals the batch job's result. Rows with
    NULL as metric or step are none, NaN never improves, and after its stop a
    run ignores what comes. The rows of a run in one micro-batch are held in
    memory; the trigger bounds them.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, late, stop, best, best_step, best_at = state.get if state.exists else (None, 0, 0, None, None, None, 0)
        rows = pd.concat(list(frames)).sort_values(["step", "_tie"])
        seen = last
        for step, metric in zip(rows["step"].tolist(), rows["metric"].tolist()):
            if seen is not None and step <= seen:
                late += 1
                continue
            last = step
            if stop is not None:
                continue
            score = None if math.isnan(metric) else metric if greater else -metric
            if n == 0 or (score is not None and (best is None or score > best)):
                best, best_step, best_at = score, step, n
            elif n - best_at >= patience:
                stop = step
            n += 1
        state.update((last, n, late, stop, best, best_step, best_at))
        shown = best if best is None or greater else -best
        yield pd.DataFrame(
            {
                "run": [key[0]],
                "stop_step": pd.array([stop], "Int64"),
                "n_evals": [n],
                "best_metric": pd.array([shown], "Float64"),
                "best_step": pd.array([best_step], "Int64"),
                "n_late": [late],
            }
        )

    known = evals.select("run", "step", "metric").dropna(subset=["step"])
    known = known.where(F.col("metric").isNotNull())
    hashed = known.withColumn("_tie", F.xxhash64("run", "step", "metric"))
    return hashed.groupBy("run").applyInPandasWithState(
        update, STATUS, STATE, "append", GroupStateTimeout.NoTimeout
    )


def early_stop_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    patience: int,
    greater: bool = True,
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Append the status of runs to a Parquet table for every batch of JSON files."""
    evals = (
        spark.readStream.schema(EVAL_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("allowNonNumericNumbers", True)
        .json(source)
    )
    return (
        early_stop_status(evals, patience, greater)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )


def latest_status(status: DataFrame) -> DataFrame:
    """One row for each run: the status after its last rows.

    Both counts only grow, and a status in which neither grew says the same.
    """
    names = [c for c in status.columns if c != "run"]
    grown = F.struct(F.col("n_evals") + F.col("n_late"), F.col("n_evals"))
    last = status.groupBy("run").agg(F.max_by(F.struct(*names), grown).alias("s"))
    return last.select("run", "s.*")
