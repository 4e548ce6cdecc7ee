"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Statistics of a document are standardised and mapped to cosines whose inner
products approximate a Gaussian kernel. The normal equations of the ridge
regression are sums over rows, so each partition sends one matrix of fixed
size. Raw scores of rows that were not fitted are binned, and pooling adjacent
violators over the bins gives a rising map to shares of good documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaprep.llm.common import append_columns, text_bytes, write_table

#: Labelled rows that are fitted at most, chosen by the hash of their id. It
#: bounds the work of fitting; scores are given to every document.
LABELLED_ROWS = 20_000
FEATURES = 320
RIDGE = 1e-4
BINS = 400
#: Tasks of a fit; each sends one matrix to the driver.
FIT_TASKS = 8
SEED = 17

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>",
    "mark": b"!?",
    "point": b".,;:'\"()-",
    "space": b" \t\r\v\f",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}
_MEMBERS = np.array([[b in members for b in range(256)] for members in _CLASSES.values()], float)
STATISTICS = len(_CLASSES) + 13


def statistics(text: bytes) -> list[float]:
    """Numbers that describe a document; its language and length weigh little."""
    size = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = counts[counts > 0] / max(size, 1)
    kinds = Counter(words)
    top = max(kinds.values(), default=0)
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = len(set(zip(words, words[1:])))
    marked = sum(w[-1:] in b"#*$%&!|" for w in kinds.elements()) if n else 0
    lone = sum(c for w, c in kinds.items() if len(w) == 1 and w in b"|#*-")
    return [
        *(_MEMBERS @ counts / max(size, 1)).tolist(),
        np.log1p(n),
        np.log1p(len(lines)),
        n / max(len(lines), 1) / 100 if n < 100 * max(len(lines), 1) else 1.0,
        float(lengths.mean()) if n else 0.0,
        float(lengths.std()) if n else 0.0,
        len(kinds) / max(n, 1),
        len(kinds) / max(n, 1) ** 0.7,
        top / max(n, 1),
        pairs / max(n - 1, 1),
        len(set(lines)) / max(len(lines), 1),
        float(-(shares * np.log2(shares)).sum()),
        marked / max(n, 1),
        lone / max(n, 1),
    ]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `statistics`, an array of double. NULL text counts as empty."""

    def make():
        def compute(texts: pa.Array) -> list:
            return [pa.array([statistics(t) for t in text_bytes(texts)], pa.list_(pa.float64()))]

        return compute

    return append_columns(df, text, [T.StructField("statistics", T.ArrayType(T.DoubleType()))], make)


@dataclass(frozen=True)
class QualityModel:
    """A fitted model; small enough to go with every task."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray  # raw scores, rising
    calibrated: np.ndarray  # scores between 0 and 1 at these

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        cosines = np.cos(z @ self.waves + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([cosines, np.ones((len(x), 1))])

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw_score(x), self.raw, self.calibrated), 0, 1)


def labelled_sample(labels: DataFrame, id_column: str, label: str, limit: int) -> DataFrame:
    """(id, target): ids with a label, at most about `limit`, chosen by hash.

    An id with several labels has their mean as target; NULL labels count for
    nothing.
    """
    per_id = (
        labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("id"))
        .agg(F.avg(F.col(label).cast("double")).alias("target"))
    )
    share = min(1.0, limit / max(1, per_id.count()))
    place = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 20))
    return per_id.where(place < int(share * (1 << 20)))


def _sums(df: DataFrame, function, width: int) -> np.ndarray:
    """The sum of function(statistics, targets), a vector, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), float)
                total += function(x, batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    rows = df.select("statistics", "target").mapInArrow(run, "v array<double>").collect()
    return np.sum([r.v for r in rows], axis=0) if rows else np.zeros(width)


def pooled(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rising means by pooling adjacent violators, one for each bin."""
    blocks: list[list[float]] = []  # sum, count, bins
    for s, c in zip(sums, counts):
        blocks.append([s, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, c2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + c2, blocks[-1][2] + n2]
    return np.repeat([s / c for s, c, _ in blocks], [int(n) for _, _, n in blocks])


def fit(
    documents: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    limit: int = LABELLED_ROWS,
) -> QualityModel:
    """Fit on the labels for which `learn` holds, at most `limit` documents.

    Without any labelled document every score is 0.5.
    """
    sample = write_table(
        labelled_sample(labels.where(learn), id_column, label, limit), "labelled"
    )
    texts = documents.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    # `limit` bounds the sample, so that the texts need not be moved.
    chosen = texts.join(F.broadcast(sample), "id")
    rows = write_table(
        with_statistics(chosen, "text").select(
            "statistics", "target",
            (F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(4)) == 0).alias("calibrates"),
        ).repartition(FIT_TASKS),
        "statistics",
    )
    d = STATISTICS
    moments = _sums(
        rows,
        lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0), [y.sum()]]),
        2 * d + 2,
    )
    n = moments[0]
    random = np.random.default_rng(SEED)
    waves = random.normal(size=(d, FEATURES)) / np.sqrt(d) * 0.8
    phases = random.uniform(0, 2 * np.pi, FEATURES)
    if not n:
        flat = np.array([0.5, 0.5])
        return QualityModel(
            np.zeros(d), np.ones(d), waves, phases, np.zeros(FEATURES + 1), np.array([0.0, 1.0]), flat
        )
    mean = moments[1 : d + 1] / n
    scale = np.sqrt(np.maximum(moments[d + 1 : 2 * d + 1] / n - mean**2, 0)) + 1e-3
    start = QualityModel(mean, scale, waves, phases, np.zeros(FEATURES + 1), mean[:0], mean[:0])
    m = FEATURES + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = start.mapped(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(x)]])

    sums = _sums(rows.where(~F.col("calibrates")), equations, m * m + m + 1)
    fitted = max(1.0, sums[-1])
    gram = sums[: m * m].reshape(m, m) / fitted + RIDGE * np.eye(m)
    weights = np.linalg.solve(gram, sums[m * m : m * m + m] / fitted)
    model = QualityModel(mean, scale, waves, phases, weights, mean[:0], mean[:0])

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bins = np.clip(((model.raw_score(x) + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(bins, y, BINS), np.bincount(bins, minlength=BINS)])

    both = _sums(rows.where("calibrates"), binned, 2 * BINS)
    used = np.flatnonzero(both[BINS:])
    if not len(used):
        used, both = np.array([0]), np.concatenate([np.full(BINS, moments[-1] / n), np.ones(BINS)])
    # Half a good and half a bad row at each end keep scores inside (0, 1).
    good, count = both[used], both[BINS + used]
    level = pooled(good, count)
    level = (level * len(level) + 0.5 * moments[-1] / n) / (len(level) + 0.5)
    centre = (used + 0.5) * 2 / BINS - 0.5
    # A slope far below any calibration step keeps the order of raw scores.
    return QualityModel(
        mean, scale, waves, phases, weights,
        np.concatenate([[-2.0], centre, [3.0]]),
        np.concatenate([[level[0] * 0.5], level, [(1 + level[-1]) / 2]]),
    )


def score(df: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """df with `score` between 0 and 1; NULL texts are scored as empty ones.

    Every row gets a score, repeated rows the same one. A column named score
    is replaced.
    """

    def make():
        def compute(texts: pa.Array) -> list:
            x = np.array([statistics(t) for t in text_bytes(texts)]).reshape(-1, STATISTICS)
            return [pa.array(model.score(x), pa.float64())]

        return compute

    return append_columns(df, text, [T.StructField("score", T.DoubleType())], make)
