"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaprep.session import scratch_path

#: Characters that part words; as bytes, `bytes.split()` parts at the same six.
SPACES = r"[\x20\x09-\x0D]"
#: Text bytes that one call of a vectorised function handles; bounds the
#: working memory of a task whatever the number of rows in an Arrow batch.
SLICE_BYTES = 2 << 20


def fold(id_column: str, parts: int) -> Column:
    """The fold of a row: CRC-32 of the id as text, modulo `parts`."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts


def held_out(id_column: str, parts: int, fold_number: int) -> Column:
    """Whether a row is kept from training; a row without id is held out."""
    return F.coalesce(fold(id_column, parts) == fold_number, F.lit(True))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without columns of the given names, whatever their case."""
    lower = {name.lower() for name in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def append_columns(
    df: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., list]],
    second: str | None = None,
) -> DataFrame:
    """df with columns computed from a text column, batch by batch in Python.

    `make()` runs once a task and returns a function from an Arrow array of
    texts to one Arrow array for each field; it gets the column `second` too if
    one is named. Columns of df that have the name of a new column are replaced.
    """
    kept = without(df, [f.name for f in fields])
    lost = [c for c in (text, second) if c and c.lower() in {f.name.lower() for f in fields}]
    if lost:
        raise ValueError(f"{lost} would be read and replaced")
    schema = T.StructType([*kept.schema.fields, *fields])
    names = [f.name for f in schema.fields]
    n_kept = len(kept.columns)
    text_name, second_name = kept.select(text).columns[0], kept.select(second or text).columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            at = batch.schema.get_field_index(text_name)
            other = batch.schema.get_field_index(second_name) if second else -1
            for start, stop in slices(batch.column(at)):
                part = batch.slice(start, stop - start)
                also = [part.column(other)] if other >= 0 else []
                new = compute(part.column(at), *also)
                old = [part.column(i) for i in range(n_kept)]
                yield pa.RecordBatch.from_arrays([*old, *new], names)
        getattr(compute, "close", lambda: None)()  # a worker outlives its task

    return kept.mapInArrow(run, schema)


def text_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; NULL counts as empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def write_table(df: DataFrame, name: str) -> DataFrame:
    """df written below the shared checkpoint folder and read again.

    This cuts the lineage: what follows is planned from the table and survives
    the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component).

    `edges` has two columns of one ordered type; `component` is the smallest
    node reachable. Nodes without an edge to another node are not returned.
    Alternating large and small stars: each round ties nodes to smaller ones,
    and is written as a table. A node with very many neighbours is a hot key of
    plain joins, which adaptive execution splits. NULL ends are ignored.
    """
    a, b = edges.columns
    high, low = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    now = write_table(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(high, low)
        .distinct(),
        "components",
    )
    state = _state(now)
    for _ in range(rounds):
        if state[0] == 0:
            break
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m"))
        large = (
            both.join(least, "hi")
            .where(F.col("lo") > F.col("hi"))
            .select(F.col("lo").alias("hi"), F.least("m", "hi").alias("lo"))
            .distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .where(F.col("lo") != F.col("m"))
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(least.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        now = write_table(small, "components")
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row.n, row.h


def strings(values: Sequence[str]) -> pa.Array:
    return pa.array(values, pa.string())


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int64), pa.int64())
