"""Running aggregates that survive a hot key.

A plain window gives every row of a key to one task, so one run that holds a
third of all rows would stall the job. Here the rows of a key are cut into
chunks along the order. Each chunk is a window partition of its own, and what
came before it is carried over from a table with one row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qaprep.session import scratch_path

KEY, CHUNK, TIE = "_key", "_chunk", "_tie"
ROWS_PER_CHUNK = 100_000
#: Borders of chunks that go to every task; more are joined by shuffle.
SENT_BORDERS = 100_000


def content(df: DataFrame) -> Column:
    """A hash of the whole row; maps cannot be hashed and are left out."""
    return F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def balanced(df: DataFrame, keys: Sequence[str], step: str, rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """Put the keys into one column and cut the rows of each key into even chunks.

    Rows are ordered by step and, within a step, by a hash of their content
    (`ordered_by`), so that only equal rows have no order and it does not matter.
    A key with more than `rows` rows is cut into ranges of steps as wide as its
    rows are dense. A range that still has more than twice as many is cut again
    within its own steps, and a single step by the hash. So neither few steps
    with very many rows nor wide gaps between steps make a chunk large; only
    equal rows stay together. Each cut is a count of rows by chunk, added up
    before the shuffle; keys with few rows need one such count and nothing else.
    NULL steps come first.
    """
    rowed = df.withColumns({TIE: content(df), CHUNK: F.array().cast("array<bigint>")})
    placed = chunked(rowed, keys, F.col(CHUNK)).withColumn("_cut", F.lit(False))
    most = rows
    while True:
        sizes = (
            placed.where("not _cut")
            .groupBy(KEY, CHUNK)
            .agg(F.count("*").alias("_n"), F.min(step).alias("_low"), F.max(step).alias("_high"))
            .where(F.col("_n") > most)
        )
        path = scratch_path(df.sparkSession, "chunks")
        sizes.write.parquet(path)
        large = df.sparkSession.read.schema(sizes.schema).parquet(path)
        count = large.count()
        if not count:
            return placed.drop("_cut")
        several = F.coalesce(F.col("_high") - F.col("_low") >= 1, F.lit(False))
        one = F.col("_high").eqNullSafe(F.col("_low"))
        parts = F.col("_n") / rows
        width = F.greatest(F.lit(1.0), F.ceil((F.col("_high") - F.col("_low") + 1) / parts))
        share = (F.col(TIE).cast("double") + 2.0**63) / 2.0**64
        cell = F.when(several, F.floor((F.col(step) - F.col("_low")) / width))
        cell = cell.when(one, F.floor(share * F.ceil(parts))).otherwise(F.lit(0))
        cell = F.coalesce(cell, F.lit(-1)).cast("bigint")
        side = F.broadcast(large) if count <= SENT_BORDERS else large
        was_cut = F.coalesce(F.col("_cut") | (F.col("_n").isNotNull() & ~several), F.lit(False))
        placed = (
            placed.join(side, [KEY, CHUNK], "left")
            .withColumns({"_next": F.when(F.col("_n").isNull(), F.col(CHUNK)).otherwise(F.concat(CHUNK, F.array(cell)))})
            .withColumns({"_cut": was_cut, CHUNK: F.col("_next")})
            .drop("_n", "_low", "_high", "_next")
        )
        most = 2 * rows


def ordered_by(step: str) -> list[Column]:
    """The order of the rows that `balanced` cuts."""
    return [F.col(step), F.col(TIE)]


def chunked(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Put the keys into one column and add the chunk to distribute rows by.

    `chunk` must not decrease along the order. The keys become a struct, which
    is never NULL, so rows without a key stay together too. They are not kept
    twice: then the scan and its carry can read one and the same shuffle.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    return df.withColumns({KEY: key, CHUNK: chunk}).drop(*keys)


def unchunked(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring the keys back and drop what `chunked` added."""
    rest = [c for c in df.columns if c not in (KEY, CHUNK, TIE)]
    return df.select(*[F.col(KEY)[k].alias(k) for k in keys], *rest)


def running_before(
    df: DataFrame,
    order: Sequence[Column],
    out: str,
    value: Column,
    how: Callable[[Column], Column],
    reverse: bool = False,
) -> DataFrame:
    """Add `how(value)` over the rows of the same key before each row.

    `df` comes from `chunked` or `balanced`; several calls in a row share its distribution.
    `how` is `F.max`, `F.min` or `F.sum`. With `reverse` the rows after each
    row count instead.
    """
    unbounded, previous = W.unboundedPreceding, -1
    ordered = [c.desc() for c in order] if reverse else list(order)
    valued = df.withColumn("_value", value)
    inside = W.partitionBy(KEY, CHUNK).orderBy(*ordered)
    rows = valued.withColumn(
        "_local", how("_value").over(inside.rowsBetween(unbounded, previous))
    )
    chunk_order = F.col(CHUNK).desc() if reverse else F.col(CHUNK)
    across = W.partitionBy(KEY).orderBy(chunk_order).rowsBetween(unbounded, previous)
    carried = (
        valued.groupBy(KEY, CHUNK)
        .agg(how("_value").alias("_total"))
        .select(KEY, CHUNK, how("_total").over(across).alias("_carried"))
    )
    local, before = F.col("_local"), F.col("_carried")
    if how is F.sum:
        zero = F.lit(0)
        merged = F.coalesce(local, zero) + F.coalesce(before, zero)
    else:
        merged = F.greatest(local, before) if how is F.max else F.least(local, before)
    joined = rows.join(carried, [KEY, CHUNK], "left")
    return joined.select(*df.columns, merged.alias(out))


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, out: str
) -> DataFrame:
    """Number the rows of each key from 1 along the order."""
    one = F.lit(1).cast("bigint")
    before = running_before(chunked(df, keys, chunk), order, out, one, F.sum)
    return unchunked(before, keys).withColumn(out, F.col(out) + 1)
