"""Reproducible splits and samples.

Rows are ordered by the MD5 of seed and key, never by position, so a split does
not depend on files, partitions or engine. Exact sizes come from a count per
hash bucket: the rank of a row is settled by its bucket except in the one
bucket where a cut falls. Only that bucket's rows are sorted; a large one, as a
frequent key makes, is first cut again by more digits of the hash, then by the
rows' content.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qaprep.session import scratch_path

SPLITS = ("train", "validation", "test")
SPLIT_MODES = ("hash", "exact", "floor")
HASHES = 1 << 32
#: A bucket of at most this many rows is sorted by one task.
SORTED_ROWS = 1_000_000
#: Tables of at most this many groups go to every task.
BROADCAST_ROWS = 100_000
#: How often rows of a larger table are repeated for a join.
SALTS = 32


def hash_hex(df: DataFrame, key: str, seed: int) -> Column:
    """MD5 of `seed:key` as hexadecimal text.

    A row without key is named by its content, so such rows spread too.
    """
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row "), _content(df)))
    return F.md5(F.concat(F.lit(f"{seed}:"), name))


def _content(df: DataFrame) -> Column:
    """A hash of the whole row as text; maps cannot be hashed and are left out."""
    names = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*names).cast("string")


def hash_number(hashed: Column) -> Column:
    """The first 32 bits of a hash."""
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint")


def _check_fractions(fractions: Sequence[float]) -> None:
    total = sum(fractions)
    if abs(total - 1) > 1e-6 or min(fractions) < 0:
        raise ValueError(f"shares of a split must not be negative and sum to 1, not {total}")


def split_dataset(
    df: DataFrame,
    key: str,
    seed: int = 42,
    train: float = 0.8,
    validation: float = 0.1,
    test: float = 0.1,
    mode: str = "hash",
) -> DataFrame:
    """Add a `split` column.

    `hash` decides each row by itself: no shuffle, sizes about right, and
    shares that differ a little move few rows. `exact`
    takes the ceiling of the test share in two stages; `floor` rounds the train
    and validation sizes down. Rows of one key are ordered by their content; a
    NULL key is no key, and the row's content decides instead.
    """
    _check_fractions((train, validation, test))
    if mode not in SPLIT_MODES:
        raise ValueError(f"Unknown split mode: {mode}")
    if mode == "hash":
        number = hash_number(hash_hex(df, key, seed))
        first, second = (round(share * HASHES) for share in (train, train + validation))
        name = F.when(number < first, SPLITS[0]).when(number < second, SPLITS[1])
        return df.withColumn("split", name.otherwise(SPLITS[2]))

    rows = F.col("_rows")
    if mode == "exact":
        held_out = F.ceil(F.round(rows * (validation + test), 6))
        test_share = test / (validation + test) if validation + test else 0.0
        cut1 = rows - held_out
        cut2 = rows - F.ceil(F.round(held_out * test_share, 6))
    else:
        cut1 = F.floor(rows * train)
        cut2 = cut1 + F.floor(rows * validation)
    ranked = _with_rank_flags(df, (), key, seed, {"_train": cut1, "_seen": cut2})
    name = F.when(F.col("_train"), SPLITS[0]).when(F.col("_seen"), SPLITS[1])
    return ranked.withColumn("split", name.otherwise(SPLITS[2])).drop("_train", "_seen")


def _with_rank_flags(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    seed: int,
    cuts: Mapping[str, Column],
    sorted_rows: int = SORTED_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Flag the rows whose rank in hash order, by group, is within each cut.

    A cut is a number of rows, as a column over the group's size `_rows`. The
    bucket of a cut is cut again by finer digits of the order while it has more
    than `sorted_rows` rows, so a key that a third of all rows share is not
    sorted by one task. The buckets of the cuts are counted when this is called.
    """
    by = list(by)
    # Only rows that are equal in all columns are told apart by their place, and
    # it does not matter which of them is taken.
    hashed = df.withColumns(
        {
            "_hash": hash_hex(df, key, seed),
            "_tie": F.struct(_content(df).alias("c"), F.monotonically_increasing_id().alias("i")),
        }
    )
    digits = _digits()
    edge, groups, largest = _sized(_first_edge(hashed, by, digits[0], cuts), "edge")
    # Of the rows only what decides their rank goes through the first passes.
    slim = hashed.select(*by, "_hash", "_tie")
    near = _at_edge(slim, edge, by, digits[0], groups <= broadcast_rows)
    for digit in digits[1:]:
        if largest <= sorted_rows:
            break
        near = _kept(near, "near")
        edge, groups, largest = _sized(_next_edge(near, by, digit), "edge")
        rows = near.drop("_left")
        near = _at_edge(rows, edge, [*by, "_flag"], digit, groups <= broadcast_rows)
    place = F.row_number().over(W.partitionBy("_flag", *by).orderBy("_hash", "_tie"))
    row = F.struct(F.col("_hash").alias("h"), F.col("_tie").alias("t"))
    last = near.withColumn("_place", place).filter(F.col("_place") == F.col("_left"))
    limits = last.groupBy(*by).agg(*[F.max(F.when(F.col("_flag") == f, row)).alias(f) for f in cuts])
    if by:
        limited = _with_group(hashed, limits, by, groups <= broadcast_rows)
    else:
        limit = limits.select(F.struct(*cuts)).scalar()
        limited = hashed.withColumn("_limit", limit).select("*", "_limit.*").drop("_limit")
    flags = {f: F.coalesce(row <= F.col(f), F.lit(False)) for f in cuts}
    return limited.withColumns(flags).drop("_hash", "_tie")


def _digits() -> list[Column]:
    """Buckets from coarse to fine; each follows the order of hash and tie.

    The last one is the part of the table that a row stands in, which only rows
    that are equal in all columns need.
    """
    content = F.col("_tie.c")
    return [
        F.substring("_hash", 1, 4),
        F.col("_hash"),
        F.substring(content, 1, 5),
        content,
        F.shiftright("_tie.i", 33),
    ]


def _first_edge(hashed: DataFrame, by: list[str], digit: Column, cuts: Mapping[str, Column]) -> DataFrame:
    """(by, _flag, _digit, _left, _size): the bucket in which each cut falls, how
    many of its rows the cut takes and how many it has."""
    # At most 16^4 buckets a group, counted before the shuffle.
    sizes = hashed.groupBy(*by, digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_size"))
    group = W.partitionBy(*by)
    upto = group.orderBy("_digit").rowsBetween(W.unboundedPreceding, W.currentRow)
    cumulated = sizes.withColumns(
        {"_upto": F.sum("_size").over(upto), "_rows": F.sum("_size").over(group)}
    )
    edges = F.array(*[F.struct(F.lit(f).alias("_flag"), c.cast("bigint").alias("_cut")) for f, c in cuts.items()])
    listed = cumulated.select(*by, "_digit", "_size", "_upto", F.inline(edges))
    return _holding(listed, by)


def _next_edge(near: DataFrame, by: list[str], digit: Column) -> DataFrame:
    """As `_first_edge`, for the rows of the buckets found before."""
    sizes = near.groupBy(*by, "_flag", "_left", digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_size"))
    upto = W.partitionBy(*by, "_flag").orderBy("_digit").rowsBetween(W.unboundedPreceding, W.currentRow)
    return _holding(sizes.withColumnRenamed("_left", "_cut").withColumn("_upto", F.sum("_size").over(upto)), by)


def _holding(listed: DataFrame, by: list[str]) -> DataFrame:
    before = F.col("_upto") - F.col("_size")
    holds = (before < F.col("_cut")) & (F.col("_cut") <= F.col("_upto"))
    return listed.filter(holds).select(*by, "_flag", "_digit", (F.col("_cut") - before).alias("_left"), "_size")


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _sized(edge: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """The written table, its number of rows and the size of its largest bucket."""
    kept = _kept(edge, name)
    n, largest = kept.agg(F.count(F.lit(1)), F.max("_size")).first()
    return kept.drop("_size"), n, largest or 0


def _at_edge(rows: DataFrame, edge: DataFrame, on: list[str], digit: Column, small: bool) -> DataFrame:
    """Rows that lie in a bucket of the edge, with its `_flag` and `_left`."""
    named = rows.withColumn("_digit", digit)
    return _with_group(named, edge, [*on, "_digit"], small, "inner").drop("_digit")


def _with_group(rows: DataFrame, table: DataFrame, on: list[str], small: bool, how: str = "left") -> DataFrame:
    """rows with the columns of a table that has few rows for each group.

    A table that is not small is joined by a shuffle; its rows are repeated so
    that a large group spreads.
    """
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]
    named = table.withColumnsRenamed({c: f"_of_{c}" for c in on})
    if small:
        joined = rows.join(F.broadcast(named), same, how)
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_of_salt")
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_hash", "_tie"), F.lit(SALTS)))
        repeated = named.select("*", salts)
        joined = salted.join(repeated, [*same, F.col("_salt") == F.col("_of_salt")], how).drop("_salt", "_of_salt")
    return joined.drop(*[f"_of_{c}" for c in on])


def cap_per_group(
    df: DataFrame, by: Sequence[str] | str, limit: int, key: str, seed: int = 42
) -> DataFrame:
    """Keep `limit` rows of each larger group, chosen by hash; all of the others."""
    groups = [by] if isinstance(by, str) else list(by)
    cut = F.least(F.col("_rows"), F.lit(limit))
    flagged = _with_rank_flags(df, groups, key, seed, {"_kept": cut})
    return flagged.filter("_kept").drop("_kept")


def sample_n(df: DataFrame, n: int, key: str, seed: int = 13) -> DataFrame:
    """Exactly `n` rows (all if there are fewer) without replacement.

    Rows are taken up to the hash of the last one, whatever `n` is, so that no
    task or driver has to hold the sample.
    """
    cut = F.least(F.col("_rows"), F.lit(n))
    flagged = _with_rank_flags(df, (), key, seed, {"_kept": cut})
    return flagged.filter("_kept").drop("_kept")


def sample_for_review(df: DataFrame, n: int = 50, key: str = "row_id", seed: int = 13) -> DataFrame:
    """A review sample with empty columns for the reviewer."""
    blank = F.lit("")
    return sample_n(df, n, key, seed).withColumns({"quality_label": blank, "notes": blank})
