"""Vocabulary, encoding and decoding over words of the corpus.

Encoding and decoding look words up inside the row, with a vocabulary whose size
is checked before it goes to the tasks. A larger one is joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from qaprep.functions.stem import flatten
from qaprep.functions.text import word_tokens
from qaprep.operators.running import chunked, number_rows, running_before

PAD, UNKNOWN = "[PAD]", "[UNK]"
SPECIALS = (PAD, UNKNOWN, "[END]")
IGNORED_LABEL = -100
#: Bytes of vocabulary that a task holds; beyond, words are looked up by a join.
TASK_BYTES = 64 << 20
#: Words of a smaller count are numbered by count and first characters.
COMMON = 64


def build_vocab(
    df: DataFrame, col: str, max_size: int = 32_000, specials: Sequence[str] = SPECIALS
) -> DataFrame:
    """`(id, token, n)`: special tokens first, then words by falling count.

    Words of equal count come in alphabetical order. The smallest count that
    still has room follows from the number of words of each count, and only the
    words from there on are numbered, in chunks.
    """
    room = max_size - len(specials)
    if room < 0:
        raise ValueError(f"a vocabulary with {len(specials)} special tokens needs that much room")
    words = df.select(F.explode(word_tokens(F.col(col))).alias("token"))
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    falling, size = [-F.col("n")], -F.floor(F.log2("n") * 8)
    histogram = counts.groupBy("n").agg(F.count(F.lit(1)).alias("_words"))
    above = running_before(
        chunked(histogram, (), size), falling, "_above", F.col("_words"), F.sum
    )
    least = above.filter(F.col("_above") < room).agg(F.min("n")).scalar()
    frequent = counts.filter(F.col("n") >= least)
    # Few words share a large count; a small one is told apart by its words.
    rare = F.col("n") < COMMON
    chunk = F.struct(
        size.alias("size"),
        F.when(rare, -F.col("n")).alias("n"),
        F.when(rare, F.substring("token", 1, 3)).alias("start"),
    )
    order = [*falling, F.col("token")]
    ranked = number_rows(frequent, (), order, chunk, "_rank").filter(F.col("_rank") <= room)
    ranked = ranked.select(
        (F.col("_rank") + len(specials) - 1).cast("int").alias("id"), "token", "n"
    )
    if not specials:
        return ranked
    first = F.array(
        *[
            F.struct(
                F.lit(i).alias("id"),
                F.lit(token).alias("token"),
                F.lit(None).cast("bigint").alias("n"),
            )
            for i, token in enumerate(specials)
        ]
    )
    spark = df.sparkSession
    return spark.range(1).select(F.inline(first)).unionByName(ranked)


def _look_up(
    df: DataFrame, values: Column, table: DataFrame, out: str, task_bytes: int
) -> DataFrame:
    """Add `out`: the second column of `table` for each of `values`, or NULL.

    The first column of `table` must not repeat.
    """
    key, found = table.columns
    size = table.agg(
        F.sum(F.octet_length(F.col(key).cast("string")) + F.octet_length(F.col(found).cast("string")))
    ).first()[0]
    if (size or 0) > task_bytes:
        return _look_up_by_join(df, values, table, out)
    held = table.toArrow().combine_chunks()
    keys, results = (pa.array(held[name].to_pylist(), held.schema.field(name).type) for name in (key, found))

    @F.arrow_udf(ArrayType(table.schema[found].dataType))
    def look(lists: pa.Array) -> pa.Array:
        flat = flatten(lists)
        places = pc.index_in(flat, value_set=keys.cast(flat.type))
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, results.take(places))

    return df.withColumn(out, look(values))


def _look_up_by_join(df: DataFrame, values: Column, table: DataFrame, out: str) -> DataFrame:
    """The same for a table of any size. A row's columns travel with its first value."""
    key, found = table.columns
    columns = [c for c in df.columns if c != out]
    row = F.struct(*df.columns).alias("_kept")
    numbered = df.select(row, values.alias("_values")).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    places = numbered.select("_row", "_kept", F.posexplode_outer("_values").alias("_pos", "_value"))
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    slim = places.withColumn("_kept", F.when(first, F.col("_kept")))
    named = table.select(F.col(key).alias("_value"), F.col(found).alias("_found"))
    entry = F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_found"))
    joined = slim.join(named, "_value", "left").groupBy("_row").agg(
        F.first("_kept", ignorenulls=True).alias("_kept"),
        F.sort_array(F.collect_list(entry)).alias("_entries"),
    )
    ordered = F.transform("_entries", lambda e: e["_found"])
    return joined.select(*[F.col("_kept")[c].alias(c) for c in columns], ordered.alias(out))


def encode(
    df: DataFrame,
    col: str,
    vocab: DataFrame,
    max_len: int | None,
    out: str = "input_ids",
    unknown_id: int = SPECIALS.index(UNKNOWN),
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """Add `out`: word ids of the first `max_len` words of each row, or of all.

    Rows stay where they are. Words outside the vocabulary get `unknown_id`; a
    text without words gets an empty array. The vocabulary is read twice, so
    give one that is written or cached.
    """
    words = word_tokens(F.col(col))
    words = words if max_len is None else F.slice(words, 1, max_len)
    found = _look_up(df, words, vocab.select("token", "id"), out, task_bytes)
    ids = F.transform(out, lambda i: F.coalesce(i, F.lit(unknown_id)))
    return found.withColumn(out, ids)


def encode_pairs(
    df: DataFrame,
    vocab: DataFrame,
    max_input: int,
    max_target: int,
    input_col: str = "input_text",
    target_col: str = "target_text",
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """Add `input_ids` and `attention_mask` of the input and `labels` of the target.

    Each side is cut and padded to its own maximum; padded labels are ignored.
    """
    sides = encode(df, target_col, vocab, max_target, "labels", task_bytes=task_bytes)
    sides = pad(sides, max_target, ids="labels", mask="_label_mask")
    sides = sides.withColumn("labels", mask_labels(F.col("labels"), F.col("_label_mask")))
    sides = encode(sides.drop("_label_mask"), input_col, vocab, max_input, task_bytes=task_bytes)
    return pad(sides, max_input)


def pad(
    df: DataFrame,
    max_len: int | Column,
    pad_id: int = 0,
    ids: str = "input_ids",
    mask: str = "attention_mask",
) -> DataFrame:
    """Fill ids up to `max_len`, which may differ by row, and add the matching mask."""
    size = F.size(ids)
    rest = F.greatest(F.lit(max_len) - size, F.lit(0))
    kept = F.least(size, F.lit(max_len))
    ones = F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), rest))
    filled = F.concat(F.slice(ids, 1, max_len), F.array_repeat(F.lit(pad_id), rest))
    return df.withColumns({ids: filled, mask: ones})


def mask_labels(ids: Column, mask: Column) -> Column:
    """Ids with padded positions set to the ignored label."""
    ignored = F.lit(IGNORED_LABEL)
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 0, ignored).otherwise(i))


def decode(
    df: DataFrame,
    vocab: DataFrame,
    vocab_size: int,
    ids: str = "input_ids",
    specials: Sequence[str] = SPECIALS,
    pad_id: int = 0,
    out: str = "text",
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """Add `out`: words of the ids, without special tokens.

    Ignored labels become padding and ids outside the vocabulary are clipped
    into it. Rows stay where they are, as in `encode`.
    """
    valid = F.transform(
        ids,
        lambda i: F.greatest(
            F.lit(0),
            F.least(
                F.lit(vocab_size - 1), F.when(i == IGNORED_LABEL, pad_id).otherwise(i)
            ),
        ),
    )
    words = vocab.select("id", "token").filter(~F.col("token").isin(list(specials)))
    found = _look_up(df, valid, words, out, task_bytes)
    return found.withColumn(out, F.array_join(out, " "))


def argmax(values: Column) -> Column:
    """Index of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def validate_encoded(df: DataFrame, max_len: int | Column, pad_id: int = 0) -> DataFrame:
    """Count rows whose lengths, mask or label mask are wrong.

    Reads `input_ids`, `attention_mask`, `labels` and, for the label padding,
    `label_mask` if the table has it, else `attention_mask`.
    """
    lengths = [F.size(c) != max_len for c in ("input_ids", "attention_mask", "labels")]
    label_mask = "label_mask" if "label_mask" in df.columns else "attention_mask"
    mask_wrong = F.exists(
        F.arrays_zip("input_ids", "attention_mask"),
        lambda e: (e["input_ids"] == pad_id) & (e["attention_mask"] != 0),
    )
    label_wrong = F.exists(
        F.arrays_zip(F.col("labels"), F.col(label_mask).alias("mask")),
        lambda e: (e["mask"] == 0) != (e["labels"] == IGNORED_LABEL),
    )
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(lengths[0] | lengths[1] | lengths[2]).alias("bad_length"),
        F.count_if(mask_wrong).alias("bad_mask"),
        F.count_if(label_wrong).alias("bad_labels"),
    )
