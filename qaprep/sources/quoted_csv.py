"""CSV with line breaks inside quotes, read by many tasks.

A line break ends a record where an even number of quotes stands before it. Each
part of a file counts its quotes; sums over the earlier parts, in a table with
one row per part, tell whether a part starts inside quotes. With that a part
cuts its own lines into records. What a border of parts cuts through is put
together by itself, so that no other text moves.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from qaprep.session import scratch_path

#: Tables of at most this many parts go to every task.
BROADCAST_PARTS = 200_000
WHOLE, HEAD, TAIL = 0, 1, 2
RECORDS = "file string, start long, kind int, record string"
NO_PART = "a file was read in other parts than its quotes were counted in"


def read_quoted_csv(
    spark: SparkSession,
    path: str | list[str],
    header: Sequence[str],
    schema: StructType,
    options: dict[str, object],
    broadcast_parts: int = BROADCAST_PARTS,
) -> DataFrame:
    """Rows of CSV files that all start with this header.

    Quotes must be balanced, as in RFC 4180: doubled inside quoted fields, and
    nowhere else but around them. A file with another header fails. Empty lines
    are no records. Quotes are counted when this is called.
    """
    source = {k: v for k, v in options.items() if k in ("pathGlobFilter", "recursiveFileLookup")}
    lines = spark.read.options(**source).option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("line"),
    )
    parts = _parts(lines)
    placed = _with_parts(lines, parts, parts.count() <= broadcast_parts)
    cut = placed.select("file", "start", "inside", "line")
    whole = cut.mapInArrow(_cutter(list(header), True), RECORDS).select("record")
    pieces = cut.mapInArrow(_cutter(list(header), False), RECORDS)
    # A line break may be two characters; the first one belongs to no field.
    ended = F.regexp_replace("record", r"\r\z", "").alias("record")
    records = whole.unionByName(_mended(pieces)).select(ended).where(F.col("record") != "")
    parser = {"quote": '"', "escape": '"', "multiLine": "true"}
    return records.select(F.from_csv("record", _ddl(schema), parser).alias("r")).select("r.*")


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _parts(lines: DataFrame) -> DataFrame:
    """(file, start, inside): whether each part of a file starts inside quotes."""
    counts = lines.groupBy("file", "start").agg(F.sum(_quotes(F.col("line"))).alias("n"))
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    # Written, so that neither the count of parts nor their use reads the files again.
    found = counts.select("file", "start", (before % 2 == 1).alias("inside"))
    kept = scratch_path(lines.sparkSession, "parts")
    found.write.parquet(kept)
    return lines.sparkSession.read.parquet(kept)


def _with_parts(lines: DataFrame, parts: DataFrame, small: bool) -> DataFrame:
    """Lines with `inside` of their part, in the order of the file."""
    if small:  # rows stay where and in the order they are
        joined = lines.join(F.broadcast(parts), ["file", "start"], "left")
    else:
        joined = lines.join(parts, ["file", "start"], "left").repartition("file", "start")
        joined = joined.sortWithinPartitions("file", "start", "place")
    known = F.when(F.col("inside").isNull(), F.raise_error(F.lit(NO_PART)).cast("boolean"))
    return joined.withColumn("inside", known.otherwise(F.col("inside")))


def _cutter(header: list[str], whole: bool):
    """A function over Arrow batches that cuts lines into records.

    It gives either the whole records or the pieces at the borders of parts; of
    a part that lies inside one record the only piece is a head.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pending, inside, kind, at_header = None, [], False, WHOLE, False
        rows: list[tuple] = []

        def put(kind: int) -> None:
            if at_header:
                raise ValueError(f"the header of {part[0]} does not end in the first part of the file")
            if whole == (kind == WHOLE):
                rows.append((*part, kind, "\n".join(pending)))

        for batch in batches:
            files, starts, firsts, lines = (batch.column(i) for i in range(4))
            odd = np.asarray(pc.count_substring(lines, '"')) % 2 == 1
            keys = zip(files.to_pylist(), starts.to_pylist())
            for key, first, line, flips in zip(keys, firsts.to_pylist(), lines.to_pylist(), odd.tolist()):
                if key != part:
                    if pending:
                        put(kind if kind == HEAD else TAIL)
                    part, pending, inside = key, [], first
                    kind = HEAD if first else WHOLE
                    at_header = key[1] == 0
                pending.append(line)
                inside ^= flips
                if inside:
                    continue
                if at_header:
                    at_header = False
                    names = next(csv.reader(["\n".join(pending).removeprefix("﻿").rstrip("\r")], strict=True), [])
                    if names != header:
                        raise ValueError(f"the header of {key[0]} is {names}, not {header}")
                else:
                    put(kind)
                pending, kind = [], WHOLE
            yield _batch(rows)
            rows.clear()
        if pending:
            put(kind if kind == HEAD else TAIL)
        yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int32(), pa.string())
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(columns, ["file", "start", "kind", "record"])


def _mended(pieces: DataFrame) -> DataFrame:
    """Records put together from a tail and the heads that follow it."""
    order = W.partitionBy("file").orderBy("start", "kind")
    tails = F.sum((F.col("kind") == TAIL).cast("int")).over(order)
    piece = F.struct("start", "kind", "record")
    grouped = pieces.withColumn("of", tails).groupBy("file", "of").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return grouped.select(F.array_join(F.col("p.record"), "\n").alias("record"))
