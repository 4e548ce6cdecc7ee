"""Near duplicates by SimHash and multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in at most d
bits differ in at most d // segments bits in one segment at least. Each
fingerprint is stored in a table per segment; a query enumerates the small
Hamming ball around its own segment value, fetches what the tables hold there,
and verifies the distance over all bits.

Equal fingerprints are one entry, so that copies cost nothing. A link between
two entries is needed once: of two segment values that differ, only the smaller
one looks for the other. Long segments make small buckets and large balls; how
long they are follows from the number of fingerprints and what both would cost. What is fetched together is
linked inside the task, and only a spanning forest leaves it, so the output
grows with the entries and not with the pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaprep.llm.common import append_columns, components, text_bytes, write_table

BITS = 64
#: Entries of one table bucket that one task compares with each other. Larger
#: buckets are cut into blocks; each pair of blocks is a unit of its own.
BLOCK = 2_048
#: Comparisons that cost as much as moving one table entry to its bucket.
COMPARED = 500
#: Shingles whose bits are counted at once.
COUNTED = 1 << 18


def _lanes() -> np.ndarray:
    """For each byte, its bits as eight 8-bit counters in one word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


LANES = _lanes()


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    total = np.zeros(BITS, np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for start in range(0, len(octets), COUNTED):
        part = octets[start : start + COUNTED]
        runs = np.arange(0, len(part), 255)  # a counter holds 255 at most
        for k in range(8):
            sums = np.add.reduceat(LANES[part[:, k]], runs)
            total[8 * k : 8 * k + 8] += sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return total


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the shingles of a text; 0 without words."""
    words = text.lower().split()  # of bytes: changes and parts by ASCII only
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *(ends[:-shingle]).tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        grams = [joined[s:e] for s, e in zip(starts, stops)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, 42) for g in grams], "<u8")
    bits = bit_counts(hashes) * 2 > len(grams)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def with_fingerprint(df: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """df with `simhash`, the 64 bits as a signed long. NULL text has no words."""

    def make():
        def compute(texts: pa.Array) -> list:
            found = np.array([fingerprint(t, shingle) for t in text_bytes(texts)], np.uint64)
            return [pa.array(found.view(np.int64), pa.int64())]

        return compute

    return append_columns(df, text, [T.StructField("simhash", T.LongType())], make)


def segments(distance: int, radius: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment: the fewest for balls of `radius`."""
    count = max(2, distance // (radius + 1) + 1)
    edges = [BITS * i // count for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in itertools.pairwise(edges)]


def ball_radius(distance: int, entries: int) -> int:
    """The radius, 1 or 2, with which finding all links costs less.

    Either finds all of them. With radius 1 each bucket grows sooner, with
    radius 2 each entry asks for hundreds of buckets; for the distance 4 the
    second is cheaper from about 10^10 fingerprints.
    """

    def cost(radius: int) -> float:
        parts = segments(distance, radius)
        balls = [sum(math.comb(width, k) for k in range(radius + 1)) for _, width in parts]
        return sum(b * (1 + entries / 2**width / COMPARED) for b, (_, width) in zip(balls, parts))

    return min((1, 2), key=cost)


def _bucket_rows(prints: DataFrame, distance: int, radius: int) -> DataFrame:
    """(bucket, stored, simhash): table entries, and queries for other buckets."""
    def of_segment(number: int, low: int, width: int):
        value = F.shiftrightunsigned("simhash", low).bitwiseAND(F.lit((1 << width) - 1))
        tag = F.lit(number << 58)

        def row(bits, stored: bool):
            return F.struct(bits.bitwiseOR(tag).alias("bucket"), F.lit(stored).alias("stored"))

        flips = [
            sum(1 << bit for bit in bits)
            for k in range(1, radius + 1)
            for bits in itertools.combinations(range(width), k)
        ]
        masks = F.lit(flips).cast("array<long>")
        larger = F.filter(masks, lambda mask: value.bitwiseXOR(mask) > value)
        return [F.array(row(value, True)), F.transform(larger, lambda mask: row(value.bitwiseXOR(mask), False))]

    rows = [x for n, (low, width) in enumerate(segments(distance, radius)) for x in of_segment(n, low, width)]
    return prints.select("simhash", F.inline(F.concat(*rows)))


def _forest(entries: np.ndarray, stored: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the entries of one unit: a spanning forest of them.

    Entries are taken in turn. Only entries that are not yet in the turn's
    tree are compared with what was reached last, in numpy.
    """
    n = len(entries)
    tree = np.full(n, -1)
    for i in range(n):
        if tree[i] >= 0:
            continue
        tree[i] = i
        reached = [i]
        while reached:
            j = reached.pop()
            rest = np.flatnonzero(tree < 0)
            if not len(rest):
                break
            near = np.bitwise_count(entries[rest] ^ entries[j]) <= distance
            if not stored[j]:
                near &= stored[rest]
            found = rest[near]
            tree[found] = i
            reached.extend(found.tolist())
    other = np.flatnonzero(tree != np.arange(n))
    return entries[other], entries[tree[other]]


def _small_runs(keys, entries, stored, starts, sizes, distance):
    """Links in runs of a few entries, all runs at once, by the distance of places."""
    limit = int(sizes.max(initial=0))
    ends = np.repeat(starts + sizes, sizes)
    at = np.arange(len(keys))
    for lag in range(1, limit):
        left = at[at + lag < ends[at]]
        if not len(left):
            break
        at = left
        near = np.bitwise_count(entries[left] ^ entries[left + lag]) <= distance
        near &= stored[left] | stored[left + lag]
        yield entries[left[near] + lag], entries[left[near]]


FEW = 24


def links(prints: DataFrame, distance: int = 4, radius: int = 1) -> DataFrame:
    """(a, b): links that connect the fingerprints within `distance` of each other.

    Not every pair is returned: within what one task compares, a chain of
    verified pairs stands for all pairs it connects. Connected components are
    those of all pairs.
    """
    rows = _bucket_rows(prints, distance, radius)
    sizes = rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.max("stored").alias("used")
    )
    large = sizes.where((F.col("n") > BLOCK) & F.col("used")).select(
        "bucket", F.ceil(F.col("n") / BLOCK).alias("blocks")
    )
    large = write_table(large, "buckets")
    # Every entry of a large bucket meets every block of it; few buckets are
    # large, so their list is joined without moving the other rows.
    cut = rows.join(F.broadcast(large), "bucket") if large.count() <= 100_000 else rows.join(large, "bucket")
    own = F.pmod(F.xxhash64("simhash"), F.col("blocks"))
    units = cut.select(
        "bucket", "stored", "simhash", own.alias("own"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"),
    ).select(
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        "stored", "simhash",
    )
    plain = rows.join(F.broadcast(large), "bucket", "left_anti") if large.count() <= 100_000 else rows.join(large, "bucket", "left_anti")
    plain = plain.select(F.xxhash64("bucket").alias("unit"), "stored", "simhash")
    together = plain.unionByName(units).repartition("unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, entries, stored in _whole_runs(batches):
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            used = np.logical_or.reduceat(stored, starts) & (sizes > 1)
            few = used & (sizes <= FEW)
            found = []
            if few.any():
                keep = np.repeat(few, sizes)
                own = sizes[few]
                found += _small_runs(
                    keys[keep], entries[keep], stored[keep], np.cumsum(own) - own, own, distance
                )
            for i in np.flatnonzero(used & ~few).tolist():
                s = slice(starts[i], starts[i] + sizes[i])
                found.append(_forest(entries[s], stored[s], distance))
            a = np.concatenate([x for x, _ in found] or [np.array([], np.uint64)])
            b = np.concatenate([y for _, y in found] or [np.array([], np.uint64)])
            differ = a != b
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[differ].view(np.int64)), pa.array(b[differ].view(np.int64))], ["a", "b"]
            )

    return together.mapInArrow(run, "a long, b long").distinct()


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Sorted rows as arrays, cut only where the unit changes."""
    rest: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = (
            batch.column(0).to_numpy(),
            batch.column(2).to_numpy().view(np.uint64),
            batch.column(1).to_numpy(zero_copy_only=False).astype(bool),
        )
        if rest is not None:
            now = tuple(np.concatenate(x) for x in zip(rest, now))
        last = np.searchsorted(now[0], now[0][-1])
        rest = tuple(x[last:] for x in now)
        if last:
            yield tuple(x[:last] for x in now)
    if rest is not None and len(rest[0]):
        yield rest


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4
) -> DataFrame:
    """(id, simhash, component_id): one row for each row of df.

    `component_id` is the smallest id reachable over links of `distance`
    differing bits at most. Rows without words have fingerprint 0 and are
    linked like any other; repeated rows are linked by their equal
    fingerprints. A row without id takes part in links but is never a
    component's id; a component of such rows only has a NULL id. Other columns
    are not read.
    """
    rows = with_fingerprint(
        df.select(F.col(id_column).alias("id"), F.col(text).alias("text")), "text", shingle
    )
    rows = write_table(rows.select("id", "simhash"), "fingerprints")
    found = grouped(rows, distance)
    return found.select(F.col("id").alias(id_column), "simhash", "component_id")


def grouped(rows: DataFrame, distance: int = 4) -> DataFrame:
    """(id, simhash, component_id, component) of rows (id, simhash) of a table.

    As `near_duplicates`, from fingerprints that were written. `component` is a
    fingerprint that stands for the component; unlike the id it is never shared
    by two components and never NULL.
    """
    prints = rows.groupBy("simhash").agg(F.min("id").alias("least"))
    radius = ball_radius(distance, rows.count())
    groups = components(links(prints.select("simhash"), distance, radius))
    named = prints.join(groups, prints.simhash == groups.node, "left").select(
        "simhash", "least", F.coalesce("component", "simhash").alias("component")
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "component").select("simhash", "component_id", "component")
    return rows.join(labels, "simhash").select("id", "simhash", "component_id", "component")
