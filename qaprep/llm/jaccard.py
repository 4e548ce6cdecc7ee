"""Similarity join of documents by the Jaccard index of their word n-grams.

Two sets that link differ in few members, and how many is known from their
sizes. So the n-grams are dealt to one part more than that by their hashes, and
some part of both sets is equal: documents are candidates only if the sums of
the hashes of some part agree. Candidates hang together in groups. A group is
compared in tiles, each a pair of blocks of the same or of neighbouring size
bands; what lies in other bands differs too much in size. In a tile each set has
a bitmap, the parity of its hashes by bucket: the bits in which two bitmaps
differ bound the overlap from above, and only pairs that pass are intersected as
sorted arrays. A tile sends a spanning forest of its links and no pairs.

Equal sets are one entry, so that copies cost nothing after the first pass.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaprep.llm.common import components, slices, text_bytes, write_table

#: Sets of a block, and the bytes of their hashes. A task holds two blocks.
BLOCK = 2_048
BLOCK_BYTES = 16 << 20
#: Largest bitmap of a set, in bits.
BITS = 4_096
#: Ids that are sent to every task to fetch texts; more are joined by shuffle.
SENT_IDS = 200_000
#: A power of two above the number of places in the ladder.
LEVELS = 64
#: One in SEEN rows is looked at for tiles that hold HOT of them or more.
SEEN, HOT, HOT_TILES = 64, 512, 100_000
#: A part with so few members is compared along with the next one.
WEAK = 1


def shingle_set(text: bytes, size: int) -> tuple[int, np.ndarray]:
    """How many distinct word n-grams a text has, and their sorted hashes."""
    words = text.lower().split()  # of bytes: changes and parts by ASCII only
    if not words:
        return 0, np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        grams = {joined}
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-size].tolist()]
        stops = (ends[size - 1 :] - 1).tolist()
        grams = {joined[a:b] for a, b in zip(starts, stops)}
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams))
    hashes.sort()
    return len(grams), hashes


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    both = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8")
    return int(both[0]), int(both[1])


def most_differing(total: int, percent: int) -> int:
    """In how many members two linked sets of `total` members together may differ."""
    return total * (100 - percent) // (100 + percent)


def least_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """How many members two sets of `total` members together share if they link."""
    return -(-percent * total // (100 + percent))


def least_parts(differing: int) -> int:
    """Parts that sets are dealt to that may differ in so many members.

    An eighth more than needed, so that linked sets share several parts.
    """
    return differing + 2 + differing // 8 if differing else 1


def _ladder() -> list[int]:
    steps = [1]
    while steps[-1] < 1 << 34:
        steps.append(max(steps[-1] + 1, steps[-1] * 3 // 2))
    return steps


#: Numbers of parts. Few of them serve all sizes, so that most sets are dealt once.
LADDER = _ladder()
#: For each number of parts, the most members in which sets dealt so may differ.
SERVED = [max(0, (8 * (m - 2) + 7) // 9) for m in LADDER]


def part_levels(n: int, percent: int) -> list[int]:
    """The places in the ladder by which a set of n members can meet a linked one."""
    ends = (-(-n * percent // 100), n * 100 // percent)
    low, high = (bisect_left(LADDER, least_parts(most_differing(n + m, percent))) for m in ends)
    return [k for k in range(low, high + 1) if LADDER[k] > 1]  # one part: equal sets only


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def part_keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Keys, of which any set that differs in fewer than `parts` members has one.

    The key of a part is made of the sum of its hashes. With fewer differences
    than parts some part is equal and the next one differs in one member at
    most. So a part of hardly any members gives keys with the next part instead:
    all of it, and without each of its members in turn.
    """
    number = hashes % np.uint64(parts)
    order = np.argsort(number, kind="stable")
    sorted_hashes, number = hashes[order], number[order].astype(np.int64)
    edges = np.searchsorted(number, np.arange(parts + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sorted_hashes, dtype=np.uint64)])
    sums = sums[edges[1:]] - sums[edges[:-1]]
    counts = np.diff(edges)
    own = _mixed(_mixed(sums + np.uint64(parts)) + np.arange(parts, dtype=np.uint64))
    weak = np.flatnonzero(counts <= WEAK)
    if not len(weak):
        return own
    after = (weak + 1) % parts
    whole = _mixed(own[weak] + np.uint64(1) + _mixed(sums[after]))
    at = np.repeat(np.arange(len(weak)), counts[after])
    inside = np.arange(len(at)) - np.repeat(np.cumsum(counts[after]) - counts[after], counts[after])
    member = sorted_hashes[edges[after][at] + inside]
    without = _mixed(own[weak][at] + np.uint64(1) + _mixed(sums[after][at] - member))
    return np.concatenate([own[counts > WEAK], whole, without])


def _described(size: int, percent: int, names: list[str]):
    """Rows (id, row, text) as (id, row, d1, d2, n, tiles), slice by slice.

    Of equal sets within a slice only the first sends keys. The low bits of a
    key tell its place in the ladder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                digests, counts, tiles, seen = [], [], [], set()
                for text in text_bytes(part.column(2)):
                    n, hashes = shingle_set(text, size)
                    counts.append(n)
                    digests.append(digest(hashes) if n else (None, None))
                    keys = [np.empty(0, np.int64)]
                    if n and digests[-1] not in seen:
                        seen.add(digests[-1])
                        for level in part_levels(n, percent):
                            key = part_keys(hashes, LADDER[level]).view(np.int64)
                            keys.append(key & ~(LEVELS - 1) | level)
                    tiles.append(np.concatenate(keys))
                offsets = np.cumsum([0, *[len(t) for t in tiles]])
                d1, d2 = zip(*digests)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(tiles))),
                    ],
                    names,
                )

    return run


def _bitmaps(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """For each set the parity of its hashes by bucket, as 64-bit words."""
    out = np.empty((len(hashes), bits // 64), np.uint64)
    for start in range(0, len(hashes), 256):
        some = hashes[start : start + 256]
        bucket = (np.concatenate(some) >> np.uint64(17)) % np.uint64(bits)
        at = bucket.astype(np.int64) + np.repeat(np.arange(len(some)) * bits, [len(h) for h in some])
        odd = (np.bincount(at, minlength=len(some) * bits) & 1).astype(np.uint8)
        out[start : start + len(some)] = np.packbits(odd).view(np.uint64).reshape(len(some), -1)
    return out


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Members that a sorted array shares with each of the others."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    starts = np.cumsum([0, *[len(o) for o in others[:-1]]])
    return np.add.reduceat((one[at] == flat).astype(np.int64), starts)


def forest(nodes: np.ndarray, sides: np.ndarray, hashes: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the sets of a tile: a spanning forest of all of them.

    Sets of side 0 meet those of side 1; sets of side 2 meet each other.
    """
    sizes = np.array([len(h) for h in hashes])
    bits = 64
    while bits < min(int(sizes.max()), BITS):
        bits *= 2
    maps = _bitmaps(hashes, bits)
    tree = np.full(len(nodes), -1)
    for i in range(len(nodes)):
        if tree[i] >= 0:
            continue
        tree[i] = i
        reached = [i]
        while reached:
            j = reached.pop()
            rest = np.flatnonzero((tree < 0) & ((sides != sides[j]) | (sides == 2)))
            need = least_overlap(sizes[rest] + sizes[j], percent)
            differ = np.bitwise_count(maps[rest] ^ maps[j]).sum(axis=1, dtype=np.int64)
            bound = np.minimum((sizes[rest] + sizes[j] - differ) // 2, np.minimum(sizes[rest], sizes[j]))
            passed = bound >= need
            rest, need = rest[passed], need[passed]
            if len(rest):
                found = rest[_overlaps(hashes[j], [hashes[r] for r in rest.tolist()]) >= need]
                tree[found] = i
                reached.extend(found.tolist())
    other = np.flatnonzero(tree != np.arange(len(nodes)))
    return nodes[other], nodes[tree[other]]


def _spread(held: DataFrame) -> DataFrame:
    """held with `salt`, other than 0 only in tiles that very many rows share.

    These are found in a fixed share of the rows. At most HOT_TILES tiles can
    have so many; which they are changes how the rows are dealt and nothing else.
    """
    seen = held.where(F.pmod(F.xxhash64("row"), F.lit(SEEN)) == 0)
    sizes = seen.groupBy("tile").agg(F.count("*").alias("seen")).where(F.col("seen") >= HOT)
    least = F.greatest(F.lit(HOT), F.expr("sum(seen) over ()") / HOT_TILES)
    hot = sizes.select("tile", "seen", least.alias("least")).where("seen >= least")
    hot = write_table(hot.select("tile", F.ceil(F.col("seen") / HOT).alias("salts")), "hot")
    if hot.isEmpty():
        return held.withColumn("salt", F.lit(0).cast("long"))
    salt = F.coalesce(F.pmod(F.xxhash64("row"), F.col("salts")), F.lit(0).cast("long"))
    return held.join(F.broadcast(hot), "tile", "left").withColumn("salt", salt).drop("salts")


def _candidate_groups(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(node, grp): the groups of sets that share keys, directly or by others.

    Sets that link share as many keys as there are parts more than members in
    which they may differ. A set that shares fewer keys with all others together
    has no link by that number of parts, so it is left out there.
    """
    held = _spread(sets.select("row", "n", F.explode("tiles").alias("tile")))
    several = F.expr("count(*) over (partition by tile, salt)") > 1
    # A salted tile has many rows; that a share of it has one alone is as good as shared.
    shared = held.withColumn("several", several | (F.col("salt") > 0)).where("several")
    shared = write_table(shared.select("row", "n", "tile", "salt"), "shared")
    level = F.col("tile").bitwiseAND(F.lit(LEVELS - 1)).cast("int")
    partner = F.floor(F.col("n") * 100 / percent)
    differing = F.floor((F.col("n") + partner) * (100 - percent) / (100 + percent))
    parts, served = (F.get(F.lit(x).cast("array<long>"), level) for x in (LADDER, SERVED))
    counted = shared.groupBy("row", level.alias("level")).agg(
        F.count("*").alias("keys"), F.first(parts - F.least(differing, served)).alias("least")
    )
    able = counted.where("keys >= least").select("row", "level")
    kept = shared.withColumn("level", level).join(able, ["row", "level"])
    kept = kept.select("row", "tile", "salt", F.expr("min(row) over (partition by tile, salt)").alias("other"))
    kept = write_table(kept.select("row", "tile", "salt", "other").distinct(), "ties")
    salted = kept.where("row = other").select("tile", "row")
    firsts = salted.groupBy("tile").agg(F.min("row").alias("other"))
    across = salted.join(firsts, "tile").where("row != other").select("row", "other")
    edges = kept.where("row != other").select("row", "other").unionByName(across).distinct()
    nodes = members.select("row", "node")
    edges = edges.join(nodes, "row").select("other", F.col("node").alias("a"))
    edges = edges.join(nodes.withColumnRenamed("row", "other"), "other").select("a", F.col("node").alias("b"))
    # `components` names the smallest node of each component by its others only.
    found = write_table(components(edges).select("node", F.col("component").alias("grp")), "groups")
    return found.unionByName(found.select(F.col("grp").alias("node"), "grp").distinct())


def _tiles(candidates: DataFrame, percent: int) -> DataFrame:
    """The candidates with `units`: (unit, side) of the tiles each takes part in.

    A group that fits one block is one tile. A larger one is cut into size
    bands and these into blocks, and each block meets those of its own and of
    the neighbouring bands.
    """
    # A little wider than the ratio of sizes, so that rounding parts no pair.
    width = math.log(100 / percent) * 1.0001
    banded = candidates.withColumn("band", F.floor(F.log("n") / width))
    weight = F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)
    whole = candidates.groupBy("grp").agg(weight.alias("weight"), F.count("*").alias("sets"))
    whole = whole.where("sets > 1").select("grp", F.col("weight") <= 1)
    whole = whole.toDF("grp", "one")
    sizes = write_table(
        banded.join(whole.where("not one"), "grp", "left_semi")
        .groupBy("grp", "band")
        .agg(F.ceil(weight).alias("blocks")),
        "bands",
    )

    def beside(step: int, name: str) -> DataFrame:
        return sizes.select("grp", (F.col("band") + step).alias("band"), F.col("blocks").alias(name))

    around = sizes.join(beside(-1, "above"), ["grp", "band"], "left").join(beside(1, "below"), ["grp", "band"], "left")
    rows = banded.join(whole, "grp").join(around, ["grp", "band"], "left")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))

    def tile(low_band: Column, low: Column, high_band: Column, high: Column, side: Column) -> Column:
        return F.struct(F.xxhash64("grp", low_band, low, high_band, high).alias("unit"), side.alias("side"))

    def every(blocks: str, make) -> Column:
        numbers = F.when(F.col(blocks) > 0, F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
        return F.coalesce(F.transform(numbers, make), F.array().cast("array<struct<unit:long,side:int>>"))

    band = F.col("band")
    inner = every(
        "blocks",
        lambda j: tile(
            band, F.least(own, j), band, F.greatest(own, j),
            F.when(j == own, 2).when(own < j, 0).otherwise(1),
        ),
    )
    upper = every("above", lambda j: tile(band, own, band + 1, j, F.lit(0)))
    lower = every("below", lambda j: tile(band - 1, j, band, own, F.lit(1)))
    single = F.array(F.struct(F.xxhash64("grp").alias("unit"), F.lit(2).alias("side")))
    units = F.when(F.col("one"), single).otherwise(F.concat(inner, upper, lower))
    return rows.select("node", "least", "d1", "d2", units.alias("units"))


def _fetched(size: int):
    """Rows (text, node, d1, d2, units) as (unit, side, node, hashes).

    Of the texts with a wanted id only those whose set is the wanted one count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                part = batch.slice(start, stop - start)
                wanted = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist()))
                found = [shingle_set(t, size)[1] for t in text_bytes(part.column(0))]
                keep = [k for k, h in enumerate(found) if len(h) and digest(h) == wanted[k]]
                part = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(4), pa.array([found[k].tobytes() for k in keep], pa.binary())],
                    ["node", "units", "hashes"],
                )

    return run


def _compared(percent: int):
    """Rows (unit, side, node, hashes) sorted by unit as links (a, b)."""

    def links(nodes: list[int], sides: list[int], bodies: list[bytes]) -> pa.RecordBatch:
        first = {node: k for k, node in reversed(list(enumerate(nodes)))}  # of repeated rows one
        kept = sorted(first.values())
        hashes = [np.frombuffer(bodies[k], np.uint64) for k in kept]
        a, b = forest(np.array(nodes)[kept], np.array(sides)[kept], hashes, percent)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for batch in batches:
            units = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)]
            for start, stop in zip(edges, edges[1:]):
                if start == stop:
                    continue
                if units[start] != now:
                    if len(held[0]) > 1:
                        yield links(*held)
                    now, held = units[start], ([], [], [])
                for column, values in zip((2, 1, 3), held):
                    values.extend(batch.column(column).slice(start, stop - start).to_pylist())
        if len(held[0]) > 1:
            yield links(*held)

    return run


def similar_documents(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 85
) -> DataFrame:
    """(id, n_shingles, component_id): one row for each row of df.

    A row's set are the distinct n-grams of its words, A-Z lower-cased and
    parted at ASCII whitespace; fewer words are one n-gram as a whole. Rows link
    whose sets share `percent` of 100 members of their union or more, and
    `component_id` is the smallest id reachable. All links count; none is lost
    to a limit. Repeated rows are in one component.

    NULL and empty texts have no n-grams and link with nothing: their component
    is their own id. A row without id takes part in links but never names a
    component; a component of such rows only has a NULL id. Other columns are
    not read. Members are compared by 64-bit hashes, sets that are equal by 128
    bits.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    numbered = rows.select("id", F.monotonically_increasing_id().alias("row"), "text")
    schema = T.StructType(
        [
            rows.schema["id"],
            *[T.StructField(c, T.LongType()) for c in ("row", "d1", "d2", "n")],
            T.StructField("tiles", T.ArrayType(T.LongType())),
        ]
    )
    sets = write_table(numbered.mapInArrow(_described(shingle, percent, schema.names), schema), "sets")
    filled = sets.where("n > 0").select("id", "row", "d1", "d2", "n")
    classes = filled.groupBy("d1", "d2").agg(
        F.min("row").alias("node"), F.min("id").alias("least"), F.first("n").alias("n")
    )
    classes = write_table(classes, "classes")
    members = write_table(filled.join(classes.select("d1", "d2", "node"), ["d1", "d2"]).select("id", "row", "n", "node"), "members")

    groups = _candidate_groups(sets, members, percent)
    candidates = write_table(_tiles(classes.join(groups, "node"), percent), "candidates")
    wanted = F.broadcast(candidates) if candidates.count() <= SENT_IDS else candidates
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("least"))).select("text", "node", "d1", "d2", "units")
    fetched = texts.mapInArrow(
        _fetched(shingle), "node long, units array<struct<unit:long,side:int>>, hashes binary"
    )
    placed = fetched.select(F.explode("units").alias("at"), "node", "hashes")
    placed = placed.select("at.unit", "at.side", "node", "hashes").repartition("unit").sortWithinPartitions("unit")
    links = placed.mapInArrow(_compared(percent), "a long, b long")

    named = classes.join(components(links), "node", "left").select(
        "node", "least", F.coalesce("component", "node").alias("component")
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "component").select("node", "component_id")
    found = members.join(labels, "node").select("id", F.col("n").alias("n_shingles"), "component_id")
    empty = sets.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return found.unionByName(empty).withColumnRenamed("id", id_column)
