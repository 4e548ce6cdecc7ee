from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from qaprep.operators import align, splits, vocab
from tests.conftest import plan_text

ROWS = 1000


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(ROWS).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("team"),
    )


def _order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def _members(df):
    found = {}
    for row in df.collect():
        found.setdefault(row["split"], set()).add(row["row_id"])
    return found


@pytest.mark.parametrize("mode", splits.SPLIT_MODES)
def test_splits_are_disjoint_and_cover(rows, mode):
    found = _members(splits.split_dataset(rows, "row_id", mode=mode))
    assert set(found) == set(splits.SPLITS)
    assert sum(map(len, found.values())) == ROWS
    assert set().union(*found.values()) == set(range(ROWS))


@pytest.mark.parametrize("shares", [(0.8, 0.1, 0.1), (0.7, 0.2, 0.1), (0.333, 0.333, 0.334), (1.0, 0.0, 0.0)])
@pytest.mark.parametrize("mode", ["exact", "floor"])
def test_exact_sizes(rows, shares, mode):
    train, validation, test = shares
    found = _members(
        splits.split_dataset(rows, "row_id", 7, train, validation, test, mode)
    )
    if mode == "exact":
        held = math.ceil(round(ROWS * (validation + test), 6))
        tested = math.ceil(round(held * (test / (validation + test)), 6)) if held else 0
        sizes = (ROWS - held, held - tested, tested)
    else:
        sizes = (int(train * ROWS), int(validation * ROWS))
        sizes = (*sizes, ROWS - sum(sizes))
    order = _order(range(ROWS), 7)
    start = 0
    for name, size in zip(splits.SPLITS, sizes):
        assert found.get(name, set()) == set(order[start : start + size])
        start += size


def test_close_shares_move_few_rows(rows):
    one = splits.split_dataset(rows, "row_id").withColumnRenamed("split", "a")
    two = splits.split_dataset(one, "row_id", train=0.805, validation=0.095, test=0.1)
    moved = two.where("a <> split")
    assert moved.count() <= 0.02 * rows.count() + 3
    assert {(r.a, r.split) for r in moved.collect()} <= {("validation", "train")}


def test_hash_split_does_not_shuffle(rows):
    assert "Exchange" not in plan_text(splits.split_dataset(rows, "row_id"))


def test_split_arguments_are_checked(rows):
    with pytest.raises(ValueError, match="sum"):
        splits.split_dataset(rows, "row_id", 42, 0.5, 0.1, 0.1)
    with pytest.raises(ValueError, match="mode"):
        splits.split_dataset(rows, "row_id", mode="random")


@pytest.mark.parametrize("n", [0, 3, ROWS + 5])
def test_sample(rows, n):
    got = {r["row_id"] for r in splits.sample_n(rows, n, "row_id", 13).collect()}
    assert got == set(_order(range(ROWS), 13)[:n])


def test_review_sample_has_blank_columns(rows):
    sample = splits.sample_for_review(rows, 5).collect()
    assert len(sample) == 5
    assert all(r["quality_label"] == r["notes"] == "" for r in sample)


def test_cap_per_group(rows):
    limit = 25
    got, groups = {}, {}
    for row in splits.cap_per_group(rows, "team", limit, "row_id", 42).collect():
        got.setdefault(row["team"], set()).add(row["row_id"])
    for row in rows.collect():
        groups.setdefault(row["team"], []).append(row["row_id"])
    assert {k: set(_order(v, 42)[:limit]) for k, v in groups.items()} == got
    assert len(groups["hot"]) > limit


def test_align(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "row_id int, p string")
    right = spark.createDataFrame([(2, "x"), (1, "y")], "row_id int, r string")
    zipped = align.zip_tables(left, right).collect()
    assert sorted(tuple(r) for r in zipped) == [(1, "a", "y"), (2, "b", "x")]
    part = align.append_column(left, right.filter("row_id = 1"), "r").collect()
    assert sorted(tuple(r) for r in part) == [(1, "a", "y"), (2, "b", None)]


@pytest.fixture(scope="module")
def texts(spark):
    data = [(1, "b a b"), (2, "c b a [END] d"), (3, ""), (4, None), (5, "a " * 50)]
    return spark.createDataFrame(data, "row_id long, text string")


def test_vocabulary_order_and_size(texts):
    words = [tuple(r) for r in vocab.build_vocab(texts, "text", 6).orderBy("id").collect()]
    assert words == [
        (0, "[PAD]", None), (1, "[UNK]", None), (2, "[END]", None),
        (3, "a", 52), (4, "b", 3), (5, "c", 1),
    ]
    with pytest.raises(ValueError):
        vocab.build_vocab(texts, "text", 2)


def test_encode_pad_decode(texts):
    words = vocab.build_vocab(texts, "text", 6).cache()
    encoded = vocab.encode(texts, "text", words, 4)
    ids = {r["row_id"]: r["input_ids"] for r in encoded.collect()}
    assert ids == {1: [4, 3, 4], 2: [5, 4, 3, 1], 3: [], 4: [], 5: [3] * 4}
    padded = vocab.pad(encoded, 5)
    masked = padded.withColumn("labels", vocab.mask_labels(F.col("input_ids"), F.col("attention_mask")))
    row = masked.filter("row_id = 1").first()
    assert row["input_ids"] == [4, 3, 4, 0, 0]
    assert row["attention_mask"] == [1, 1, 1, 0, 0]
    assert row["labels"] == [4, 3, 4, -100, -100]
    checks = vocab.validate_encoded(masked, 5).first()
    assert tuple(checks) == (5, 0, 0, 0)
    assert vocab.validate_encoded(masked, 6).first()["bad_length"] == 5
    broken = masked.withColumn("labels", F.transform("labels", lambda x: F.lit(7)))
    assert vocab.validate_encoded(broken, 5).first()["bad_labels"] == 5
    text = vocab.decode(masked, words, 6, ids="labels").collect()
    assert {r["row_id"]: r["text"] for r in text} == {1: "b a b", 2: "c b a", 3: "", 4: "", 5: "a a a a"}


def test_decode_clips_ids(spark, texts):
    words = vocab.build_vocab(texts, "text", 6)
    df = spark.createDataFrame([(1, [99, -7, 3, -100])], "row_id long, input_ids array<int>")
    assert vocab.decode(df, words, 6).first()["text"] == "c a"


def test_encode_moves_no_row(texts, spark):
    words = vocab.build_vocab(texts, "text", 6).cache()
    plan = plan_text(vocab.decode(vocab.encode(texts, "text", words, 4), words, 6))
    assert "Exchange" not in plan and "Join" not in plan


def test_a_large_vocabulary_is_joined(texts):
    words = vocab.build_vocab(texts, "text", 6).cache()
    small = vocab.decode(vocab.encode(texts, "text", words, None), words, 6)
    large = vocab.encode(texts, "text", words, None, task_bytes=0)
    large = vocab.decode(large, words, 6, task_bytes=0).select(small.columns)
    assert small.count() == 5
    assert sorted(small.collect()) == sorted(large.collect())


def test_vocabulary_cuts_ties_by_the_alphabet(spark):
    counts = {f"w{i:03d}": 1 + i % 7 for i in range(200)} | {"the": 500, "of": 70, "und": 64, "le": 63}
    texts = [(" ".join([w] * n),) for w, n in counts.items()]
    df = spark.createDataFrame(texts, "text string")
    order = sorted(counts, key=lambda w: (-counts[w], w))
    for size in (1, 2, 5, 33, 100, 204, 300):
        got = vocab.build_vocab(df, "text", size, ()).orderBy("id").collect()
        assert [(r["id"], r["token"], r["n"]) for r in got] == [
            (i, w, counts[w]) for i, w in enumerate(order[:size])
        ]
    assert [r["token"] for r in vocab.build_vocab(df, "text", 3).orderBy("id").collect()] == list(vocab.SPECIALS)


def test_pairs_take_labels_from_the_target(spark):
    rows = [(1, "a b c", "b"), (2, None, ""), (2, "c x", "a a a")]
    df = spark.createDataFrame(rows, "row_id int, input_text string, target_text string")
    words = vocab.build_vocab(df, "input_text", 6).cache()
    got = vocab.encode_pairs(df, words, 4, 2).collect()
    assert sorted((r["input_ids"], r["attention_mask"], r["labels"]) for r in got) == [
        ([0, 0, 0, 0], [0, 0, 0, 0], [-100, -100]),
        ([3, 1, 0, 0], [1, 1, 0, 0], [4, 4]),
        ([4, 5, 3, 0], [1, 1, 1, 0], [5, -100]),
    ]


def test_argmax_takes_the_first_maximum(spark):
    df = spark.createDataFrame([([0.5, 2.0, 2.0],)], "v array<float>")
    assert df.select(vocab.argmax(F.col("v"))).first()[0] == 1


@pytest.fixture(scope="module")
def odd_keys(spark):
    """1,000 rows: many without key, many with one key, some equal as a whole."""
    data = [(None, i, "a") for i in range(600)] + [("k", i, "b") for i in range(300)]
    data += [("same", 0, "a")] * 100
    return spark.createDataFrame(data, "key string, value int, team string").repartition(3)


def test_exact_sizes_with_null_and_repeated_keys(odd_keys):
    sizes = splits.split_dataset(odd_keys, "key", mode="exact").groupBy("split").count()
    assert {r["split"]: r["count"] for r in sizes.collect()} == {"train": 800, "validation": 100, "test": 100}
    floor = splits.split_dataset(odd_keys, "key", mode="floor", train=0.333, validation=0.333, test=0.334)
    sizes = {r["split"]: r["count"] for r in floor.groupBy("split").count().collect()}
    assert sizes == {"train": 333, "validation": 333, "test": 334}
    hashed = splits.split_dataset(odd_keys.where("key is null"), "key").groupBy("split").count()
    assert {r["split"] for r in hashed.collect()} == set(splits.SPLITS)


@pytest.mark.parametrize("n", [1, 650, 999, 1000, 1001])
def test_sample_sizes_with_null_and_repeated_keys(odd_keys, n):
    assert splits.sample_n(odd_keys, n, "key").count() == min(n, 1000)


def test_cap_with_null_and_repeated_keys(odd_keys):
    counts = splits.cap_per_group(odd_keys, "team", 250, "key").groupBy("team").count()
    assert {r["team"]: r["count"] for r in counts.collect()} == {"a": 250, "b": 250}


def test_rows_of_one_key_are_encoded_apart(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c d")], "row_id int, text string")
    words = vocab.build_vocab(df, "text", 10).cache()
    encoded = vocab.encode(df, "text", words, 4)
    assert sorted(len(r["input_ids"]) for r in encoded.collect()) == [2, 2]
    back = vocab.decode(encoded, words, 10, ids="input_ids").collect()
    assert sorted(r["text"] for r in back) == ["a b", "c d"]


@pytest.fixture(scope="module")
def hot_key(spark):
    """Two of three rows share a key; of these a third are equal in all columns."""
    number = F.when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id"))
    key = F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot")
    team = F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise((F.col("id") % 2).cast("string"))
    return spark.range(0, 6000, 1, 6).select(key.alias("key"), number.alias("n"), team.alias("team"))


@pytest.mark.parametrize("by", [[], ["team"]])
@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_cutting_buckets_again_takes_the_same_rows(hot_key, by, broadcast_rows):
    cuts = {
        "_first": F.floor(F.col("_rows") * 0.4),
        "_second": F.floor(F.col("_rows") * 0.9),
        "_none": F.lit(0),
        "_all": F.col("_rows"),
    }

    def taken(sorted_rows, broadcast_rows):
        flagged = splits._with_rank_flags(hot_key, by, "key", 42, cuts, sorted_rows, broadcast_rows)
        return sorted(map(repr, flagged.collect()))

    # With no bucket small enough, every digit is used.
    assert taken(0, broadcast_rows) == taken(10**9, 1000)


def test_sizes_are_exact_when_one_key_holds_most_rows(hot_key):
    flagged = splits._with_rank_flags(hot_key, ["team"], "key", 1, {"_kept": F.lit(500)}, 50, 0)
    counts = {r["team"]: r["count"] for r in flagged.filter("_kept").groupBy("team").count().collect()}
    assert counts == {None: 500, "0": 500, "1": 500}


def test_selection_of_an_empty_table(hot_key):
    assert splits.sample_n(hot_key.limit(0), 5, "key").count() == 0
    assert splits.cap_per_group(hot_key.limit(0), "team", 5, "key").count() == 0
