import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import rank


def hashed(i, seed=42):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


@pytest.mark.parametrize("n,sizes", [
    (0, (0, 0, 0)), (1, (0, 0, 1)), (9, (7, 0, 2)), (10, (8, 1, 1)), (2919, (2335, 291, 293)),
])
def test_split_sizes(spark, n, sizes):
    rows = rank.split_exact(spark.range(n), "id").groupBy("split").count().collect()
    got = {r["split"]: r["count"] for r in rows}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == sizes


def test_split_members_are_the_seeded_order(spark):
    n = 1000
    order = sorted(range(n), key=hashed)
    got = {r["id"]: r["split"] for r in rank.split_exact(spark.range(n), "id").collect()}
    want = {i: "train" if p < 800 else "val" if p < 900 else "test" for p, i in enumerate(order)}
    assert got == want
    again = rank.split_exact(spark.range(n).repartition(3), "id")
    assert {r["id"]: r["split"] for r in again.collect()} == want


def test_split_settles_equal_hashes_by_key(spark, monkeypatch):
    monkeypatch.setattr(rank, "hash_to_long", lambda c: F.lit(7).cast("bigint"))
    rows = [(a, b) for a in range(3) for b in range(7)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(4)
    got = {(r["a"], r["b"]): r["split"] for r in rank.split_exact(df, ["a", "b"]).collect()}
    assert got == {row: "train" if i < 16 else "val" if i < 18 else "test" for i, row in enumerate(rows)}


def test_split_rejects_ratios(spark):
    with pytest.raises(ValueError):
        rank.split_exact(spark.range(3), "id", (0.8, 0.1, 0.2))


def test_cut_point_with_hot_key(spark):
    """One key value holds most rows; the second key decides inside it."""
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.7 else rng.randrange(-10**15, 10**15), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(5)
    keys = [F.col("a"), F.col("b")]
    for n in (1, 2, 1777, 2500, 4999, 5000):
        cut = rank.cut_point(df, keys, n)
        kept = {(r["a"], r["b"]) for r in df.filter(cut.at_or_before(keys)).collect()}
        assert kept == set(sorted(rows)[:n])


def test_cut_point_over_the_whole_bigint_range(spark):
    rng = random.Random(4)
    ids = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(6000)} | {-(1 << 63), (1 << 63) - 1})
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(3)
    for n in (1, 2, 3000, len(ids)):
        assert rank.cut_point(df, [F.col("id")], n).values == (ids[n - 1],)


def test_cut_point_bounds(spark):
    assert rank.cut_point(spark.range(3), [F.col("id")], 0) is None
    with pytest.raises(ValueError):
        rank.cut_point(spark.range(3), [F.col("id")], 4)


def test_global_rank_with_hot_leading_key(spark):
    rows = [(5, i) for i in range(2000)] + [(i, 0) for i in range(6, 500)]
    shuffled = list(rows)
    random.Random(2).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "a bigint, b bigint").repartition(6)
    got = {(r["a"], r["b"]): r["rank"] for r in rank.global_rank(df, ["a", "b"]).collect()}
    assert got == {row: i + 1 for i, row in enumerate(sorted(rows))}


def test_running_total_golden_and_across_blocks(spark):
    kept = [84, 82, 60, 93, 99]
    df = spark.createDataFrame(list(enumerate(kept)), "b bigint, n bigint")
    for block in (1, 2, 1000):
        rows = rank.running_total(df, "b", "n", block=block).orderBy("b").collect()
        assert [r["running_total"] for r in rows] == [84, 166, 226, 319, 418]


def test_top_per_key_is_exact_for_a_hot_key(spark):
    rows = [(1, i, (i * 7919) % 1000) for i in range(5000)] + [(2, 1, 3), (2, 2, 3)]
    df = spark.createDataFrame(rows, "k bigint, id bigint, s bigint").repartition(7)
    got = rank.top_per_key(df, "k", [F.desc("s"), F.asc("id")], "id", 25).collect()
    want = sorted((r for r in rows if r[0] == 1), key=lambda r: (-r[2], r[1]))[:25] + rows[-2:]
    assert sorted(map(tuple, got)) == sorted(want)
