"""Global order without one big task.

``row_number()`` over an unpartitioned window pulls every row into one task. The
functions here get the same answers from small per-bucket counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import shared_folder, stored

HISTOGRAM_BUCKETS = 4096


def seeded_hash(seed: int, *keys: Column | str) -> Column:
    """md5 of ``seed|key|...``: a seeded random order that no partitioning changes."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def hash_to_long(md5: Column) -> Column:
    """First 60 bits of an md5 as a bigint, in the order of the text."""
    return F.conv(F.substring(md5, 1, 15), 16, 10).cast("bigint")


@dataclass(frozen=True)
class CutPoint:
    """Key values of the n-th row in order; ``at_or_before`` tests other rows."""

    values: tuple[int, ...]

    def at_or_before(self, keys: Sequence[Column]) -> Column:
        test = F.lit(True)
        for key, value in reversed(list(zip(keys, self.values))):
            test = (key < value) | ((key == value) & test)
        return test


def cut_point(df: DataFrame, keys: Sequence[Column], n: int) -> CutPoint | None:
    """Key values of the n-th smallest row (1-based); None when n < 1.

    Keys are bigint, compared in turn. Each pass counts rows per bucket of the
    remaining value range, at most ``HISTOGRAM_BUCKETS`` counts, and narrows the
    range to the bucket that holds row n. Only the key columns are read and only
    counts reach the driver. A key with many equal values costs nothing extra: the
    counts combine before the shuffle, and the next key decides among them.
    """
    if n < 1:
        return None
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[k.cast("bigint").alias(name) for k, name in zip(keys, names)])
    values: list[int] = []
    wanted = n
    for name in names:
        low, high, count = rows.agg(F.min(name), F.max(name), F.count(name)).first()
        if count < wanted:
            raise ValueError(f"asked for row {n}, only {count - wanted + n} rows")
        while low < high:
            exact = count <= HISTOGRAM_BUCKETS
            width = 1 if exact else -(-(high - low + 1) // HISTOGRAM_BUCKETS)
            # a range wider than a bigint is taken apart in decimals
            start = low if high - low < 1 << 63 else f"cast({low} as decimal(20, 0))"
            bucket = F.expr(f"cast(({name} - ({start})) div {width} as bigint)")
            counts = (
                rows.filter(F.col(name).between(low, high))
                .groupBy(bucket.alias("bucket")).count().orderBy("bucket").collect()
            )
            for bucket_id, count in counts:
                if wanted <= count:
                    break
                wanted -= count
            low, high = low + bucket_id * width, min(high, low + (bucket_id + 1) * width - 1)
        values.append(low)
        if wanted == count:
            break
        rows = rows.filter(F.col(name) == low)
    return CutPoint(tuple(values))


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based position of every row in the given order.

    Rows are range-partitioned and sorted once, then frozen with ``checkpoint`` so
    that partition numbers cannot change between the count and the ranking, not even
    after an executor is lost. Offsets are one small count per partition. ``order``
    must be unique per row: range partitioning then splits a hot leading key.
    """
    shared_folder(df.sparkSession)
    ordered = (
        df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("_part").count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    position = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ordered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + position + 1)
        .drop("_at", "_part", "_offset")
    )


def running_total(
    df: DataFrame, order: str, value: str, name: str = "running_total", block: int = 1000
) -> DataFrame:
    """Running sum of ``value`` by a dense bigint ``order`` column.

    Sums run inside blocks of ``block`` neighbouring keys; a second running sum over
    the block totals, ``block`` times fewer rows, gives each block its start.
    """
    blocks = df.withColumn("_block", F.expr(f"{order} div {block}"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocks.groupBy("_block").agg(F.sum(value).alias("_sum"))
        .select("_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    )
    return (
        blocks.withColumn(name, F.sum(value).over(inside))
        .join(starts, "_block")
        .withColumn(name, F.col(name) + F.col("_start"))
        .drop("_block", "_start")
    )


def top_per_key(
    df: DataFrame, key: str, order: Sequence[Column], spread: str, k: int, salts: int = 16
) -> DataFrame:
    """First ``k`` rows per key, in two steps.

    A key is first cut down inside ``salts`` parts, chosen by the ``spread`` column,
    and then as a whole, so the last step sees at most ``salts * k`` rows per key.
    Spark also limits each partition before either shuffle.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts))
    part = Window.partitionBy(key, "_salt").orderBy(*order)
    whole = Window.partitionBy(key).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_row", F.row_number().over(part)).filter(F.col("_row") <= k)
        .drop("_salt")
        .withColumn("_row", F.row_number().over(whole)).filter(F.col("_row") <= k)
        .drop("_row")
    )


def split_exact(
    df: DataFrame,
    key: str | Sequence[str],
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
    seed: int = 42,
    names: tuple[str, str, str] = ("train", "val", "test"),
) -> DataFrame:
    """Seeded shuffle cut into exactly floor(n*a), floor(n*b) and the remaining rows.

    Only the two cut points are computed, from the narrow keys, which are written once; each row
    then compares its own hash with them, so the rows themselves never move and ``df`` is
    read twice in all. ``key`` names one or more bigint columns, unique together; they also
    settle equal hashes.
    """
    if abs(sum(ratios) - 1.0) >= 1e-6:
        raise ValueError("ratios must sum to 1")
    columns = [key] if isinstance(key, str) else list(key)
    keys = [hash_to_long(seeded_hash(seed, *columns)), *[F.col(c) for c in columns]]
    names_of = [f"k{i}" for i in range(len(keys))]
    narrow = stored(df.select(*[k.alias(n) for k, n in zip(keys, names_of)]), "split-keys")
    total = narrow.count()
    first = int(total * ratios[0])
    second = first + int(total * ratios[1])
    held = [F.col(n) for n in names_of]
    first_cut, second_cut = cut_point(narrow, held, first), cut_point(narrow, held, second)
    label = F.lit(names[2])
    if second_cut:
        label = F.when(second_cut.at_or_before(keys), names[1]).otherwise(label)
    if first_cut:
        label = F.when(first_cut.at_or_before(keys), names[0]).otherwise(label)
    return df.withColumn("split", label)
