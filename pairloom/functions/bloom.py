"""A Bloom filter of texts (with one hash) as a column expression: built by one aggregation, tested inside the row.

Its size is a parameter and never grows with the texts; more of them only let more others through. It may
stand before an exact join or count, never in place of one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 1 << 21


def _place(text: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(bits).cast("bigint"))


@dataclass(frozen=True)
class Bloom:
    """``words`` holds the bits, 64 at a time."""

    words: tuple[int, ...]

    @staticmethod
    def of(df: DataFrame, column: str, bits: int = BITS) -> "Bloom":
        """Over all non-null values. At most ``bits / 64`` numbers come to the driver."""
        place = df.filter(F.col(column).isNotNull()).select(_place(F.col(column), bits).alias("place"))
        set_ = place.groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        words = [0] * (bits // 64)
        for row in set_.collect():
            words[row["word"]] = row["bits"]
        return Bloom(tuple(words))

    def column(self) -> Column:
        """The bits as an array, from a subquery of one row. A literal would be spelled out in every
        description of a plan, of which the driver makes one per finished stage."""
        row = pa.table({"bits": pa.array([self.words], pa.list_(pa.int64()))})
        return SparkSession.active().createDataFrame(row).scalar()

    def test(self, text: Column, bits: Column) -> Column:
        """False only for texts that were not put in; ``bits`` is ``column()`` or a column that holds it."""
        place = _place(text, 64 * len(self.words))
        return F.getbit(F.get(bits, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

    def holds(self, texts: list[str]) -> np.ndarray:
        """``test`` for many texts inside a task; ``F.xxhash64`` is XXH64 with seed 42."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(t or "", 42) for t in texts), np.uint64, len(texts))
        place = hashes.view(np.int64) % (64 * len(self.words))
        bits = np.array(self.words, np.int64).view(np.uint64)
        return (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
