"""Clean and gate text tables, drop exact copies, count the stages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.fixed_values import (
    CLEAN_MIN_CHARS, LEFT_MIN_HITS, RIGHT_MIN_HITS, TECH_KEYWORDS,
)
from pairloom.functions.bloom import Bloom
from pairloom.functions.text import clean_text, concat_text, keyword_hits, longer_than
from pairloom.session import stored


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def _copied(df: DataFrame, value: str) -> Column:
    """False only for rows whose ``value`` no other row has."""
    text = F.xxhash64(F.col(value)).cast("string")
    counts = df.groupBy(text.alias("hash")).agg(F.count(F.lit(1)).alias("rows"))
    repeated = Bloom.of(counts.filter("rows > 1"), "hash")
    return repeated.test(text, repeated.column())


def dedup_keep_first(df: DataFrame, value: str, order: str) -> DataFrame:
    """Exact duplicates of ``value`` out, the row with the least ``order`` stays.

    Narrow first: rows are counted by a 64-bit hash of the value, combined before the shuffle, and
    hashes found more than once go into a Bloom filter of fixed size. Rows that it does not know have no
    copy and stay where they are. Only the others are aggregated whole, by SHA-256, combined before the shuffle:
    a text with a third of all rows as copies is one row per task there. ``df`` is read three times
    and should be stored where it is costly. A null ``order`` comes last; a repeated one still gives one row
    per text. Null texts are copies of each other.
    """
    copied = _copied(df, value)
    place = F.struct(F.col(order).isNull(), F.col(order))
    kept = F.min_by(F.struct(*[F.col(c) for c in df.columns]), place)
    first = df.filter(copied).groupBy(F.sha2(F.col(value), 256).alias("_hash")).agg(kept.alias("_kept")).select("_kept.*")
    return df.filter(~copied).unionByName(first)


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order``; a null ``order`` comes first. Rows
    without a key stay as they are."""
    place = F.struct(F.col(order).isNotNull(), F.col(order))
    kept = F.max_by(F.struct(*[F.col(c) for c in df.columns]), place)
    last = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(kept.alias("_kept")).select("_kept.*")
    return last.unionByName(df.filter(F.col(key).isNull()))


def clean_left(
    df: DataFrame,
    id_col: str = "ID",
    text_col: str = "Resume_str",
    keywords: Iterable[str] = TECH_KEYWORDS,
    min_chars: int = CLEAN_MIN_CHARS,
    min_hits: int = LEFT_MIN_HITS,
    dedup: bool = True,
) -> DataFrame:
    """Prune, clean, length filter, keyword gate, dedup by text.

    The gate sits inside the generator, so cleaning runs once per row; as a plain
    filter it would be pushed below the projection and run again for each condition.
    """
    keywords = list(keywords)
    kept = F.filter(
        F.array(clean_text(F.col(text_col))),
        lambda t: longer_than(t, min_chars) & (keyword_hits(t, keywords) >= min_hits),
    )
    rows = df.select(id_col, F.explode(kept).alias(text_col))
    return dedup_keep_first(stored(rows, "cleaned"), text_col, id_col) if dedup else rows


def clean_right(
    df: DataFrame,
    id_col: str = "job_id",
    cleaned: tuple[str, str, str] = ("title", "description", "skills_desc"),
    carried: tuple[str, ...] = ("company_name", "location", "formatted_experience_level"),
    keywords: Iterable[str] = TECH_KEYWORDS,
    min_chars: int = CLEAN_MIN_CHARS,
    min_hits: int = RIGHT_MIN_HITS,
    dedup: bool = True,
) -> DataFrame:
    """As ``clean_left`` for three cleaned columns: the length filter and the dedup
    look at the second one, the gate at all three joined."""
    keywords = list(keywords)
    body = cleaned[1]
    kept = F.filter(
        F.array(F.struct(*[clean_text(F.col(c)).alias(c) for c in cleaned])),
        lambda r: longer_than(r[body], min_chars)
        & (keyword_hits(concat_text(*[r[c] for c in cleaned]), keywords) >= min_hits),
    )
    rows = df.select(id_col, *carried, F.inline(kept)).select(id_col, *cleaned, *carried)
    return dedup_keep_first(stored(rows, "cleaned"), body, id_col) if dedup else rows


def stage_counts(
    df: DataFrame,
    text_col: str,
    keywords: Iterable[str] = TECH_KEYWORDS,
    min_chars: int = CLEAN_MIN_CHARS,
    min_hits: int = LEFT_MIN_HITS,
) -> DataFrame:
    """Rows at each stage, in one pass: all, long enough, gated, distinct after the gate."""
    keywords = list(keywords)
    marks = F.transform(
        F.array(clean_text(F.col(text_col))),
        lambda t: F.struct(
            longer_than(t, min_chars).alias("long"),
            (longer_than(t, min_chars) & (keyword_hits(t, keywords) >= min_hits)).alias("gated"),
            F.sha2(t, 256).alias("hash"),
        ),
    )
    return df.select(F.inline(marks)).agg(
        F.count(F.lit(1)).alias("original"),
        F.count_if("long").alias("after_length"),
        F.count_if("gated").alias("after_gate"),
        F.count_distinct(F.when(F.col("gated"), F.col("hash"))).alias("after_dedup"),
    )


def potential_pairs(left_counts: DataFrame, right_counts: DataFrame) -> DataFrame:
    """The left stage counts with the product of both final counts."""
    right_rows = right_counts.select("after_dedup").scalar()
    return left_counts.withColumn("potential_pairs", F.col("after_dedup") * right_rows)
