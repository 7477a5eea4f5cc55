"""First-failure quality filter and its report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.fixed_values import (
    LENGTH_BOUNDS, MENTION_MESSAGE, MENTION_WORDS, MIN_PARAGRAPHS, NOVELTY_LIMIT,
    NOVELTY_STOP_WORDS, REQUIRED_FIELDS, STRUCTURE_MESSAGE,
)
from pairloom.functions.text import let, mentions_any, novel_word_ratio, paragraphs
from pairloom.session import stored


def required_fields(fields: Iterable[str] = REQUIRED_FIELDS) -> Column:
    """Message naming the null or empty fields in order; null when all are there."""
    missing = F.filter(
        F.array(*[
            F.when(F.coalesce(F.col(f), F.lit("")) == "", F.lit(f"'{f}'")) for f in fields
        ]),
        lambda f: f.isNotNull(),
    )
    return let(
        missing,
        lambda m: F.when(
            F.size(m) > 0,
            F.concat(F.lit("Missing fields: ["), F.array_join(m, ", "), F.lit("]")),
        ),
    )


def length_between(column: str, least: int, most: int, label: str) -> Column:
    """Message with the length when it is outside the inclusive bounds."""
    chars = F.coalesce(F.length(column), F.lit(0))

    def message(word: str) -> Column:
        return F.concat(F.lit(f"{label} {word} ("), chars.cast("string"), F.lit(" chars)"))

    return F.when(chars < least, message("too short")).when(chars > most, message("too long"))


def novelty(
    original: str, rewritten: str, limit: float = NOVELTY_LIMIT,
    stop_words: Iterable[str] = NOVELTY_STOP_WORDS,
) -> Column:
    """Message with the share of new words when it is over the limit."""
    return let(
        novel_word_ratio(F.col(original), F.col(rewritten), stop_words),
        lambda share: F.when(
            share > F.lit(float(limit)),
            F.concat(
                F.lit("Possible hallucination: "),
                F.format_string("%.1f", F.bround(share * 100, 1)),
                F.lit("% new words"),
            ),
        ),
    )


def min_paragraphs(column: str, least: int = MIN_PARAGRAPHS) -> Column:
    return F.when(paragraphs(F.col(column)) < least, F.lit(STRUCTURE_MESSAGE))


def mention(column: str, words: Iterable[str] = MENTION_WORDS) -> Column:
    return F.when(~mentions_any(F.col(column), words), F.lit(MENTION_MESSAGE))


def first_issue() -> Column:
    """The first failed check of a generated example; null means valid.

    ``coalesce`` stops at the first message, so the costly checks run last and only
    on rows that passed the cheap ones.
    """
    return F.coalesce(
        required_fields(),
        *[length_between(*bound) for bound in LENGTH_BOUNDS],
        novelty("original_resume", "tailored_resume"),
        min_paragraphs("cover_letter"),
        mention("cover_letter"),
    )


def issue_kind(issue: Column) -> Column:
    """The message without its numbers and field list, for grouping."""
    short = F.regexp_replace(issue, r" \(\d+ chars\)\z", "")
    return F.regexp_replace(short, r":.*\z", "")


def labelled(examples: DataFrame) -> DataFrame:
    """Examples with ``issue``. The generator keeps the cascade at one run per row, also
    when filters on ``issue`` follow."""
    return examples.select("*", F.explode(F.array(first_issue())).alias("issue"))


def valid(labelled_df: DataFrame) -> DataFrame:
    return labelled_df.filter(F.col("issue").isNull()).drop("issue")


def invalid(labelled_df: DataFrame) -> DataFrame:
    """Rejected rows with their original index and a one-entry issue list."""
    return labelled_df.filter(F.col("issue").isNotNull()).withColumn("issues", F.array("issue"))


def counts(labelled_df: DataFrame) -> DataFrame:
    return labelled_df.agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.count_if(F.col("issue").isNull()).alias("valid_count"),
        F.count_if(F.col("issue").isNotNull()).alias("invalid_count"),
    ).withColumn(
        "valid_percentage",
        F.try_divide(F.col("valid_count").cast("double"), F.col("total_examples").cast("double")) * 100,
    )


def histogram(labelled_df: DataFrame) -> DataFrame:
    return (
        labelled_df.filter(F.col("issue").isNotNull())
        .groupBy("issue").agg(F.count(F.lit(1)).alias("examples"))
        .withColumn("issue_kind", issue_kind(F.col("issue")))
    )


def top_issues(labelled_df: DataFrame, n: int = 10) -> DataFrame:
    return histogram(labelled_df).orderBy(F.desc("examples"), "issue").limit(n)


def first_invalid(labelled_df: DataFrame, order: str, n: int = 10) -> DataFrame:
    return invalid(labelled_df).orderBy(order).limit(n)


def valid_length_stats(labelled_df: DataFrame) -> DataFrame:
    """Mean, least and greatest length of the two outputs over the valid rows."""
    aggregates = [
        f(F.length(c)).alias(f"{short}_{name}")
        for c, short in (("tailored_resume", "resume"), ("cover_letter", "letter"))
        for f, name in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))
    ]
    return valid(labelled_df).agg(*aggregates)


def report(labelled_df: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The one nested report record: counts, reasons and the first ``n`` rejected rows.

    Reasons are a map of the kind of issue to its count: one entry per check. Messages with their
    lengths may be very many; they are the rows of ``histogram``. The cascade runs once, as
    its result is written first.
    """
    labelled_df = stored(labelled_df, "labelled")
    reasons = (
        labelled_df.filter(F.col("issue").isNotNull())
        .groupBy(issue_kind(F.col("issue")).alias("kind")).agg(F.count(F.lit(1)).alias("examples"))
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "examples")))).alias("r"))
    )
    columns = [c for c in labelled_df.columns if c not in ("issue", order)]
    examples = first_invalid(labelled_df, order, n).agg(
        F.sort_array(
            F.collect_list(
                F.struct(F.col(order).alias("index"), "issues", F.struct(*columns).alias("example"))
            )
        ).alias("e")
    )
    return counts(labelled_df).select(
        "*", reasons.scalar().alias("failure_reasons"), examples.scalar().alias("invalid_examples")
    )
