"""Requests out, responses in: request lines, batches, parsing, outcomes, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.fixed_values import (
    BATCH_SIZE, MAX_OUTPUT_TOKENS, MIN_OUTPUT_CHARS, TEMPERATURE,
)
from pairloom.functions.parse import (
    is_json_object, json_fields, parse_pair, response_text, strip_fences,
)
from pairloom.functions.prompts import teacher_prompt
from pairloom.functions.text import let, strip
from pairloom.operators.clean import last_per_key
from pairloom.operators.rank import global_rank, running_total
from pairloom.sources.schemas import RESPONSE, RESPONSE_BODY

OUTCOMES = ("bad_line", "unknown_key", "no_text", "unparsable", "too_short", "ok")


def request_key(left: str = "resume_id", right: str = "job_id") -> Column:
    return F.concat(
        F.lit("resume_"), F.col(left).cast("string"),
        F.lit("_job_"), F.coalesce(F.col(right).cast("string"), F.lit("nan")),
    )


def requests(
    pairs: DataFrame,
    temperature: float = TEMPERATURE,
    max_output_tokens: int = MAX_OUTPUT_TOKENS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(key, request)`` per full pair, plus carried columns such as the batch."""
    part = F.struct(teacher_prompt().alias("text"))
    content = F.struct(F.array(part).alias("parts"), F.lit("user").alias("role"))
    config = F.struct(
        F.lit(temperature).cast("double").alias("temperature"),
        F.lit(max_output_tokens).cast("int").alias("max_output_tokens"),
    )
    request = F.struct(F.array(content).alias("contents"), config.alias("generation_config"))
    return pairs.select(request_key().alias("key"), request.alias("request"), *keep)


def request_json(requests_df: DataFrame) -> DataFrame:
    """Each request as one JSON line."""
    return requests_df.select("key", F.to_json(F.struct("key", "request")).alias("line"))


def assign_batches(df: DataFrame, order: list[str], size: int = BATCH_SIZE) -> DataFrame:
    """Consecutive batches of ``size`` rows, the last one short. Give it the narrow pair
    table and enrich afterwards: the ranked rows are written once to freeze them."""
    ranked = global_rank(df, order, "_rank")
    return ranked.withColumn("batch_id", F.expr(f"(_rank - 1) div {size}")).drop("_rank")


def pending(batched: DataFrame, done: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Rows whose batch has no stored result. ``done`` holds one small row per batch, so
    duplicates leave it first and Spark broadcasts it when it is measured as small."""
    return batched.join(done.select(batch).distinct(), batch, "left_anti")


def parse_lines(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Delivered lines to ``(key, response, bad_line)``. A line must be one JSON object;
    a missing key is empty. Blank lines are no lines."""
    parsed = let(
        strip(F.col(value)),
        lambda t: F.when(is_json_object(t), json_fields(t, "struct<" + _fields(RESPONSE) + ">")),
    )
    rows = lines.filter(strip(F.col(value)) != "").select(
        *keep, F.explode(F.array(parsed)).alias("line")
    )
    return rows.select(
        *keep,
        F.coalesce("line.key", F.lit("")).alias("key"),
        F.col("line.response").alias("response"),
        F.col("line").isNull().alias("bad_line"),
    )


def _fields(ddl: str) -> str:
    """``name type, ...`` to ``name: type, ...``, as struct<> writes it."""
    return ", ".join(part.replace(" ", ": ", 1) for part in ddl.split(", ", 1))


def delivered(
    from_files: DataFrame | None = None, inline: DataFrame | None = None
) -> DataFrame:
    """File lines and inline responses as one table, empty when there is neither.

    Inline rows are ``(key, response)``; rows without a response are not delivered.
    """
    parts = []
    if from_files is not None:
        parts.append(parse_lines(from_files))
    if inline is not None:
        parts.append(
            inline.filter(F.col("response").isNotNull()).select(
                F.coalesce("key", F.lit("")).alias("key"),
                F.col("response").cast(RESPONSE_BODY).alias("response"),
                F.lit(False).alias("bad_line"),
            )
        )
    if not parts:
        empty = f"key string, response {RESPONSE_BODY}, bad_line boolean"
        return SparkSession.active().createDataFrame([], empty)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def keyed_pairs(pairs: DataFrame, order: str | None = None) -> DataFrame:
    """``pairs`` with their request key, one row per key: with ``order`` the last row of a
    repeated key, without it keys are taken to be unique."""
    keyed = pairs.withColumn("key", request_key())
    return keyed if order is None else last_per_key(keyed, "key", order)


def with_outcome(
    responses: DataFrame, pairs: DataFrame, order: str | None = None,
    min_chars: int = MIN_OUTPUT_CHARS,
) -> DataFrame:
    """Every response with its pair, both outputs and one outcome label."""
    return judged(responses, keyed_pairs(pairs, order), min_chars=min_chars)


def judged(
    responses: DataFrame, keyed: DataFrame, keep: tuple[str, ...] = (),
    min_chars: int = MIN_OUTPUT_CHARS,
) -> DataFrame:
    """Responses with ``keep``, both outputs, an outcome label and what ``keyed`` has for the key.

    ``keyed`` has one row per ``key``. Lines without a usable key match no pair and may be very
    many, so they stay out of the join: they would all meet in one task. Parsing is done
    before the join, where rows are only responses.
    """
    pairs = keyed.withColumn("known", F.lit(True))

    def read(text: Column) -> Column:
        has_text = F.coalesce(text, F.lit("")) != ""
        return F.struct(
            has_text.alias("has_text"),
            F.when(has_text, parse_pair(strip_fences(text))).alias("pair"),
        )

    usable = (F.col("key") != "") & ~F.col("bad_line")
    parsed = responses.filter(usable).select(
        "key", *keep, F.inline(F.array(let(response_text(F.col("response")), read)))
    ).select(
        "key", *keep, "has_text",
        F.col("pair.tailored_resume").alias("tailored_resume"),
        F.col("pair.cover_letter").alias("cover_letter"),
    )
    short = (F.length("tailored_resume") < min_chars) | (F.length("cover_letter") < min_chars)
    outcome = (
        F.when(F.col("known").isNull(), "unknown_key")
        .when(~F.col("has_text"), "no_text")
        .when(F.col("tailored_resume").isNull() | F.col("cover_letter").isNull(), "unparsable")
        .when(short, "too_short")
        .otherwise("ok")
    )
    joined = (
        parsed.join(pairs, "key", "left")
        .withColumn("outcome", outcome).drop("known", "has_text")
    )
    keyless = responses.filter(~usable).select(
        "key", *keep, F.when(F.col("bad_line"), "bad_line").otherwise("unknown_key").alias("outcome")
    )
    return joined.unionByName(keyless, allowMissingColumns=True)


def generated(outcomes: DataFrame) -> DataFrame:
    """Accepted examples in their final columns, with the ingest time."""
    return outcomes.filter(F.col("outcome") == "ok").select(
        F.col("resume_id").try_cast("bigint").alias("resume_id"),
        F.col("job_id").try_cast("bigint").alias("job_id"),
        F.col("similarity_score").try_cast("double").alias("similarity_score"),
        F.col("resume_text").alias("original_resume"),
        "job_title", "job_description",
        F.coalesce("job_skills", F.lit("")).alias("job_skills"),
        "tailored_resume", "cover_letter",
        F.current_timestamp().alias("timestamp"),
    )


def rejected(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("outcome") != "ok")


def outcome_counts(outcomes: DataFrame, sent: Column) -> DataFrame:
    """Rows per outcome and their percentage of the pairs sent."""
    counts = outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("responses"))
    return counts.withColumn(
        "pct_of_sent", F.try_divide(F.col("responses").cast("double"), sent.cast("double")) * 100
    )


def ingest_summary(outcomes: DataFrame, sent: Column) -> DataFrame:
    """Success and failure in one row; null percentages when nothing was sent."""
    done = outcomes.agg(
        F.count_if(F.col("outcome") == "ok").alias("success_count"),
        F.count_if(F.col("outcome") != "ok").alias("fail_count"),
    )
    share = lambda c: F.try_divide(F.col(c).cast("double"), sent.cast("double")) * 100
    return done.select(
        "success_count", "fail_count",
        share("success_count").alias("success_pct"), share("fail_count").alias("fail_pct"),
    )


def batch_progress(batched: DataFrame, batch: str = "batch_id", kept: Column | None = None) -> DataFrame:
    """Kept rows per batch, the running total and the grand total of rows."""
    kept = F.lit(True) if kept is None else kept
    per_batch = batched.groupBy(batch).agg(
        F.count_if(kept).alias("processed"), F.count(F.lit(1)).alias("_rows")
    )
    total = per_batch.agg(F.sum("_rows").alias("total_rows"))
    return running_total(per_batch, batch, "processed").select(
        batch, "processed", "running_total", total.scalar().alias("total_rows")
    )
