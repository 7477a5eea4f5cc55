"""Roles of the operators' inputs, derived by Spark from the given tables.

Whole tables, whole texts: documents stand for resumes, pages for job postings, a
user turn with the assistant turn behind it for a model exchange. A turn nobody answered
and a document nobody asked about stay, as pairs without an answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.sources.tables import read_table

BAD_TURN = 4
# Turn of a document that no exchange picks
UNASKED = -1


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt by a unique key: the driver's tables may be one file of one row group."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *key)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "documents"), "doc_id")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "pages"), "page_id")


def resumes(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        F.col("doc_id").alias("ID"), F.col("text").alias("Resume_str"), F.col("lang").alias("Category")
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select(
        F.col("page_id").alias("job_id"), F.col("url").alias("title"),
        F.col("html").alias("description"), F.lit(None).cast("string").alias("company_name"),
        F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("skills_desc"),
        F.lit("any").alias("formatted_experience_level"),
    )


def exchanges(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with the assistant turn that follows, null where none does."""
    turns = spread(read_table(spark, folder, "conversations"), "conv_id", "turn")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("user_text")
    )
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_text")
    )
    return asked.join(answered, ["conv_id", "turn"], "left")


def pair_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of base and the numbers of its two documents, without a text."""
    ids = read_table(spark, folder, "documents").select(F.col("doc_id").alias("own_id"))
    total = F.lit(max(ids.count(), 1))
    turns = read_table(spark, folder, "conversations").filter(F.col("role") == "user").select("conv_id", "turn")
    picked = turns.withColumn("own_id", F.pmod(F.col("conv_id") * 7 + F.col("turn"), total))
    return picked.join(ids, "own_id", "full").select(
        F.coalesce("conv_id", "own_id").alias("resume_id"),
        F.coalesce("turn", F.lit(UNASKED)).cast("long").alias("job_id"),
        "own_id", F.pmod(F.col("own_id") + 1, total).alias("next_id"),
    )


def base(spark: SparkSession, folder: str, more: DataFrame | None = None) -> DataFrame:
    """Exchanges with two documents each, picked by conversation and turn together, so
    that a very long conversation spreads over all documents; then every document that
    none of them picks, with the next one, under its own number and turn UNASKED.

    ``more`` holds further narrow columns by ``resume_id`` and ``job_id``; it meets the keys in an inner join
    before any text does."""
    docs = read_table(spark, folder, "documents")
    own = docs.select(
        F.col("doc_id").alias("own_id"), F.col("text").alias("original_resume"),
        F.col("source").alias("job_title"), F.col("lang").alias("lang"),
    )
    following = docs.select(F.col("doc_id").alias("next_id"), F.col("text").alias("job_description"))
    # lengths are taken here, so that who needs no turn's text moves none
    user = F.length(F.coalesce("user_text", F.lit("")))
    turns = exchanges(spark, folder).withColumnsRenamed({"conv_id": "resume_id", "turn": "job_id"}).select(
        "*", user.alias("user_chars"), (user + F.length(F.coalesce("assistant_text", F.lit("")))).alias("both_chars"))
    keys, added = pair_keys(spark, folder), []
    if more is not None:
        keys, added = keys.join(more, ["resume_id", "job_id"]), [c for c in more.columns if c not in ("resume_id", "job_id")]
    return (
        keys
        .join(turns, ["resume_id", "job_id"], "left")
        .join(own, "own_id", "left").join(following, "next_id", "left")
        .select(
            "resume_id", "job_id",
            F.when(F.col("both_chars") > 0, F.round(F.col("user_chars") / F.col("both_chars"), 6)).otherwise(0.0).alias("similarity_score"),
            "original_resume", "job_title", "job_description",
            F.when(F.col("lang") != "en", F.col("lang")).alias("job_skills"),
            "user_text", "assistant_text",
            (F.col("resume_id") * (1 << 32) + F.col("job_id")).alias("idx"), *added,
        )
    )


def full_pairs(spark: SparkSession, folder: str, more: DataFrame | None = None) -> DataFrame:
    return base(spark, folder, more).withColumnRenamed("original_resume", "resume_text").drop(
        "user_text", "assistant_text"
    )


def response_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One delivered line per pair; the conversation number picks the form. A pair without
    an answer is delivered without a text."""
    rows = base(spark, folder)
    made = F.concat("user_text", F.lit(" "), "assistant_text", F.lit("\nend"))
    letter = F.col("assistant_text")
    whole = F.to_json(F.struct(made.alias("tailored_resume"), letter.alias("cover_letter")))
    short = F.to_json(F.struct(F.lit("short").alias("tailored_resume"), letter.alias("cover_letter")))
    form = F.col("resume_id") % 8
    text = (
        F.when(form == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(
            form == 2,
            F.concat(F.lit('{"tailored_resume": "'), made, F.lit('", "cover_letter": "'), letter, F.lit('"}')),
        )
        .when(form == 3, F.concat(F.lit('"tailored_resume" '), made, F.lit(' "cover_letter" '), letter))
        .when(form == 4, F.concat(F.lit('{"tailored_resume": "'), made))
        .when(form == 7, short)
        .otherwise(whole)
    )
    key = F.concat(
        F.when(form == 6, "x").otherwise(""), F.lit("resume_"), F.col("resume_id").cast("string"),
        F.lit("_job_"), F.col("job_id").cast("string"),
    )
    given = F.when(letter.isNotNull(), text)
    candidate = F.struct(
        F.struct(F.array(F.struct(given.alias("text"))).alias("parts")).alias("content")
    )
    response = F.struct(F.when(form != 5, F.array(candidate)).alias("candidates"))
    line = F.to_json(F.struct(key.alias("key"), response.alias("response")))
    return rows.select(
        F.when(F.col("job_id") == BAD_TURN, F.concat(key, F.lit(" not json"))).otherwise(line).alias("value")
    )


def examples(spark: SparkSession, folder: str) -> DataFrame:
    """Generated examples: even conversations repeat the original, odd ones are new text.
    For a document that no exchange picks the next one stands for the answer."""
    even = F.col("resume_id") % 2 == 0
    rows = base(spark, folder).withColumn(
        "answer", F.when(F.col("job_id") == UNASKED, F.col("job_description")).otherwise(F.col("assistant_text"))
    )
    letter = F.concat(
        F.when(F.col("job_id") == 0, F.replace("answer", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("answer")),
        F.when(F.col("resume_id") % 3 != 0, "\n\nThis role fits me.").otherwise(""),
    )
    return rows.select(
        "idx", "resume_id", "job_id", "similarity_score", "original_resume",
        F.when(F.col("resume_id") % 10 == 7, "").otherwise(F.col("job_title")).alias("job_title"),
        "job_description", "job_skills",
        F.when(even, F.col("original_resume")).otherwise(F.col("answer")).alias("tailored_resume"),
        letter.alias("cover_letter"),
    )


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Result records: the answer predicts the question, the question the answer."""
    return base(spark, folder).select(
        "idx", "resume_id", "job_id", "original_resume", "job_title", "job_description",
        F.col("assistant_text").alias("tailored_resume"), F.col("user_text").alias("cover_letter"),
        F.col("user_text").alias("ground_truth_resume"),
        F.col("assistant_text").alias("ground_truth_cover_letter"),
    )


def baseline_results(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline run repeats the job description for every pair."""
    return results(spark, folder).withColumn(
        "tailored_resume", F.coalesce("job_description", F.lit(""))
    )
