"""Columns around a model call: prompts in, marked sections out. The call is not here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.parse import ground_truth, parse_instruction, split_sections
from pairloom.functions.prompts import student_prompt


def model_inputs(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Instruction records back to resume, title, description and skills, with the
    tagged prompt rebuilt from them."""
    parsed = records.select(
        *keep, "output", "metadata",
        F.inline(F.array(parse_instruction(F.col("instruction")))),
    )
    return parsed.select(
        *keep,
        F.col("metadata.resume_id").alias("resume_id"), F.col("metadata.job_id").alias("job_id"),
        F.col("resume").alias("original_resume"), F.col("title").alias("job_title"),
        F.col("description").alias("job_description"), F.col("skills").alias("job_skills"),
        "output",
    ).withColumn("prompt", student_prompt())


def results(inputs: DataFrame, generated_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Result records: model text and ground truth, both cut into resume and letter.

    ``job_description`` is kept so that evaluation can use the whole target text.
    """
    cut = F.struct(
        split_sections(F.col(generated_col)).alias("made"), ground_truth(F.col("output")).alias("truth")
    )
    return inputs.select("*", F.inline(F.array(cut))).select(
        *keep, "resume_id", "job_id", "original_resume", "job_title", "job_description",
        F.col("made.resume").alias("tailored_resume"), F.col("made.letter").alias("cover_letter"),
        F.col("truth.resume").alias("ground_truth_resume"),
        F.col("truth.letter").alias("ground_truth_cover_letter"),
    )
