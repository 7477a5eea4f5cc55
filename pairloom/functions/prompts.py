"""Prompt, completion and chat texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.fixed_values import (
    CHAT_OPENING, CHAT_TEMPLATE, COMPLETION_TEMPLATE, NOT_SPECIFIED, TEACHER_TEMPLATE,
    TRAINING_TEMPLATE,
)
from pairloom.functions.text import render


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def teacher_prompt() -> Column:
    """Request text for a full pair; null skills print as not specified."""
    return render(
        TEACHER_TEMPLATE,
        resume_text=_text("resume_text"), job_title=_text("job_title"),
        job_description=_text("job_description"),
        job_skills=F.coalesce("job_skills", F.lit(NOT_SPECIFIED)),
    )


def _training_fields(skills: Column) -> dict[str, Column]:
    return {
        "original_resume": _text("original_resume"), "job_title": _text("job_title"),
        "job_description": _text("job_description"), "job_skills": skills,
    }


def training_prompt() -> Column:
    """Skills print as they are when empty; null stands for a missing key."""
    return render(
        TRAINING_TEMPLATE, **_training_fields(F.coalesce("job_skills", F.lit(NOT_SPECIFIED)))
    )


def training_completion() -> Column:
    return render(
        COMPLETION_TEMPLATE, tailored_resume=_text("tailored_resume"),
        cover_letter=_text("cover_letter"),
    )


def student_prompt() -> Column:
    """Inference prompt with chat tags; null and empty skills both print as not specified."""
    skills = F.coalesce(F.nullif("job_skills", F.lit("")), F.lit(NOT_SPECIFIED))
    return render(CHAT_OPENING, instruction=render(TRAINING_TEMPLATE, **_training_fields(skills)))


def chat_text(instruction: Column, output: Column) -> Column:
    return render(CHAT_TEMPLATE, instruction=instruction, output=output)
