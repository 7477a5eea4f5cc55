"""Reading model output: response bodies, messy JSON, marked sections, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.fixed_values import LETTER_MARKER, MIN_OUTPUT_CHARS, RESUME_MARKER
from pairloom.functions.text import SPACE, let, strip

STRICT_JSON = {"allowSingleQuotes": "false"}

RESUME_KEY = '"tailored_resume"'
LETTER_KEY = '"cover_letter"'
RESUME_VALUE = rf'(?sU){RESUME_KEY}{SPACE}*:{SPACE}*"(.*?)"(?:,|{SPACE}*\}})'
LETTER_VALUE = rf'(?sU){LETTER_KEY}{SPACE}*:{SPACE}*"(.*?)"(?:{SPACE}*\}})'


def is_strict_json(c: Column) -> Column:
    """Exactly one JSON value. ``from_json`` alone stops at the end of the first value
    and takes single quotes; a second, known value behind shows nothing was skipped."""
    values = F.from_json(F.concat(F.lit("["), c, F.lit(",0]")), "array<string>", STRICT_JSON)
    return F.coalesce(F.size(values) == 2, F.lit(False))


def is_json_object(c: Column) -> Column:
    return is_strict_json(c) & F.startswith(F.ltrim(c), F.lit("{"))


def json_fields(c: Column, schema: str) -> Column:
    """Fields of a JSON object that ``is_json_object`` has accepted."""
    return F.get(
        F.from_json(F.concat(F.lit("["), c, F.lit("]")), f"array<{schema}>", STRICT_JSON), F.lit(0)
    )


def response_text(response: Column) -> Column:
    """Text of the first candidate; ``text`` counts only without any candidate."""
    candidates = response["candidates"]
    first = F.get(F.get(candidates, F.lit(0))["content"]["parts"], F.lit(0))["text"]
    return F.when(F.coalesce(F.size(candidates), F.lit(0)) > 0, first).otherwise(response["text"])


def strip_fences(c: Column) -> Column:
    """Strip, drop a leading json fence, then a leading and a trailing plain fence, strip."""
    inner = F.regexp_replace(strip(c), r"\A```json", "")
    inner = F.regexp_replace(F.regexp_replace(inner, r"\A```", ""), r"```\z", "")
    return strip(inner)


def _by_json(t: Column) -> Column:
    """Tier 1. A missing value is empty; a value that is no string gives null."""
    fields = json_fields(t, "struct<tailored_resume: variant, cover_letter: variant>")

    def value(v: Column) -> Column:
        return F.when(v.isNull(), F.lit("")).when(
            F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")
        )

    return let(
        fields,
        lambda f: F.struct(
            value(f["tailored_resume"]).alias("tailored_resume"),
            value(f["cover_letter"]).alias("cover_letter"),
        ),
    )


def _by_pattern(t: Column) -> Column:
    """Tier 2. Raw text between the quotes, escapes left as they are."""
    return F.when(
        F.rlike(t, F.lit(RESUME_VALUE)) & F.rlike(t, F.lit(LETTER_VALUE)),
        F.struct(
            F.regexp_extract(t, RESUME_VALUE, 1).alias("tailored_resume"),
            F.regexp_extract(t, LETTER_VALUE, 1).alias("cover_letter"),
        ),
    )


def _by_keys(t: Column) -> Column:
    """Tier 3. What stands between and behind the keys, both parts over the minimum."""

    def trim(c: Column) -> Column:
        return F.regexp_replace(F.coalesce(c, F.lit("")), r'\A[ :,"{}]+|[ :,"{}]+\z', "")

    after = F.get(F.split(t, RESUME_KEY), F.lit(1))
    parts = F.split(after, LETTER_KEY)
    found = let(
        parts,
        lambda p: F.struct(
            trim(F.get(p, F.lit(0))).alias("tailored_resume"),
            trim(F.get(p, F.lit(1))).alias("cover_letter"),
        ),
    )
    return let(
        found,
        lambda f: F.when(
            (F.length(f["tailored_resume"]) > MIN_OUTPUT_CHARS)
            & (F.length(f["cover_letter"]) > MIN_OUTPUT_CHARS),
            f,
        ),
    )


def parse_pair(c: Column) -> Column:
    """``struct<tailored_resume, cover_letter>`` from response text, by three tiers.

    Valid JSON never falls through to the text tiers. Fields of the result are null
    when nothing could be read.
    """
    nothing = F.struct(
        F.lit(None).cast("string").alias("tailored_resume"),
        F.lit(None).cast("string").alias("cover_letter"),
    )
    parsed = let(
        c,
        lambda t: F.when(is_json_object(t), _by_json(t)).when(is_strict_json(t), nothing)
        .otherwise(F.coalesce(_by_pattern(t), _by_keys(t))),
    )
    return F.coalesce(parsed, nothing)


def split_sections(c: Column) -> Column:
    """``struct<resume, letter>``: before the first letter marker without the resume
    markers, and between the first and second one. Without a marker all text is resume."""

    def cut(t: Column) -> Column:
        parts = F.split(t, LETTER_MARKER)
        marked = F.contains(t, F.lit(LETTER_MARKER))
        resume = strip(F.replace(F.get(parts, F.lit(0)), F.lit(RESUME_MARKER), F.lit("")))
        return F.struct(
            F.when(marked, resume).otherwise(t).alias("resume"),
            F.when(marked, strip(F.get(parts, F.lit(1)))).otherwise("").alias("letter"),
        )

    return let(strip(c), cut)


def ground_truth(c: Column) -> Column:
    """As ``split_sections``, but both parts are empty without a marker."""
    c = F.coalesce(c, F.lit(""))
    empty = F.struct(F.lit("").alias("resume"), F.lit("").alias("letter"))
    return F.when(F.contains(c, F.lit(LETTER_MARKER)), split_sections(c)).otherwise(empty)


def parse_instruction(c: Column) -> Column:
    """``struct<resume, title, description, skills>`` read line by line from a prompt.

    A fold over the lines. The first marker a line contains, in the order below,
    decides; a line without one is added to the open section. Title and skills lines
    do not close a section. Pieces are collected in arrays and joined once.
    """
    state = F.struct(
        F.lit("").alias("section"),
        F.array().cast("array<string>").alias("resume"),
        F.lit("").alias("title"),
        F.array().cast("array<string>").alias("description"),
        F.lit("").alias("skills"),
    )

    def after(line: Column, marker: str) -> Column:
        return strip(F.get(F.split(line, marker), F.lit(1)))

    def step(s: Column, line: Column) -> Column:
        def put(**changes: Column) -> Column:
            return F.struct(*[
                changes.get(name, s[name]).alias(name)
                for name in ("section", "resume", "title", "description", "skills")
            ])

        return (
            F.when(F.contains(line, F.lit("RESUME:")), put(section=F.lit("resume")))
            .when(F.contains(line, F.lit("Title:")), put(title=after(line, "Title:")))
            .when(
                F.contains(line, F.lit("Description:")),
                put(section=F.lit("description"),
                    description=F.array(after(line, "Description:"))),
            )
            .when(F.contains(line, F.lit("Skills:")), put(skills=after(line, "Skills:")))
            .when(s["section"] == "resume", put(resume=F.array_append(s["resume"], line)))
            .when(
                s["section"] == "description",
                put(description=F.array_append(s["description"], line)),
            )
            .otherwise(s)
        )

    def finish(s: Column) -> Column:
        # The description marker's own text is followed by no separator, later lines by one.
        head = F.coalesce(F.get(s["description"], F.lit(0)), F.lit(""))
        tail = F.array_join(F.slice(s["description"], F.lit(2), F.size(s["description"])), " ")
        return F.struct(
            strip(F.array_join(s["resume"], "\n")).alias("resume"),
            s["title"].alias("title"),
            strip(F.concat(head, tail)).alias("description"),
            s["skills"].alias("skills"),
        )

    return F.aggregate(F.split(F.coalesce(c, F.lit("")), "\n"), state, step, finish)
