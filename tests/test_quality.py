import re

import pytest
from pyspark.sql import functions as F

from pairloom.fixed_values import NOVELTY_STOP_WORDS
from pairloom.operators import quality

WORDS = [f"{a}{b}" for a in ("alpha", "bravo", "carol", "delta", "eagle", "fancy") for b in "abcdefghij"]
TEXT = " ".join(WORDS)
LETTER = ("Dear all, " + "x" * 200) + "\n\n" + "I like this role."
BASE = {
    "original_resume": TEXT, "job_title": "dev", "job_description": "d" * 100,
    "tailored_resume": TEXT, "cover_letter": LETTER,
}


def novel(share_new, total=10):
    """Long text whose word set has ``share_new`` unknown words among ``total``."""
    words = WORDS[: total - share_new] + [f"unknown{c}" for c in "abcdefghij"[:share_new]]
    return " ".join(words * 5)


CASES = [
    ({}, None),
    ({"job_title": ""}, "Missing fields: ['job_title']"),
    ({"job_title": None, "cover_letter": ""}, "Missing fields: ['job_title', 'cover_letter']"),
    ({"original_resume": "x" * 199}, "Original resume too short (199 chars)"),
    ({"original_resume": "x" * 20001}, "Original resume too long (20001 chars)"),
    ({"tailored_resume": "x" * 199, "cover_letter": "y"}, "Tailored resume too short (199 chars)"),
    ({"cover_letter": "x" * 3001}, "Cover letter too long (3001 chars)"),
    ({"cover_letter": "x" * 3000}, "Cover letter lacks structure (too few paragraphs)"),
    ({"job_description": "x" * 99}, "Job description too short (99 chars)"),
    ({"job_description": "x" * 15001}, "Job description too long (15001 chars)"),
    ({"tailored_resume": novel(3)}, None),
    ({"tailored_resume": novel(4)}, "Possible hallucination: 40.0% new words"),
    ({"tailored_resume": "1 " * 150}, None),
    ({"cover_letter": "a" * 150 + "\n\n" + "b" * 150}, "Cover letter doesn't mention position/role"),
    ({"cover_letter": "a" * 150 + "\n\n" + "b" * 150 + " TEAMWORK"}, None),
    ({"cover_letter": "a role " * 40 + "\n\n  \n\n"}, "Cover letter lacks structure (too few paragraphs)"),
]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i,) + tuple({**BASE, **change}.values()) for i, (change, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "idx bigint, " + ", ".join(f"{c} string" for c in BASE))
    return quality.labelled(df.repartition(3)).cache()


def test_first_issue(labelled):
    got = {r["idx"]: r["issue"] for r in labelled.collect()}
    assert got == {i: issue for i, (_, issue) in enumerate(CASES)}


def test_percentage_text_is_pythons(spark):
    """Shares n/m over a grid, against Python's formatting."""
    rows = [(n, m) for m in range(1, 90) for n in range(m + 1) if n / m > 0.3]
    df = spark.createDataFrame(rows, "n int, m int")
    share = F.col("n").cast("double") / F.col("m")
    shown = df.select("n", "m", F.format_string("%.1f", F.bround(share * 100, 1)).alias("s")).collect()
    assert [r["s"] for r in shown] == [f"{r['n'] / r['m'] * 100:.1f}" for r in shown]


def test_routing_and_counts(labelled):
    bad = [i for i, (_, issue) in enumerate(CASES) if issue]
    assert sorted(r["idx"] for r in quality.invalid(labelled).collect()) == bad
    assert quality.valid(labelled).count() == len(CASES) - len(bad)
    assert all(len(r["issues"]) == 1 for r in quality.invalid(labelled).collect())
    row = quality.counts(labelled).first()
    assert (row["total_examples"], row["invalid_count"]) == (len(CASES), len(bad))
    assert [r["idx"] for r in quality.first_invalid(labelled, "idx").collect()] == bad[:10]


def test_histogram(labelled):
    counts = {r["issue"]: (r["examples"], r["issue_kind"]) for r in quality.histogram(labelled).collect()}
    assert counts["Cover letter lacks structure (too few paragraphs)"] == (2, "Cover letter lacks structure (too few paragraphs)")
    assert counts["Missing fields: ['job_title']"] == (1, "Missing fields")
    assert counts["Original resume too short (199 chars)"] == (1, "Original resume too short")
    assert counts["Possible hallucination: 40.0% new words"][1] == "Possible hallucination"
    top = quality.top_issues(labelled).collect()
    assert len(top) == 10 and top[0]["examples"] == 2


def test_empty_input_gives_null_percentage(labelled):
    row = quality.counts(labelled.limit(0)).first()
    assert row["total_examples"] == 0 and row["valid_percentage"] is None


def test_length_stats(labelled):
    row = quality.valid_length_stats(labelled).first()
    lengths = [len({**BASE, **c}["tailored_resume"]) for c, issue in CASES if issue is None]
    assert (row["resume_min"], row["resume_max"]) == (min(lengths), max(lengths))
    assert row["resume_mean"] == pytest.approx(sum(lengths) / len(lengths))


def test_report_record(labelled):
    row = quality.report(labelled, "idx").first()
    kinds = [re.sub(r" \(\d+ chars\)$|:.*$", "", issue) for _, issue in CASES if issue]
    assert row["failure_reasons"] == {k: kinds.count(k) for k in kinds}
    first = row["invalid_examples"][0]
    assert (first["index"], first["issues"]) == (1, [CASES[1][1]])
    assert first["example"]["original_resume"] == TEXT
    assert len(row["invalid_examples"]) == 10


def test_novelty_uses_its_own_stop_words():
    assert "they" in NOVELTY_STOP_WORDS and "more" not in NOVELTY_STOP_WORDS
    assert len(NOVELTY_STOP_WORDS) == 18 and all(re.fullmatch("[a-z]{4,}", w) for w in NOVELTY_STOP_WORDS)
