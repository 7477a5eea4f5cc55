import json

from pyspark.sql import functions as F

from pairloom.functions import parse
from pairloom.functions.prompts import chat_text, student_prompt, teacher_prompt, training_prompt

LONG = "word " * 30
OBJECT = json.dumps({"tailored_resume": "r", "cover_letter": "c"})


def pair(value):
    return None if value is None else (value["tailored_resume"], value["cover_letter"])


def test_parse_pair_tiers(apply):
    cases = {
        OBJECT: ("r", "c"),
        json.dumps({"cover_letter": "c", "tailored_resume": "é\n\"q\""}): ("é\n\"q\"", "c"),
        '{"tailored_resume": "a\nb", "cover_letter": "c"}': ("a\nb", "c"),
        '{"tailored_resume": "a\\nb\n", "cover_letter": "c"}': ("a\\nb\n", "c"),
        OBJECT + " trailing": ("r", "c"),
        OBJECT + "]": ("r", "c"),
        "{'tailored_resume': 'a', 'cover_letter': 'b'}": (None, None),
        f"[{OBJECT}]": (None, None),
        '"text"': (None, None), "5": (None, None), "": (None, None), "nothing": (None, None),
        '{"tailored_resume": 5, "cover_letter": "c"}': (None, "c"),
        '{"tailored_resume": null, "cover_letter": ["c"]}': (None, None),
        '{"tailored_resume": "r"}': ("r", ""),
        '{"tailored_resume": "first", "tailored_resume": "last", "cover_letter": "c"}': ("last", "c"),
        f'"tailored_resume": {LONG} "cover_letter": {LONG}': (LONG.strip(), LONG.strip()),
        f'"cover_letter" {LONG} "tailored_resume" {LONG}': (None, None),
        '"tailored_resume" ' + "x" * 100 + ' "cover_letter" ' + "y" * 101: (None, None),
        '"tailored_resume" ' + "x" * 101 + ' "cover_letter" ' + "y" * 101: ("x" * 101, "y" * 101),
        '{"tailored_resume": "cut off': (None, None),
    }
    got = apply(parse.parse_pair(F.col("t")), *cases)
    assert [pair(g) for g in got] == list(cases.values())


def test_strict_json(apply):
    cases = {
        "{}": True, "[1]": True, '"x"': True, "{} {}": False, "{},{}": False, "": False,
        "{'a':1}": False, '{"a":1,}': False, '{"a":1}]': False, '{"a":"\n"}': False,
    }
    assert apply(parse.is_strict_json(F.col("t")), *cases) == list(cases.values())


def test_strip_fences(apply):
    cases = {
        "```json\n{}\n```": "{}", "```\n{}\n```": "{}", " {} ": "{}", "```json```{}": "{}",
        "{}```\n": "{}", "x ``` y": "x ``` y", "```JSON\n{}": "JSON\n{}",
    }
    assert apply(parse.strip_fences(F.col("t")), *cases) == list(cases.values())


def test_response_text(spark):
    schema = (
        "response struct<candidates: array<struct<content: struct<parts: array<struct<text: string>>>>>,"
        " text: string>"
    )
    part = lambda t: ({"parts": [{"text": t}]},)
    rows = [
        ((([part("a"), part("b")]), "x"),), (([], "x"),), ((None, "x"),),
        (([(None,)], "x"),), (([({"parts": []},)], "x"),), (None,),
    ]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(parse.response_text(F.col("response"))).collect()]
    assert got == ["a", "x", "x", None, None, None]


# text, its resume and letter, and both as ground truth
SECTIONS = [
    ("TAILORED RESUME:\nr\n\nCOVER LETTER:\nc", ("r", "c"), ("r", "c")),
    (" plain ", ("plain", ""), ("", "")),
    ("a COVER LETTER: b COVER LETTER: c", ("a", "b"), ("a", "b")),
    ("TAILORED RESUME: x TAILORED RESUME: y COVER LETTER:", ("x  y", ""), ("x  y", "")),
    ("TAILORED RESUME: only", ("TAILORED RESUME: only", ""), ("", "")),
    ("", ("", ""), ("", "")),
]


def test_split_sections(apply):
    got = apply(parse.split_sections(F.col("t")), *[text for text, _, _ in SECTIONS])
    assert [(g["resume"], g["letter"]) for g in got] == [whole for _, whole, _ in SECTIONS]


def test_ground_truth_is_empty_without_marker(apply):
    got = apply(parse.ground_truth(F.col("t")), *[text for text, _, _ in SECTIONS], None)
    assert [(g["resume"], g["letter"]) for g in got] == [truth for _, _, truth in SECTIONS] + [("", "")]


# instruction, then its resume, title, description and skills
INSTRUCTIONS = [
    (
        "RESUME:\nline one\nline two\n\nJOB POSTING:\nTitle: Dev\nDescription: Build\nthings\nSkills: sql\n\nGenerate it.",
        "line one\nline two\n\nJOB POSTING:", "Dev", "Buildthings  Generate it.", "sql",
    ),
    (
        "RESUME:\nknows Title: of kings\nmore\nDescription: a Description: b\nSkills: x Skills: y",
        "more", "of kings", "a", "x",
    ),
    ("intro\nTitle: t\nno section", "", "t", "", ""),
    ("", "", "", "", ""),
    (
        "RESUME: same line lost\nDescription:\nx\nRESUME:\nagain\nDescription: last\n\ny",
        "again", "", "last y", "",
    ),
]


def test_parse_instruction(apply):
    got = apply(parse.parse_instruction(F.col("t")), *[case[0] for case in INSTRUCTIONS])
    want = [dict(zip(("resume", "title", "description", "skills"), case[1:], strict=True)) for case in INSTRUCTIONS]
    assert [g.asDict() for g in got] == want


def test_prompt_round_trip_has_the_closing_line_in_the_description(spark):
    row = spark.createDataFrame(
        [("my resume", "Dev", "build", "sql")],
        "original_resume string, job_title string, job_description string, job_skills string",
    )
    got = row.select(parse.parse_instruction(training_prompt())).first()[0]
    assert got["resume"] == "my resume\n\nJOB POSTING:"
    assert (got["title"], got["skills"]) == ("Dev", "sql")
    assert got["description"].startswith("build") and got["description"].endswith("for this application.")


def test_skills_defaults(spark):
    rows = spark.createDataFrame(
        [(0, "r", "r", "t", "d", None), (1, "r", "r", "t", "d", "")],
        "i int, original_resume string, resume_text string, job_title string, job_description string, job_skills string",
    )
    got = rows.select("i", training_prompt(), student_prompt(), teacher_prompt()).orderBy("i").collect()
    says = [[("Skills: Not specified" in text) for text in row[1:]] for row in got]
    assert says == [[True, True, True], [False, True, False]]
    assert got[0][2].startswith("<|user|>\nYou are") and got[0][2].endswith("<|end|>\n<|assistant|>\n")
    assert '{\n    "tailored_resume": "PUT' in got[0][3]


def test_chat_text(spark):
    got = spark.range(1).select(chat_text(F.lit("q"), F.lit("a"))).first()[0]
    assert got == "<|user|>\nq<|end|>\n<|assistant|>\na<|end|>"
