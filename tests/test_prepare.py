import pytest
from pyspark.sql import functions as F

from pairloom.operators import infer, prepare
from pairloom.operators.prepare import chat_conversations
from pairloom.plans.curation import curate, prepare as prepare_files, write_requests
from pairloom.sources import schemas, tables

COLUMNS = ("idx bigint, resume_id bigint, job_id bigint, similarity_score double, original_resume string, "
           "job_title string, job_description string, job_skills string, tailored_resume string, cover_letter string")


@pytest.fixture(scope="module")
def examples(spark):
    rows = [(i, i, 7, 0.5, "old " * 60, "dev", "text " * 30, "sql", f"new {i}", "hello\n\nrole") for i in range(50)]
    return spark.createDataFrame(rows, COLUMNS)


def test_instruction_and_chat_records(examples):
    row = prepare.training_records(examples, "instruction").first()
    assert row["instruction"].startswith("You are an expert resume writer. Tailor")
    assert "Skills: sql\n\nGenerate a tailored" in row["instruction"]
    assert row["output"].startswith("TAILORED RESUME:\nnew 0\n\nCOVER LETTER:\nhello")
    assert row["metadata"].asDict() == {"resume_id": 0, "job_id": 7, "similarity_score": 0.5}
    chat = prepare.training_records(examples, "chat").first()
    assert [m["role"] for m in chat["messages"]] == ["user", "assistant"]
    assert [m["content"] for m in chat["messages"]] == [row["instruction"], row["output"]]
    with pytest.raises(ValueError):
        prepare.training_records(examples, "other")


def test_declared_schemas_hold(spark, examples):
    for form, declared in (("instruction", schemas.INSTRUCTION), ("chat", schemas.CHAT)):
        got = prepare.training_records(examples, form).schema.simpleString()
        assert got == spark.createDataFrame([], declared).schema.simpleString()


def test_chat_texts(examples):
    records = prepare.training_records(examples.limit(1))
    text, row = prepare.chat_texts(records).first()[0], records.first()
    assert text == f"<|user|>\n{row['instruction']}<|end|>\n<|assistant|>\n{row['output']}<|end|>"


def test_length_stats(examples):
    row = prepare.length_stats(examples).first()
    lengths = [len(r["instruction"]) for r in prepare.training_records(examples).collect()]
    outputs = [len(r["output"]) for r in prepare.training_records(examples).collect()]
    assert (row["prompt_min"], row["prompt_max"]) == (min(lengths), max(lengths))
    assert row["prompt_mean"] == pytest.approx(sum(lengths) / 50)
    assert row["total_tokens"] == pytest.approx((sum(lengths) + sum(outputs)) / 50 / 4)


def test_inference_round_trip(examples):
    records = prepare.training_records(examples, keep=("idx",))
    inputs = infer.model_inputs(records, keep=("idx",))
    row = infer.results(inputs, "output", keep=("idx",)).filter("idx = 3").first()
    assert (row["tailored_resume"], row["cover_letter"]) == ("new 3", "hello\n\nrole")
    assert row["ground_truth_resume"] == "new 3" and row["job_title"] == "dev"
    assert row["original_resume"].endswith("JOB POSTING:")
    assert inputs.first()["prompt"].count("<|user|>") == 1


def test_prepare_files(spark, examples, tmp_path):
    prepare_files(examples, str(tmp_path / "out"))
    stored = spark.read.schema(schemas.INSTRUCTION + ", split string").json(str(tmp_path / "out"))
    assert {r["split"]: r["count"] for r in stored.groupBy("split").count().collect()} == {"train": 40, "val": 5, "test": 5}
    assert stored.select("metadata.resume_id").distinct().count() == 50


def test_curate_writes_valid_rows_and_report(spark, examples, tmp_path):
    valid = curate(examples, "idx", str(tmp_path / "valid"), str(tmp_path / "report"))
    assert valid.count() == 0
    report = tables.read_jsonl(spark, str(tmp_path / "report"), "total_examples bigint, failure_reasons map<string, bigint>").first()
    assert report["total_examples"] == 50
    assert report["failure_reasons"] == {"Tailored resume too short": 50}


def test_write_requests_skips_done_batches(spark, tmp_path):
    full = spark.range(25).select(
        F.col("id").alias("resume_id"), F.lit(1).cast("bigint").alias("job_id"), F.lit(0.5).alias("similarity_score"),
        *[F.lit("x").alias(c) for c in ("resume_text", "job_title", "job_description", "job_skills", "company_name", "location", "experience_level")],
    )
    done = spark.createDataFrame([(1,)], "batch_id bigint")
    write_requests(full, full, str(tmp_path / "r"), done, batch_size=10)
    stored = spark.read.schema(schemas.REQUEST + ", batch_id bigint").json(str(tmp_path / "r"))
    assert {r["batch_id"]: r["count"] for r in stored.groupBy("batch_id").count().collect()} == {0: 10, 2: 5}


def test_conversations(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "assistant", "c"), (1, 4, "user", "d"),
        (2, 0, "user", "x"), (2, 0, "user", "w"), (2, 1, "user", ""), (2, 2, "user", None), (2, 3, None, "y"),
        (3, 0, "assistant", "z"), (3, 1, "assistant", "z"), (4, None, "user", "no turn"), (None, 1, "user", "p"), (None, 1, "assistant", "q"),
        (5, -1, "user", "before"), (6, 0, "system", "alone"),
    ]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part long").repartition(3)
    got = {(r[0], r[1]): ([tuple(m) for m in r[2]], r[3]) for r in chat_conversations(turns, span=4).collect()}
    assert got == {
        (1, 0): ([("system", "s"), ("user", "a"), ("assistant", "b\n\nc")], True), (1, 1): ([("user", "d")], False),
        (2, 0): ([("user", "w\n\nx")], False), (3, 0): ([("assistant", "z\n\nz")], False), (4, None): ([("user", "no turn")], False),
        (None, 0): ([("assistant", "q"), ("user", "p")], False), (5, -1): ([("user", "before")], False),
        (6, 0): ([("system", "alone")], False),
    }
    assert chat_conversations(turns.limit(0)).collect() == []


def test_a_long_conversation_is_cut(spark):
    turns = spark.range(5000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "cast(id as string) as text")
    got = chat_conversations(turns).collect()
    assert len(got) == 79 and max(len(r["messages"]) for r in got) == 64 and all(r["answered"] for r in got)
    assert sorted(int(m["content"]) for r in got for m in r["messages"]) == list(range(5000))
