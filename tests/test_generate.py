import json

import pytest
from pyspark.sql import functions as F

from pairloom.operators import generate
from pairloom.sources import schemas, tables
from pairloom.streaming.ingest import accepted_keys, fresh, ingest

LONG = "long text " * 20


def body(resume=LONG, letter=LONG):
    return json.dumps({"tailored_resume": resume, "cover_letter": letter})


def line(key, text, **extra):
    return json.dumps({"key": key, "response": {"candidates": [{"content": {"parts": [{"text": text}]}}], **extra}})


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, 7, 0.5, "resume", "title", "description", None, "co", "here", "any", i) for i in range(12)]
    rows.append((3, 7, 0.9, "newer", "title", "description", "sql", "co", "here", "any", 99))
    return spark.createDataFrame(rows, schemas.FULL_PAIRS + ", idx bigint")


LINES = [
    (line("resume_0_job_7", body()), "ok"),
    (line("resume_1_job_7", "```json\n" + body() + "\n```"), "ok"),
    (line("resume_2_job_7", body("short")), "too_short"),
    (line("resume_3_job_7", body()), "ok"),
    (line("resume_4_job_7", ""), "no_text"),
    (line("resume_5_job_7", "no json here"), "unparsable"),
    (line("elsewhere", body()), "unknown_key"),
    (json.dumps({"key": "resume_6_job_7", "response": {"text": body()}}), "ok"),
    (json.dumps({"key": "resume_7_job_7", "response": {"candidates": [], "text": body()}}), "ok"),
    (json.dumps({"key": "resume_8_job_7", "response": {"candidates": [{}], "text": body()}}), "no_text"),
    (json.dumps({"response": {"text": body()}}), "unknown_key"),
    ("{not json", "bad_line"), ("[1, 2]", "bad_line"),
    (line("resume_9_job_7", body("x" * 99)), "too_short"),
    (line("resume_10_job_7", body("x" * 100, "y" * 100)), "ok"),
    (line("resume_11_job_7", json.dumps([{"tailored_resume": LONG, "cover_letter": LONG}])), "unparsable"),
]


@pytest.fixture(scope="module")
def outcomes(spark, pairs):
    lines = spark.createDataFrame([(l,) for l, _ in LINES] + [("  ",)], "value string")
    return generate.with_outcome(generate.delivered(from_files=lines), pairs, order="idx").cache()


def test_every_label_is_hit_and_every_line_has_one(outcomes):
    got = sorted(r["outcome"] for r in outcomes.collect())
    assert got == sorted(o for _, o in LINES)
    assert set(got) == set(generate.OUTCOMES)


def test_last_pair_of_a_key_wins(outcomes):
    rows = {r["key"]: r for r in generate.generated(outcomes.withColumnRenamed("idx", "i")).withColumn("key", F.col("resume_id")).collect()}
    assert rows[3]["original_resume"] == "newer" and rows[3]["job_skills"] == "sql"
    assert rows[0]["job_skills"] == ""


def test_generated_schema(outcomes):
    made = generate.generated(outcomes)
    want = [tuple(c.split(" ")) for c in schemas.GENERATED.split(", ")]
    assert [(n, t) for n, t in made.dtypes] == want
    assert made.count() + generate.rejected(outcomes).count() == len(LINES)


def test_counts(outcomes):
    counts = {r["outcome"]: (r["responses"], r["pct_of_sent"]) for r in generate.outcome_counts(outcomes, F.lit(20)).collect()}
    assert counts["ok"] == (6, 30.0) and counts["bad_line"] == (2, 10.0)
    row = generate.ingest_summary(outcomes, F.lit(0)).first()
    assert (row["success_count"], row["fail_count"], row["success_pct"]) == (6, 10, None)


def test_both_delivery_shapes(spark):
    schema = schemas.RESPONSE
    inline = spark.createDataFrame([("k", (None, body())), ("gone", None)], schema)
    lines = spark.createDataFrame([(line("f", body()),)], "value string")
    nothing = generate.delivered()
    assert nothing.columns == generate.delivered(lines).columns and nothing.count() == 0
    assert {r["key"] for r in generate.delivered(lines, inline).collect()} == {"f", "k"}
    assert [r["key"] for r in generate.delivered(inline=inline).collect()] == ["k"]


def test_request_json_shape(spark, pairs):
    rows = generate.requests(pairs.filter("resume_id = 0"))
    got = json.loads(generate.request_json(rows).first()["line"])
    assert got["key"] == "resume_0_job_7"
    assert got["request"]["generation_config"] == {"temperature": 0.7, "max_output_tokens": 8000}
    content = got["request"]["contents"][0]
    assert content["role"] == "user" and "Required Skills: Not specified" in content["parts"][0]["text"]
    declared = spark.createDataFrame([], schemas.REQUEST).schema
    assert rows.schema.simpleString() == declared.simpleString()


def test_batches(spark):
    df = spark.range(10000).select(F.lit(1).alias("resume_id"), F.col("id").alias("job_id")).repartition(5)
    sizes = {r["batch_id"]: r["count"] for r in generate.assign_batches(df, ["resume_id", "job_id"]).groupBy("batch_id").count().collect()}
    assert sizes == {i: 100 for i in range(100)}
    short = generate.assign_batches(spark.range(250).withColumnRenamed("id", "a"), ["a"])
    assert {r["batch_id"]: r["count"] for r in short.groupBy("batch_id").count().collect()} == {0: 100, 1: 100, 2: 50}
    done = spark.createDataFrame([(1,), (1,), (9,)], "batch_id bigint")
    left = generate.pending(short, done)
    assert {r["batch_id"] for r in left.collect()} == {0, 2}


def test_progress(spark):
    kept = [84, 82, 60, 93, 99]
    rows = [(b, i < n) for b, n in enumerate(kept) for i in range(100)]
    df = spark.createDataFrame(rows, "batch_id bigint, ok boolean")
    got = generate.batch_progress(df, kept=F.col("ok")).orderBy("batch_id").collect()
    assert [r["running_total"] for r in got] == [84, 166, 226, 319, 418]
    assert {r["total_rows"] for r in got} == {500}


def test_stream_equals_batch_over_several_runs(spark, pairs, outcomes, tmp_path):
    landing, run = tmp_path / "in", {n: str(tmp_path / n) for n in ("ok", "bad", "log")}
    landing.mkdir()
    lines = [l for l, _ in LINES]

    def take(name, part):
        (landing / name).write_text("\n".join(part) + "\n")
        ingest(spark, str(landing), pairs, run["ok"], run["bad"], run["log"], order="idx").awaitTermination()

    take("a.jsonl", lines[:6])
    take("b.jsonl", lines[6:] + lines[:2])  # two keys delivered again
    made = spark.read.parquet(run["ok"] + "/*").drop("timestamp")
    want = generate.generated(outcomes).drop("timestamp")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
    bad = sorted(r["outcome"] for r in spark.read.parquet(run["bad"] + "/*").collect())
    assert bad == sorted(o for _, o in LINES if o != "ok")


def test_good_retry_after_a_failed_delivery(spark, pairs, tmp_path):
    landing, run = tmp_path / "in", {n: str(tmp_path / n) for n in ("ok", "bad", "log")}
    landing.mkdir()
    deliveries = ["no json here", body("short"), body(), body(LONG + "again")]
    for n, text in enumerate(deliveries):
        (landing / f"{n}.jsonl").write_text(line("resume_5_job_7", text) + "\n")
        ingest(spark, str(landing), pairs, run["ok"], run["bad"], run["log"], order="idx").awaitTermination()
    made = spark.read.parquet(run["ok"] + "/*").collect()
    assert [(r["resume_id"], r["tailored_resume"]) for r in made] == [(5, LONG)]
    bad = sorted(r["outcome"] for r in spark.read.parquet(run["bad"] + "/*").collect())
    assert bad == ["too_short", "unparsable"]


def test_redelivery_is_dropped_after_any_time(spark, pairs, tmp_path):
    """Stream state has no part in it: every run is a new query, and keys are looked up where they are stored."""
    landing, run = tmp_path / "in", {n: str(tmp_path / n) for n in ("ok", "bad", "log")}
    landing.mkdir()
    twice = line("resume_5_job_7", body())
    (landing / "0.jsonl").write_text(f"{twice}\n{twice}\n")
    ingest(spark, str(landing), pairs, run["ok"], run["bad"], run["log"], order="idx").awaitTermination()
    for n in (1, 2):
        (landing / f"{n}.jsonl").write_text(line("resume_5_job_7", body(LONG + "late")) + "\n")
        ingest(spark, str(landing), pairs, run["ok"], run["bad"], run["log"], order="idx").awaitTermination()
    made = spark.read.parquet(run["ok"] + "/*").collect()
    assert [(r["resume_id"], r["tailored_resume"]) for r in made] == [(5, LONG)]


def test_a_micro_batch_run_again_looks_at_earlier_ones_alone(spark, tmp_path):
    path = str(tmp_path / "keys")
    for n, keys in ((-1, []), (0, ["a"]), (1, ["b", "c"])):
        spark.createDataFrame([(k,) for k in keys], "key string").write.parquet(f"{path}/batch={n}")
    assert accepted_keys(spark, path, 0).collect() == []
    good = spark.createDataFrame([("b", "2", 1), ("b", "1", 2), ("a", "3", 3), ("d", "4", 4)], "key string, place string, n int")
    assert sorted(map(tuple, fresh(good, accepted_keys(spark, path, 1)).collect())) == [("b", "1", 2), ("d", "4", 4)]


def test_batch_files(spark, pairs, tmp_path):
    rows = generate.requests(pairs.withColumn("batch_id", F.col("resume_id") % 3), keep=("batch_id",))
    tables.write_batches(rows, str(tmp_path / "out"))
    files = sorted(p.parent.name for p in (tmp_path / "out").glob("*/*.json"))
    assert files == ["batch_id=0", "batch_id=1", "batch_id=2"]
