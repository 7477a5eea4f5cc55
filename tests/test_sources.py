import json

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from pairloom import session
from pairloom.operators import quality
from pairloom.plans.pairing import clean_and_match
from pairloom.sources import schemas, tables
from tests.disk import left_files, shuffle_files


def test_csv_keeps_quotes_newlines_and_spaces(spark, tmp_path):
    rows = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, " padded "), (4, "back\\slash"), (5, None), (6, "")]
    tables.write_csv(spark.createDataFrame(rows, schemas.RESUMES_CLEAN), str(tmp_path / "c"))
    got = {r["ID"]: r["Resume_str"] for r in tables.read_csv(spark, str(tmp_path / "c"), schemas.RESUMES_CLEAN).collect()}
    assert got == {**dict(rows), 6: None}  # an empty field comes back as null


def test_csv_reads_a_foreign_file(spark, tmp_path):
    (tmp_path / "f.csv").write_text('ID,Resume_str,Category\n7,"a ""quoted""\ntext, here",IT\n')
    assert tables.read_csv(spark, str(tmp_path / "f.csv"), schemas.RESUMES_RAW).collect() == [(7, 'a "quoted"\ntext, here', "IT")]


def test_jsonl_writes_null_fields(spark, tmp_path):
    tables.write_jsonl(spark.createDataFrame([(1, None, 0.5)], schemas.PAIRS).coalesce(1), str(tmp_path / "j"))
    text = next((tmp_path / "j").glob("*.json")).read_text()
    assert json.loads(text) == {"resume_id": 1, "job_id": None, "similarity_score": 0.5}
    assert tables.read_jsonl(spark, str(tmp_path / "j"), schemas.PAIRS).collect() == [(1, None, 0.5)]


def test_json_array_document(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"resume_id": 1, "job_title": "x"}, {"resume_id": 2}], indent=2))
    got = tables.read_json_document(spark, str(tmp_path / "d.json"), schemas.RESULT).select("resume_id", "job_title").collect()
    assert got == [(1, "x"), (2, None)]


def test_json_documents_round_trip(spark, tmp_path):
    tables.write_json_documents(spark.range(25), str(tmp_path / "d"), "id", records=10)
    files = list((tmp_path / "d").glob("*/*.txt"))
    assert len(files) == 3 and all(isinstance(json.loads(f.read_text()), list) for f in files)
    got = tables.read_json_document(spark, str(tmp_path / "d"), "id bigint").select("id").collect()
    assert sorted(r["id"] for r in got) == list(range(25))


def test_json_documents_meet_by_shard_before_lists_begin(spark, tmp_path, monkeypatch):
    """Lists of many shards on the way to the shuffle would be sorted and spilled."""
    plans = []
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path: plans.append(
        self._df._jdf.queryExecution().executedPlan().toString()))
    tables.write_json_documents(spark.range(25).withColumn("shard", F.lit("own")), str(tmp_path / "d"), "id", records=10)
    assert plans[0].count("Exchange") == 1
    assert plans[0].rindex("Aggregate") < plans[0].index("Exchange")


def test_json_documents_leave_no_shuffle_files(spark, tmp_path):
    """Neither of the frame's own joins nor of gathering, which goes by some of the shards at a time."""
    rows = spark.range(90).withColumn("none", F.lit(None)).repartition(4, "id").groupBy("id", "none").count()
    before = shuffle_files(spark)
    tables.write_json_documents(rows, str(tmp_path / "d"), "id", records=10, compression="gzip")
    assert not left_files(spark, before)
    assert len(list((tmp_path / "d").glob("*/*.txt.gz"))) == 9
    got = tables.read_json_document(spark, str(tmp_path / "d"), "id bigint, none string, count bigint").drop("shard")
    assert sorted(got.collect()) == [(i, None, 1) for i in range(90)]


def test_a_lean_table_leaves_no_shuffle_files_and_can_be_dropped(spark):
    kept = spark.conf.get(session.CLEANUP)
    before = shuffle_files(spark)
    df = session.stored(spark.range(50).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "test", lean=True)
    assert not left_files(spark, before)
    assert df.count() == 7 and spark.conf.get(session.CLEANUP) == kept
    session.dropped(df)
    assert not df.sparkSession.sparkContext._jvm.java.io.File(df.inputFiles()[0].removeprefix("file://")).exists()


def test_no_other_table_is_dropped(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/own")
    with pytest.raises(ValueError):
        session.dropped(spark.read.parquet(f"{tmp_path}/own"))
    assert spark.read.parquet(f"{tmp_path}/own").count() == 3


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_splits_and_sample(spark, tmp_path, form):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("test"))
    tables.write_splits(df, str(tmp_path / "s"), form)
    assert sorted(p.name for p in (tmp_path / "s").glob("split=*")) == ["split=test", "split=train"]
    assert tables.sample_record(df, "id").collect() == [(0, "train")]
    with pytest.raises(ValueError):
        tables.write_splits(df, str(tmp_path / "x"), "arrow")


def test_report_is_one_record(spark, tmp_path):
    rows = [(i, "o" * 300, "t", "d" * 200, "x", "y") for i in range(3)]
    df = spark.createDataFrame(rows, "idx bigint, original_resume string, job_title string, job_description string, "
                                     "tailored_resume string, cover_letter string")
    tables.write_report(quality.report(quality.labelled(df), "idx"), str(tmp_path / "r"))
    files = list((tmp_path / "r").glob("*.json"))
    record = json.loads(files[0].read_text())
    assert len(files) == 1 and record["failure_reasons"] == {"Tailored resume too short": 3}
    assert [e["index"] for e in record["invalid_examples"]] == [0, 1, 2]


def test_shared_folder_comes_from_the_session(spark):
    folder, named = session.shared_folder(spark), spark.conf.get("spark.checkpoint.dir", None)
    assert folder == (named or spark.sparkContext.getCheckpointDir())
    assert spark.sparkContext.getCheckpointDir() is not None
    assert session.new_folder(spark, "x") != session.new_folder(spark, "x")


def test_clean_and_match_end_to_end(spark):
    text = "python developer building software with docker and sql databases in the cloud " * 3
    resumes = spark.createDataFrame([(i, text + f"person{i % 3}", "IT") for i in range(6)], schemas.RESUMES_RAW)
    jobs = spark.createDataFrame(
        [(i, "dev", text + f"place{i}", "co", "here", "sql", "any") for i in range(5)], schemas.JOBS)
    got = clean_and_match(resumes, jobs, {"min_hits": 5}, pairs_per_resume=2, target_pairs=5)
    rows = got.collect()
    assert got.schema.simpleString() == spark.createDataFrame([], schemas.FULL_PAIRS).schema.simpleString()
    assert len(rows) == 5 and {r["resume_id"] for r in rows} == {0, 1, 2}
    assert all(r["resume_text"] and r["job_skills"] == "sql" for r in rows)
