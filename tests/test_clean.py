from pyspark.sql import functions as F

from pairloom.fixed_values import TECH_KEYWORDS
from pairloom.operators import clean


def test_dedup_keeps_the_least_id(spark):
    rows = [(3, "same"), (1, "same"), (2, "same"), (9, "other"), (8, None), (4, None)]
    df = spark.createDataFrame(rows, "id bigint, t string").repartition(3)
    got = clean.dedup_keep_first(df, "t", "id").collect()
    assert {r["id"] for r in got} == {1, 9, 4}


def test_dedup_with_null_and_repeated_ids(spark):
    rows = [(None, "only me"), (1, "a"), (2, "a"), (None, "a"), (3, "b"), (5, "b"), (5, "c")]
    df = spark.createDataFrame(rows, "id bigint, t string").repartition(3)
    got = clean.dedup_keep_first(df, "t", "id").collect()
    assert sorted((r["t"], r["id"]) for r in got) == [("a", 1), ("b", 3), ("c", 5), ("only me", None)]


def test_dedup_moves_texts_with_a_possible_copy_only(spark):
    """Bytes shuffled as whole rows: in proportion to the copies, not to the table."""
    rows = [(i, f"text {i} " + "x" * 500) for i in range(3000)] + [(5000 + i, "copy " + "y" * 500) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(4)
    kept = clean.dedup_keep_first(df, "t", "id")
    assert sorted(r["id"] for r in kept.collect()) == [*range(3000), 5000]
    narrow = df.filter(~clean._copied(df, "t"))
    assert narrow.count() == 3000


def test_dedup_combines_copies_before_the_shuffle(spark):
    df = spark.range(10000).select("id", F.lit("copy").alias("t")).repartition(4)
    kept = clean.dedup_keep_first(df, "t", "id")
    assert [r["id"] for r in kept.collect()] == [0]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_last_per_key(spark):
    rows = [("a", 1, "x"), ("a", 5, "y"), ("b", 2, "z"), ("c", None, "n"), ("d", None, "m"), ("d", 0, "o"), (None, 1, "p"), (None, 2, "q")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    assert {r["v"] for r in clean.last_per_key(df, "k", "o").collect()} == {"y", "z", "n", "o", "p", "q"}


def padded(words):
    return words + " " + "z" * 120


def test_clean_left_gate_and_order(spark):
    eight, seven = " ".join(TECH_KEYWORDS[:4] + TECH_KEYWORDS[14:18]), " ".join(TECH_KEYWORDS[:3] + TECH_KEYWORDS[14:18])
    rows = [
        (1, padded(eight)), (2, padded(seven)), (3, eight[:90]), (4, padded(eight) + "  "), (5, None),
    ]
    df = spark.createDataFrame([r + ("c",) for r in rows], "ID bigint, Resume_str string, Category string")
    got = clean.clean_left(df).collect()
    assert [r["ID"] for r in got] == [1]
    assert got[0].asDict().keys() == {"ID", "Resume_str"}
    assert {r["ID"] for r in clean.clean_left(df, dedup=False).collect()} == {1, 4}


def test_clean_right_gates_on_three_columns_and_dedups_on_one(spark):
    body = "b" * 101
    rows = [
        (2, "docker", body, "aws sql", "co", "here", None),
        (1, "docker aws", body, "sql", None, None, None),
        (3, "docker", body, None, None, None, None),
        (4, "docker aws sql", "b" * 100, None, None, None, None),
    ]
    schema = ("job_id bigint, title string, description string, skills_desc string, company_name string, "
              "location string, formatted_experience_level string")
    got = clean.clean_right(spark.createDataFrame(rows, schema)).collect()
    assert [(r["job_id"], r["skills_desc"], r["company_name"]) for r in got] == [(1, "sql", None)]


def test_stage_counts_match_the_steps(spark):
    words = " ".join(TECH_KEYWORDS[:12])
    rows = [(i, padded(words) if i % 3 else "short") for i in range(30)] + [(99, "q" * 200)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    got = clean.stage_counts(df, "t").first().asDict()
    assert got == {"original": 31, "after_length": 21, "after_gate": 20, "after_dedup": 1}
    pairs = clean.potential_pairs(clean.stage_counts(df, "t"), clean.stage_counts(df, "t"))
    assert pairs.first()["potential_pairs"] == 1


def test_cleaning_runs_once_per_row(spark):
    df = spark.createDataFrame([(1, "x")], "ID bigint, Resume_str string")
    plan = clean.clean_left(df, dedup=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("&[a-z]+;") == 1


def test_head(spark):
    assert [r["id"] for r in clean.head(spark.range(100).repartition(5), "id", 3).collect()] == [0, 1, 2]
