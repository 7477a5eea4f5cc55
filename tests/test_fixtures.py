import pytest
from pyspark.sql import functions as F

from catalog import fixtures as fx


@pytest.fixture
def folder(spark, tmp_path):
    docs = [(i, f"text {i}", "en", "web") for i in range(6)] + [(2, "again", "de", "web")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "user", "ask"), (1, 1, "assistant", "say"), (1, 0, "user", "ask again"), (2, 0, "user", None), (3, None, "user", "lost")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_more_columns_meet_the_keys_as_they_would_meet_the_rows(spark, folder):
    """With repeated and null keys."""
    more = fx.pair_keys(spark, folder).select("resume_id", "job_id", (F.col("resume_id") % 3).alias("batch_id"))
    early = fx.full_pairs(spark, folder, more)
    late = fx.full_pairs(spark, folder).join(more, ["resume_id", "job_id"]).select(early.columns)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(early) == rows(late) and len(rows(early)) > 6


def test_texts_of_turns_stay_where_their_lengths_do(spark, folder):
    plan = fx.full_pairs(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Project" in line and "original_resume" in line]
    assert joins and not any("user_text" in line for line in joins)
