import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pairloom.llm.registry import QUERIES
from pairloom.session import stored
from tests.llm.conftest import EDGES

FOLDER = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) <= set(entry.queries()) and (corpus_pipeline.ORACLE_SQL is None) == ("pipeline" not in entry.oracle_sql())


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids, columns = {r[0] for r in docs.select("doc_id").collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER), "test")
        assert docs.columns == columns, name
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now < ids or name in ("decontamination", "secrets") and now <= ids, name
        ids = now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in last} == ids and all(r["decoded_equal"] for r in last)


# rows of EDGES that a stage drops: repeats of (4, "one two three") and of the text under 5, 6 and 10; 3,000 hex digits
DROPPED = {"near_duplicates": 3, "secrets": 1}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_odd_rows(spark, documents, stage):
    docs = documents(EDGES)
    out = stage[1](spark, docs, FOLDER).collect()
    assert len(out) == len(EDGES) - DROPPED.get(stage[0], 0)
    assert sum(r["doc_id"] is None for r in out) == 2
    assert stage[1](spark, documents([]), FOLDER).count() == 0
