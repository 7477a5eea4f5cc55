import random

import numpy as np
from pyspark.sql import functions as F

from pairloom.llm.toxicity import fit, grams, score, without_toxic
from tests.llm.conftest import EDGES, by_id, prose

INSULTS = ["vilefool", "dumbwit", "grossling"]


def rows(first, n, seed):
    rng, out = random.Random(seed), []
    for k in range(n):
        toxic = k % 4 == 0
        words = prose(seed + k, rng.randint(20, 300), 3000)
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
        out.append((first + k, " ".join(words), int(toxic)))
    return out


def labels(spark, found):
    return spark.createDataFrame([(i, 1, y, "x") for i, _, y in found] + [(None, 1, 1, "x"), (5, 1, None, "x")], "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy(spark, documents):
    found = rows(100, 400, 11)
    docs = documents([*EDGES, *[(i, t) for i, t, _ in found]])
    model = fit(docs, labels(spark, found), learn=lambda c: c % 3 != 0)
    got = {r["doc_id"]: r for r in by_id(score(docs, model))}
    held = [(got[i]["predicted"], y) for i, _, y in found if i % 3 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert got[1]["score"] == got[2]["score"] and score(docs, model).count() == docs.count()
    kept = without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == score(docs, model).filter("predicted = 0").count()
    # a bounded sample of labelled rows still learns
    small = fit(docs, labels(spark, found), max_rows=150)
    assert score(docs, small).join(labels(spark, found), "doc_id").filter("predicted = toxic").count() > 0.9 * len(found)


def test_without_usable_labels(spark, documents):
    docs = documents(EDGES)
    for found in ([], [(5, "x", 1)]):
        got = score(docs, fit(docs, labels(spark, found))).select("score").distinct().collect()
        assert len(got) == 1 and 0 < got[0]["score"] < 1
    assert score(documents([]), fit(docs, labels(spark, []))).count() == 0
    none = fit(docs, labels(spark, rows(1, 9, 1)), learn=lambda c: F.lit(False))
    assert not len(none.hashes)


def test_grams():
    assert len(grams("")) == 0 and len(grams("abc")) == 3 + 2 + 1
    assert (grams("ABC") == grams("abc")).all() and len(set(grams("abcdefgh").tolist())) > 10
    assert grams("é🙂").dtype == np.int32
