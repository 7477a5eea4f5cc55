import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from pairloom.functions.bloom import Bloom
from pairloom.functions.grams import batch_totals, row_counts
from pairloom.operators import match

WORDS = ["a", "b", "é", "longer", "x1"]


def lists(n):
    rng = random.Random(n)
    make = lambda: None if rng.random() < 0.1 else [rng.choice(WORDS) for _ in range(rng.choice([0, 1, 2, 9]))]
    return [make() for _ in range(n)]


def grams(row, n, among):
    found = list(zip(*[(row or [])[i:] for i in range(n)]))
    return [" ".join(g) for g in found if all(w in among for w in g)]


def test_bloom_holds_what_its_column_tests(spark):
    made = Bloom.of(spark.createDataFrame([("a",), ("é",), ("",)], "w string"), "w", 1 << 10)
    texts = [*WORDS, "", "ß" * 40, *map(str, range(300))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    want = rows.select("t", made.test(F.col("t"), made.column()).alias("v")).collect()
    assert made.holds([r["t"] for r in want]).tolist() == [r["v"] for r in want]


def test_plans_do_not_spell_out_a_bloom_filter(spark):
    made = Bloom.of(spark.createDataFrame([("a",), ("b",)], "w string"), "w")
    rows = spark.createDataFrame([("a",), ("c",)], "t string").filter(made.test(F.col("t"), made.column()))
    assert [r["t"] for r in rows.collect()] == ["a"]
    assert len(rows._jdf.queryExecution().toString()) < 20_000


def test_batch_counts_against_counters(spark):
    among = ["a", "é", "x1"]
    bloom = Bloom.of(spark.createDataFrame([(w,) for w in among], "w string"), "w")
    rows = lists(120)
    batch = pa.array(rows, pa.list_(pa.string())).slice(3, 100)
    for filter_, passing in ((None, WORDS), (bloom, among)):
        got = {t: (n, df) for columns in batch_totals(batch, range(1, 4), filter_)
               for t, n, df in zip(*[c.to_pylist() for c in columns])}
        found = [[g for n in (1, 2, 3) for g in grams(r, n, passing)] for r in rows[3:103]]
        total, df = Counter(g for f in found for g in f), Counter(g for f in found for g in set(f))
        assert got == {g: (total[g], df[g]) for g in total}
    counted = {(int(at), t): int(n) for part in row_counts(batch, range(1, 3), bloom, bloom)
               for at, t, n in zip(part[0], part[1].to_pylist(), part[2])}
    assert counted == {(i, g): n for i, r in enumerate(rows[3:103]) for g, n in Counter(grams(r, 1, among)).items()}
    assert all(len(c) == 0 for columns in batch_totals(batch.slice(0, 0), range(1, 4)) for c in columns)


def test_no_row_per_token(spark):
    """Counts leave a batch, not tokens."""
    docs = spark.createDataFrame([("some words here",)], "text string")
    for counted in (match.word_totals(docs, "text"), match.ngram_totals(docs, "text")):
        assert "Generate" not in counted._jdf.queryExecution().optimizedPlan().toString()
