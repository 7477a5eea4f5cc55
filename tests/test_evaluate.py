import math
import random
import re
from collections import Counter

import pytest
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairloom.functions.scores import bleu_tokens, clipped_counts, cosine, lcs, rouge_tokens
from pairloom.functions.stem import stem, stem_tokens
from pairloom.operators import evaluate

# Worked examples of the published algorithm, and of the extensions
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall",
    "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "skies": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit",
    "radicalli": "radic", "differentli": "differ", "analogousli": "analog", "vietnamization": "vietnam",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust",
    "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust",
    "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect", "probate": "probat",
    "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "dying": "die", "tied": "tie",
    "enjoy": "enjoy", "by": "by", "employed": "employ", "python3": "python3",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_stem_tokens_leaves_short_tokens(apply):
    got = apply(stem_tokens(F.split("t", " ")), "running runs was", "x")
    assert got == [["run", "run", "was"], ["x"]]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=80), st.lists(st.sampled_from("abcd"), max_size=80))
def test_lcs_is_exact(a, b):
    assert lcs(a, b) == brute_lcs(a, b)


def test_clipped_counts_against_counters():
    """Null and empty lists, rows that end in what the next one begins with, parts of a batch."""
    rng = random.Random(5)
    make = lambda: None if rng.random() < 0.1 else [rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 6, 30]))]
    made, wanted = [make() for _ in range(200)], [make() for _ in range(200)]

    def want(a, b, n):
        grams = [Counter(zip(*[(t or [])[i:] for i in range(n)])) for t in (a, b)]
        return sum((grams[0] & grams[1]).values())

    lists = [pa.array(x, pa.list_(pa.string())) for x in (made, wanted)]
    rows = [[want(a, b, n) for n in range(1, 5)] for a, b in zip(made, wanted)]
    assert clipped_counts(*lists, 4).tolist() == rows
    assert clipped_counts(*[x.slice(7, 50) for x in lists], 4).tolist() == rows[7:57]
    assert clipped_counts(*[x.slice(0, 0) for x in lists], 4).shape == (0, 4)


def test_no_gram_of_a_text_becomes_a_string(results):
    """Matches come from token numbers: no sorted or joined lists of n-grams beside the tokens."""
    for rows in (evaluate.evaluate(results, stemmed=False), evaluate.rouge_scores(results, "tailored_resume", "ground_truth_resume")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "sort_array" not in plan and "zip_with" not in plan.lower()


def python_rouge(pred, ref, stemmed):
    def tokens(text):
        found = re.findall("[a-z0-9]+", text.lower())
        return [stem(t) if len(t) > 3 else t for t in found] if stemmed else found

    def f(m, made, wanted):
        p, r = m / max(made, 1), m / max(wanted, 1)
        return (p, r, 2 * p * r / (p + r) if p + r else 0.0)

    p, r, out = tokens(pred), tokens(ref), {}
    for n in (1, 2):
        a, b = (Counter(zip(*[t[i:] for i in range(n)])) for t in (p, r))
        out[f"rouge{n}"] = f(sum((a & b).values()), sum(a.values()), sum(b.values()))
    out["rougeL"] = f(brute_lcs(p, r), len(p), len(r))
    return out


def sentences(n):
    rng = random.Random(7)
    words = "running runs engineer engineers built building the team role data cloud 42 a".split()
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
    return [(make(), make()) for _ in range(n)] + [("same text here", "same text here"), ("aaa", "bbb"), ("", "")]


@pytest.mark.parametrize("stemmed", [True, False])
def test_rouge_against_brute_force(spark, stemmed):
    pairs = sentences(40)
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)], "i int, p string, r string")
    got = {r["i"]: r for r in evaluate.rouge_scores(df, "p", "r", ("i",), stemmed=stemmed).collect()}
    for i, (p, r) in enumerate(pairs):
        for name, values in python_rouge(p, r, stemmed).items():
            assert tuple(got[i][f"{name}_{x}"] for x in evaluate.ROUGE_PARTS) == pytest.approx(values)
    same = got[40]
    assert all(same[c] == 1.0 for c in same.asDict() if c != "i")


def python_bleu(pairs):
    match, total, made, wanted = [0] * 4, [0] * 4, 0, 0
    for p, r in pairs:
        p, r = p.split(), r.split()
        made, wanted = made + len(p), wanted + len(r)
        for n in range(1, 5):
            a, b = (Counter(zip(*[t[i:] for i in range(n)])) for t in (p, r))
            match[n - 1] += sum((a & b).values())
            total[n - 1] += sum(a.values())
    if not any(match):
        return 0.0, [0.0] * 4
    smooth, precisions = 1, []
    for m, t in zip(match, total):
        if t == 0:
            precisions.append(0.0)
            continue
        if m == 0:
            smooth *= 2
            precisions.append(100 / (smooth * t))
        else:
            precisions.append(100 * m / t)
    penalty = math.exp(1 - wanted / made) if made < wanted else 1.0
    logs = [math.log(p) if p > 0 else -9999999999 for p in precisions]
    return penalty * math.exp(sum(logs) / 4), precisions


@pytest.mark.parametrize("pairs", [
    sentences(30), [("a b c d e", "a b c d e")], [("a b", "a b c d")], [("x y z q w", "a b c d")], [("a b c d e", "a c e b d")],
])
def test_bleu_against_brute_force(spark, pairs):
    df = spark.createDataFrame(pairs, "p string, r string")
    row = evaluate.bleu(evaluate.bleu_counts(df, "p", "r")).first()
    score, precisions = python_bleu(pairs)
    assert row["bleu"] == pytest.approx(score, abs=1e-9)
    assert [row[f"bleu_precision_{n}"] for n in range(1, 5)] == pytest.approx(precisions)


def test_bleu_tokens(apply):
    got = apply(bleu_tokens(F.col("t")), "Hello, world.", "1,000.5 mid-word 3-4", "a&amp;b (c)\nd", "end-\nless", "")
    assert got == [
        ["Hello", ",", "world", "."], ["1,000.5", "mid-word", "3", "-", "4"],
        ["a", "&", "b", "(", "c", ")", "d"], ["endless"], [],
    ]


def test_rouge_tokens(apply):
    assert apply(rouge_tokens(F.col("t")), "Don't stop-42 É!", None) == [["don", "t", "stop", "42"], []]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])],
                               "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    row = evaluate.semantic_similarity(df, "a", "b").first()
    assert row[0] == pytest.approx(1 / 3) and row[1] == pytest.approx(math.sqrt(2) / 3)


def test_overlap_skips_empty_targets_and_uses_population_deviation(spark):
    df = spark.createDataFrame([("alpha beta", "alpha"), ("alpha", "alpha gamma"), ("x", "the a")], "p string, t string")
    row = evaluate.overlap_stats(df, "p", F.col("t")).first()
    assert (row[0], row[1]) == (0.75, 0.25)


def test_perplexity(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1)], "loss double, num_tokens bigint")
    assert evaluate.perplexity(df).first()[0] == pytest.approx(math.exp(5 / 4))
    assert evaluate.perplexity(df.limit(0)).first()[0] is None


RESULTS = ("job_title string, job_description string, tailored_resume string, cover_letter string, "
           "ground_truth_resume string, ground_truth_cover_letter string")


@pytest.fixture(scope="module")
def results(spark):
    rows = [("dev", "build data systems", "builds data systems", "dear team", "build data system", "dear team")] * 3
    return spark.createDataFrame(rows, RESULTS)


def test_evaluate_sections_and_gate(spark, results):
    metrics = {(r["section"], r["metric"]): r["value"] for r in evaluate.evaluate(results).collect()}
    sections = {s for s, _ in metrics}
    assert sections == {"rouge_resume", "rouge_cover_letter", "bleu_resume", "bleu_cover_letter",
                        "length_stats_resume", "length_stats_cover_letter", "keyword_overlap"}
    assert metrics["rouge_cover_letter", "rougeL_fmeasure"] == 1.0
    assert metrics["rouge_resume", "rouge1_fmeasure"] == 1.0  # stems agree
    assert metrics["keyword_overlap", "keyword_overlap_mean"] == pytest.approx(2 / 3)
    ungated = results.withColumn("ground_truth_resume", F.lit(""))
    assert {r["section"] for r in evaluate.evaluate(ungated).collect()} == {
        "length_stats_resume", "length_stats_cover_letter", "keyword_overlap"}


def test_without_references_their_metrics_are_not_worked_out(spark, results):
    """Nulls count as no reference; neither subsequences nor n-grams are in the plan."""
    blank = results.withColumn("ground_truth_resume", F.lit(None).cast("string"))
    plan = evaluate.evaluate(blank)._jdf.queryExecution().optimizedPlan().toString()
    assert "lcs_length" not in plan and "array_intersect" not in plan.split("keyword_overlap")[0]
    one = results.limit(1).union(blank)
    assert {r["section"] for r in evaluate.evaluate(one).collect()} >= {"rouge_resume", "bleu_resume"}


def test_evaluate_with_vectors_and_report(spark, results):
    with_vectors = results.withColumn("v", F.array(F.lit(1.0), F.lit(2.0))).withColumn("w", F.array(F.lit(2.0), F.lit(4.0)))
    metrics = evaluate.evaluate(with_vectors, {"resume": ("v", "w")})
    report = evaluate.metrics_report(metrics).first()["metrics"]
    assert report["semantic_similarity_resume"]["semantic_similarity_mean"] == pytest.approx(1.0)
    assert report["length_stats_resume"]["length_max"] == 19.0


def test_compare(spark):
    schema = "section string, metric string, value double"
    a = spark.createDataFrame([("rouge_resume", "rouge1_fmeasure", 0.6), ("rouge_resume", "rouge2_fmeasure", 0.2),
                               ("rouge_resume", "rouge1_recall", 0.9), ("bleu_resume", "bleu", 3.0)], schema)
    b = spark.createDataFrame([("rouge_resume", "rouge1_fmeasure", 0.5), ("rouge_resume", "rouge2_fmeasure", 0.0)], schema)
    got = {r["metric"]: r["improvement"] for r in evaluate.compare(a, b).collect()}
    assert got == {"rouge1_fmeasure": pytest.approx(20.0), "rouge2_fmeasure": 0.0}


def test_comparison_report(spark):
    schema = "section string, metric string, value double"
    run = lambda f, l: spark.createDataFrame(
        [("rouge_resume", "rouge1_fmeasure", f), ("rouge_resume", "rougeL_fmeasure", l), ("rouge_resume", "rouge1_recall", 0.1), ("bleu_resume", "bleu", 5.0)], schema)
    got = evaluate.comparison_report(run(0.6, 0.4), run(0.5, 0.0)).first()
    assert got["fine_tuned"]["rouge_resume"]["rouge1_fmeasure"] == 0.6 and got["baseline"]["bleu_resume"]["bleu"] == 5.0
    assert {k: round(v, 6) for k, v in got["improvements"].items()} == {"rouge1_fmeasure": 20.0, "rougeL_fmeasure": 0.0}
