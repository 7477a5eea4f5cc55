import re
from collections import Counter

from pyspark.sql import functions as F
from pyspark.ml.feature import StopWordsRemover

from pairloom.fixed_values import (
    ENGLISH_STOP_WORDS, NOVELTY_STOP_WORDS, OVERLAP_STOP_WORDS, TECH_KEYWORDS,
)
from pairloom.functions import text as T


def test_clean_text_order_and_entities(apply):
    got = apply(
        T.clean_text(F.col("t")),
        None, "a&amp;b", "a &nbsp; b", "&AMP; &#39;", "a\xa0\x0b\x1c b", "  x\n\ty  ", "　é ",
    )
    assert got == ["", "a b", "a   b", "&AMP; &#39;", "a b", "x y", "é"]


def test_space_class_is_pythons(apply):
    spaces = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    got = apply(T.strip(F.col("t")), *[f"{s}x{s}" for s in spaces], "​x")
    assert got == ["x"] * len(spaces) + ["​x"]


def test_length_is_strict_and_counts_code_points(apply):
    assert apply(T.longer_than(F.col("t"), 100), "x" * 100, "x" * 101, "😀" * 101) == [False, True, True]


def test_keyword_hits_are_distinct_substrings(apply):
    got = apply(T.keyword_hits(F.col("t"), TECH_KEYWORDS), "JavaScript", "email", "java java", "C++ .NET", "")
    assert got == [2, 1, 1, 2, 0]


def test_concat_keeps_separator_for_null(spark):
    row = spark.createDataFrame([("a", None, "c")], "a string, b string, c string")
    assert row.select(T.concat_text(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "a  c"


WORDS = ["café caféteria latex LATEX", "python3 snake_case plain", "they more that words", "", "abcd efg-hijk"]


def python_words(text, stop):
    return set(re.findall(r"\b[a-zA-Z]{4,}\b", text.lower())) - set(stop)


def test_ascii_words_are_pythons(apply):
    for stop in (NOVELTY_STOP_WORDS, OVERLAP_STOP_WORDS):
        got = apply(T.ascii_words(F.col("t"), stop), *WORDS)
        assert [set(g) for g in got] == [python_words(w, stop) for w in WORDS]


def test_two_stop_lists_differ(apply):
    assert apply(T.ascii_words(F.col("t"), NOVELTY_STOP_WORDS), "they more")[0] == ["more"]
    assert apply(T.ascii_words(F.col("t"), OVERLAP_STOP_WORDS), "they more")[0] == ["they"]


def test_novel_word_ratio(spark):
    rows = spark.createDataFrame(
        [("alpha beta gamma delta", "alpha beta gamma newword"), ("alpha", ""), ("alpha", "the a")],
        "o string, n string",
    )
    got = [r[0] for r in rows.select(T.novel_word_ratio(F.col("o"), F.col("n"), [])).collect()]
    assert got == [0.25, 0.0, 0.0]


def test_keyword_overlap_empty_target_is_null(spark):
    rows = spark.createDataFrame([("alpha beta", "alpha word"), ("alpha", "a b")], "p string, t string")
    got = [r[0] for r in rows.select(T.keyword_overlap(F.col("p"), F.col("t"), [])).collect()]
    assert got == [0.5, None]


def test_paragraphs(apply):
    assert apply(T.paragraphs(F.col("t")), "a\n\nb", "a\nb", "a\n\n \n\nb", "\n\n") == [2, 1, 2, 0]


def test_stop_words_are_sparks(spark):
    sparks = StopWordsRemover.loadDefaultStopWords("english")
    assert ENGLISH_STOP_WORDS == [w for w in sparks if re.fullmatch(r"\w\w+", w)]


def python_terms(text, stop):
    words = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in stop]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


TEXTS = ["The quick brown fox and the quick dog", "a b c", "", "one", "Über_x 12 don't stop", None]


def test_terms_drop_stop_words_before_bigrams(apply):
    got = apply(T.terms(F.coalesce("t", F.lit("")), ENGLISH_STOP_WORDS), *TEXTS)
    assert got == [python_terms(t or "", ENGLISH_STOP_WORDS) for t in TEXTS]


def test_term_counts(apply):
    got = apply(T.term_counts(T.terms(F.col("t"), [], 2)), *TEXTS[:-1])
    for value, text in zip(got, TEXTS):
        assert {r["term"]: r["tf"] for r in value} == dict(Counter(python_terms(text, [])))


def test_clipped_matches_are_multiset_intersections(spark):
    rows = spark.createDataFrame(
        [("a a b c", "a b b"), ("", "a"), ("x", "y"), ("q q q", "q q q q")], "p string, r string"
    )
    tokens = [F.filter(F.split(c, " "), lambda x: x != "") for c in ("p", "r")]
    doubled = T.clipped_matches([tuple(tokens), (tokens[0], tokens[0])])
    both = [r[0] for r in rows.select(doubled).collect()]
    assert [b[1] for b in both] == [len(a.split()) for a in ("a a b c", "", "x", "q q q")]
    got = [b[0] for b in both]
    want = [sum((Counter(a.split()) & Counter(b.split())).values())
            for a, b in [("a a b c", "a b b"), ("", "a"), ("x", "y"), ("q q q", "q q q q")]]
    assert got == want


def test_ngrams_shorter_than_n(apply):
    tokens = F.filter(F.split("t", " "), lambda x: x != "")
    assert apply(T.ngrams(tokens, 3), "a b c d", "a b", "") == [["a b c", "b c d"], [], []]


def test_render_keeps_other_braces(spark):
    got = spark.range(1).select(T.render("{ {x} } {y}", x=F.lit("1"), y=F.lit("{x}"))).first()[0]
    assert got == "{ 1 } {x}"


def test_native_text_has_no_python_stage(texts):
    df = texts("a").select(
        T.clean_text(F.col("t")), T.term_counts(T.terms(F.col("t"), ENGLISH_STOP_WORDS)),
        T.keyword_hits(F.col("t"), TECH_KEYWORDS),
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
