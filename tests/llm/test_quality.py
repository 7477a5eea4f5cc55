import math
import re
from collections import Counter

from pyspark.sql import functions as F

from pairloom.llm.quality import judge_quality
from tests.llm.conftest import EDGES, by_id, prose


def base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
    }


TEXTS = [
    *EDGES, (20, "a b c a b c a b"), (21, "x x x x x"), (22, "l1\nl1\n \n \nl2\nl1 "), (23, "#$% <b> && | *"),
    (24, " ".join(["same words here now"] * 40)), (25, "a\x0bb\x0cc\x1cd\x85e"), (26, "\n".join(["line one", "line two"] * 30)),
]


def test_base_counts(documents):
    got = by_id(judge_quality(documents(TEXTS)))
    want = sorted(({"doc_id": i, **base(t)} for i, t in TEXTS), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    key = lambda r: tuple(str(r[c]) for c in ("doc_id", *base("")))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_distance_and_verdict(documents):
    clean = [(i, "The cat is in " + " and the ".join(prose(i, 120, 9000)) + ".") for i in range(100, 160)]
    junk = [(500, " ".join(w.upper() + "###$$$" for w in prose(9, 200, 9000))), (501, " ".join("is" if k % 2 else w for k, w in enumerate(prose(3, 300, 9000))))]
    rows = {r["doc_id"]: r for r in by_id(judge_quality(documents([*clean, *junk])))}
    assert all(rows[i]["kept"] for i, _ in clean)
    assert not rows[500]["kept"] and rows[500]["class_distance"] > 0.3
    assert not rows[501]["kept"] and rows[501]["word_distance"] > 0.6
    # by hand: the word shares of one document against those of all that pass the base rule
    from pairloom.llm.quality import _vocabulary
    counts = {i: Counter(w[0].lower() + w[1:] for w in t.split()) for i, t in [*clean, *junk]}
    total = sum(counts.values(), Counter())
    p, q = ([c[w] for w in _vocabulary()] for c in (counts[501], total))
    p, q = ([x / sum(c) for x in c] for c in (p, q))
    d = sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q, strict=True)) / 2
    assert math.isclose(math.sqrt(d), rows[501]["word_distance"], rel_tol=1e-9)


def test_empty(documents):
    assert judge_quality(documents([])).count() == 0


def test_long_texts_without_common_words_and_small_languages(documents):
    clean = [(i, "The cat is in " + " and the ".join(prose(i, 120, 9000)) + ".") for i in range(100, 160)]
    bare = [(500, " ".join(w + "x" for w in prose(9, 496, 9000)) + ".")]
    rows = {r["doc_id"]: r for r in by_id(judge_quality(documents([*clean, *bare])))}
    assert all(rows[i]["kept"] for i, _ in clean)
    assert rows[500]["class_distance"] < 0.3 and not rows[500]["base_failed"] and not rows[500]["kept"]
    # a corpus of two texts is no reference by itself
    junk = " ".join(w.upper() + "##$$" for w in prose(4, 60, 9000))
    plain = " ".join("the of and to in".split()[k // 5 % 5] if k % 5 == 0 else w + "x" for k, w in enumerate(prose(5, 120, 9000))) + "."
    rows = {r["doc_id"]: r for r in by_id(judge_quality(documents([(1, junk), (2, plain)])))}
    assert not rows[1]["base_failed"] and not rows[1]["kept"] and rows[2]["kept"]
    # a language without a fixed reference has its own texts
    own = documents([(1, " ".join(w + "ω" for w in prose(4, 200, 9000)))]).withColumn("lang", F.lit("el"))
    assert by_id(judge_quality(own))[0]["kept"]
