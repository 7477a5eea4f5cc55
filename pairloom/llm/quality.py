"""Distribution divergence: documents against the letter and word profile of their language.

Every document gets three histograms: its characters by class, its common function words, and
its profile, the same words with one class more for all other words. The reference of a language
is the sum over all its documents that pass the base rule; where that holds few counts, a fixed
reference of the language fills it up. A document is kept if its histograms lie within a Jensen-Shannon distance (base 2
logarithm, square root, so 0 to 1) of the reference. Short texts have noisy histograms;
below a stated length they are not judged by them.

Base counts and histograms are built-in expressions inside the document's own row. No text is
shuffled: the counts alone are stored, then summed per language with a combine on each task,
and the few sums come back by a join on the language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import let
from pairloom.llm.text import SPACES, once
from pairloom.session import stored

# Frequent function words of four languages.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split(),
    "en": "the of and to in a is that for it as was with be by on are from at this".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
}
# Character classes; letters beyond ASCII follow, and lower-case letters, spaces
# and all others are what remains.
CLASSES = {
    "upper": "A-Z", "digit": "0-9", "punctuation": ".,;:!?'\"()\\-", "symbol": "#*$%&|<>@+=/\\\\^_`~{}\\[\\]",
}
# Shares of upper-case letters, digits, punctuation, symbols, letters beyond ASCII,
# lower-case letters, spaces and others, and of common words among all, in ordinary text.
CLASS_SHARES = {
    "de": [0.018, 0.001, 0.024, 0.019, 0.037, 0.748, 0.153, 0.0], "en": [0.025, 0.001, 0.027, 0.02, 0.0, 0.763, 0.164, 0.0],
    "es": [0.022, 0.001, 0.027, 0.02, 0.076, 0.696, 0.158, 0.0], "fr": [0.024, 0.001, 0.03, 0.018, 0.087, 0.675, 0.165, 0.0],
}
COMMON_SHARE = 0.215
MIN_WORDS = 50
WINDOW = 3


def _vocabulary() -> list[str]:
    return sorted({w for listed in COMMON_WORDS.values() for w in listed})


def _fixed_shares() -> dict[str, dict[str, list[float]]]:
    """The fixed reference of every histogram and language. Common words are listed by
    frequency; the k-th has a share as 1 / (k + 1)."""
    common = {}
    for lang, listed in COMMON_WORDS.items():
        weights = {w: 1 / (k + 2) for k, w in enumerate(dict.fromkeys(listed))}
        common[lang] = [weights.get(w, 0.0) / sum(weights.values()) for w in _vocabulary()]
    return {
        "classes": CLASS_SHARES, "common": common,
        "profile": {lang: [*[COMMON_SHARE * x for x in own], 1 - COMMON_SHARE] for lang, own in common.items()},
    }


def _reference(counts: str, lang: str, fixed: dict[str, list[float]], least: int) -> Column:
    """Shares of a language's sums; what they lack to ``least`` counts comes from its fixed shares, if it has any."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    listed = F.lit(None).cast("array<double>")
    for name, own in fixed.items():
        listed = F.when(F.col(lang) == name, F.array(*[F.lit(float(x)) for x in own])).otherwise(listed)
    filled = let(total, lambda n: F.zip_with(
        counts, listed, lambda c, x: (c + x * F.greatest(F.lit(0), least - n)) / F.greatest(n, F.lit(least))))
    return F.coalesce(filled, shares(F.col(counts)))


def _class_counts(rest: str) -> list[Column]:
    """Counts of the classes other than lower-case letters and spaces, in what those leave."""
    patterns = [f"[^{c}]+" for c in CLASSES.values()] + ["[^\\p{L}\\p{M}]+|[a-zA-Z]+"]
    return [F.length(F.regexp_replace(rest, p, "")).cast("long") for p in patterns]


def _common_words(words_col: str) -> tuple[Column, list[str]]:
    """The common words of a text (small or with a first capital) as one letter each, and the
    letters in order of the words: counting is then a byte search in a short string.
    """
    listed = _vocabulary()
    letters = [chr(0x30 + k) for k in range(len(listed))]
    signs = {form: sign for w, sign in zip(listed, letters, strict=True) for form in (w, w.capitalize())}
    quoted = ", ".join(f"'{w}'" for w in signs)
    table = ", ".join(f"'{w}', '{s.replace(chr(92), chr(92) * 2)}'" for w, s in signs.items())
    coded = F.expr(
        f"array_join(transform(filter({words_col}, w -> w in ({quoted})),"
        f" w -> element_at(map({table}), w)), '')"
    )
    return once(coded), letters


def _covered(windows: str, sorted_windows: str) -> Column:
    """Words inside windows that occur twice or more: every such window start covers three
    words, or as many as there are to the next such start."""
    return F.expr(f"""
        aggregate(transform({sorted_windows}, (at, i) ->
            least({WINDOW}, coalesce(get({sorted_windows}, i + 1) - at, {WINDOW}))), 0, (a, x) -> a + x)
    """).cast("long")


def document_counts(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Base counts and both histograms of each whole text. Windows are compared by a 64-bit hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"),
        once(F.array_remove(F.split(text, SPACES), "")).alias("w"),
    )
    coded, signs = _common_words("w")
    rows = rows.select(
        "doc_id", "lang", "text", "w", F.length("text").cast("long").alias("n_chars"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"), coded.alias("coded"),
    )
    rows = rows.select("*", once(F.regexp_replace("text", "[a-z\\x20\\x09-\\x0D]+", "")).alias("rest"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    rest = F.length("rest").cast("long")
    rows = rows.select(
        "doc_id", "lang", "w", F.size("w").cast("long").alias("n_words"), "word_chars", "n_chars",
        F.length(F.regexp_replace("rest", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.array(
            *_class_counts("rest"), (F.col("word_chars") - rest), (F.col("n_chars") - F.col("word_chars")),
        ).alias("classes"),
        F.array(*[
            (F.length("coded") - F.length(F.replace("coded", F.lit(s), F.lit("")))).cast("long")
            for s in signs
        ]).alias("common"),
        once(lines).alias("lines"),
    )
    rows = rows.select(
        *[c for c in rows.columns if c != "lines"],
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        once(F.expr(f"""
            if(size(w) < {WINDOW}, cast(array() as array<bigint>),
               transform(slice(w, 1, size(w) - {WINDOW - 1}),
                         (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))))
        """)).alias("h"),
    )
    rows = rows.select(
        *[c for c in rows.columns if c not in ("w", "h")],
        once(F.expr("""
            if(size(array_distinct(h)) = size(h), array(),
               sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i))))
        """)).alias("s"),
    )
    rows = rows.select(
        *[c for c in rows.columns if c != "s"],
        once(F.expr("""
            sort_array(transform(filter(s, (x, i) -> coalesce(x.h = get(s, i - 1).h, false)
                or coalesce(x.h = get(s, i + 1).h, false)), x -> x.i))
        """)).alias("p"),
    )
    return rows.select(*[c for c in rows.columns if c != "p"], _covered("h", "p").alias("n_repeat_words"))


def shares(counts: Column) -> Column:
    """Counts divided by their sum; null where there is none."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return let(total, lambda n: F.when(n > 0, F.transform(counts, lambda x: x / n)))


def js_distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares; null where one of them is null."""
    def part(p, q):
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    terms = F.zip_with(left, right, lambda p, q: part(p, q) + part(q, p))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def judge_quality(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    most_class_distance: float = 0.3, most_word_distance: float = 0.6, min_chars: int = 300,
    min_common: int = 30, min_reference: int = 5000, most_profile_distance: float = 0.3, min_words: int = 100,
) -> DataFrame:
    """One row per row of ``docs``: id, base counts, all distances, base_failed, kept.

    A text fails the base rule under 50 words or with more than half of its words in
    repeated three-word windows. Any other text is kept unless a distance is over its bound;
    the class distance is looked at from ``min_chars`` characters on, the word distance from
    ``min_common`` common words on, and the profile distance from ``min_words`` words on, however few of
    them are common. A reference of less than ``min_reference`` counts is filled up from the fixed one; a
    language without one has its own documents alone. A null or empty text has no words and fails the base rule. A null language
    is a language of its own. Null ids, repeated rows and repeated ids stay as they are; other
    columns are left out. An empty table gives no rows.
    """
    counts = stored(
        document_counts(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                    | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        # the last class: all characters that none of the others holds
        .withColumn("classes", F.expr(
            "concat(classes, array(n_chars - aggregate(classes, 0L, (a, x) -> a + x)))"))
        # all words that are not common
        .withColumn("profile", F.expr(
            "concat(common, array(n_words - aggregate(common, 0L, (a, x) -> a + x)))")),
        "quality",
    )
    sizes = {"classes": len(CLASSES) + 4, "common": len(_vocabulary()), "profile": len(_vocabulary()) + 1}
    sums = counts.filter(~F.col("base_failed")).groupBy("lang").agg(*[
        F.sum(F.get(name, F.lit(i))).alias(f"{name}{i}") for name, n in sizes.items() for i in range(n)
    ]).select(F.col("lang").alias("of"), *[
        F.array(*[F.col(f"{name}{i}") for i in range(n)]).alias(f"all_{name}") for name, n in sizes.items()
    ])
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    fixed = _fixed_shares()
    sums = sums.select("of", *[
        _reference(f"all_{name}", "of", fixed[name], min_reference).alias(f"{name}_reference") for name in sizes
    ])
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    class_far = (
        (F.col("n_chars") >= min_chars) & (F.col("class_distance") > most_class_distance)
    )
    word_far = (
        (total("common") >= min_common) & (F.col("word_distance") > most_word_distance)
    )
    profile_far = (F.col("n_words") >= min_words) & (F.col("profile_distance") > most_profile_distance)
    return (
        counts.join(sums, F.col("lang").eqNullSafe(F.col("of")), "left")
        .select("*", once(F.struct(
            js_distance(shares(F.col("classes")), F.col("classes_reference")).alias("class_distance"),
            js_distance(shares(F.col("common")), F.col("common_reference")).alias("word_distance"),
            js_distance(shares(F.col("profile")), F.col("profile_reference")).alias("profile_distance"),
        )).alias("far"))
        .select("*", "far.*")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & ~F.coalesce(class_far, F.lit(False)) & ~F.coalesce(word_far, F.lit(False))
             & ~F.coalesce(profile_far, F.lit(False))).alias("kept"),
            "class_distance", "word_distance", "profile_distance",
        )
    )
