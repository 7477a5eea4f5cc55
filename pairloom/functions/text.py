"""Text normalisation, words and n-grams as built-in expressions.

Everything here is narrow: a document is tokenised, counted and compared inside
its own row, so no text crosses a shuffle. ``let`` binds a costly value once;
without it the optimizer may copy the expression into every place that uses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's \s, for patterns that start with (?U): Unicode white space, which Java's \s
# then is, and chr(28) to chr(31), which it lacks.
SPACE = r"[\s\x1c-\x1f]"
WORD_CHAR = r"[\p{L}\p{N}_]"
ENTITY = r"&[a-z]+;"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated exactly once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literals(words: Iterable[str]) -> Column:
    """Array literal of words without tabs. Built as one text that Catalyst splits once,
    at planning; hundreds of single literals would make the plan slow to build."""
    words = list(words)
    if not words:
        return F.array().cast("array<string>")
    return F.split(F.lit("\t".join(words)), "\t")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def clean_text(c: Column) -> Column:
    """Null to empty, whitespace runs to one space, ``&name;`` to a space, trim.

    Entities go after the collapse, so double spaces can remain inside.
    """
    collapsed = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U){SPACE}+", " ")
    return F.trim(F.regexp_replace(collapsed, ENTITY, " "))


def concat_text(*columns: Column) -> Column:
    """Columns joined by one space; a null column counts as empty and keeps its space."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])


def longer_than(c: Column, chars: int) -> Column:
    return F.length(c) > chars


def keyword_hits(c: Column, words: Iterable[str]) -> Column:
    """How many distinct words occur as substrings of the lower-cased text."""
    distinct = literals(dict.fromkeys(words))
    return let(
        F.lower(c),
        lambda lowered: F.size(F.filter(distinct, lambda w: F.contains(lowered, w))),
    )


def mentions_any(c: Column, words: Iterable[str]) -> Column:
    return let(
        F.lower(c),
        lambda lowered: F.exists(literals(words), lambda w: F.contains(lowered, w)),
    )


def ascii_words(c: Column, stop_words: Iterable[str]) -> Column:
    """Set of whole lower-cased words of four or more ASCII letters, minus stop words."""
    found = F.regexp_extract_all(
        F.lower(c), F.lit(rf"(?<!{WORD_CHAR})[a-z]{{4,}}+(?!{WORD_CHAR})"), F.lit(0)
    )
    return F.array_except(found, literals(stop_words))


def shared_share(part: Column, whole: Column) -> Column:
    """size(part) / size(whole), null when ``whole`` is empty."""
    return F.try_divide(F.size(part).cast("double"), F.size(whole).cast("double"))


def novel_word_ratio(original: Column, rewritten: Column, stop_words: Iterable[str]) -> Column:
    """Share of the rewritten word set that the original lacks; 0 when it is empty."""
    stop_words = list(stop_words)
    ratio = let(
        ascii_words(rewritten, stop_words),
        lambda new: shared_share(F.array_except(new, ascii_words(original, stop_words)), new),
    )
    return F.coalesce(ratio, F.lit(0.0))


def keyword_overlaps(prediction: Column, targets: Iterable[Column], stop_words: Iterable[str]) -> Column:
    """``array<double>``: ``keyword_overlap`` for each target, the prediction's words taken once."""
    stop_words = list(stop_words)

    def share(target: Column, made: Column) -> Column:
        return let(
            ascii_words(target, stop_words),
            lambda words: shared_share(F.array_intersect(words, made), words),
        )

    return let(
        ascii_words(prediction, stop_words), lambda made: F.array(*[share(t, made) for t in targets])
    )


def keyword_overlap(prediction: Column, target: Column, stop_words: Iterable[str]) -> Column:
    """Share of the target word set found in the prediction; null when the target is empty."""
    return F.get(keyword_overlaps(prediction, [target], stop_words), F.lit(0))


def paragraphs(c: Column) -> Column:
    """Number of non-blank parts between blank lines."""
    return F.size(F.filter(F.split(c, "\n\n"), lambda p: strip(p) != ""))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n neighbouring tokens, joined by one space."""
    if n == 1:
        return tokens

    def join(t: Column) -> Column:
        count = F.greatest(F.size(t) - (n - 1), F.lit(0))
        grams = F.slice(t, F.lit(1), count)
        for offset in range(1, n):
            grams = F.zip_with(
                grams, F.slice(t, F.lit(1 + offset), count), lambda a, b: F.concat(a, F.lit(" "), b)
            )
        return grams

    return let(tokens, join)


def terms(c: Column, stop_words: Iterable[str], max_n: int = 2) -> Column:
    """Lower-cased word runs of two or more characters, then n-grams up to ``max_n``.

    Stop words leave before n-grams are formed. ``isin`` on literals becomes a hash
    lookup, so the list length does not matter.
    """
    stop_words = list(stop_words)
    words = F.regexp_extract_all(F.lower(c), F.lit(rf"{WORD_CHAR}{{2,}}"), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(stop_words))
    if max_n == 1:
        return words
    return let(words, lambda w: F.concat(*[ngrams(w, n) for n in range(1, max_n + 1)]))


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of one row's tokens: sort, then read run lengths."""

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(
                ordered,
                lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i),
            ),
            lambda i: i.isNotNull(),
        )
        return let(
            starts,
            lambda s: F.zip_with(
                s,
                F.concat(
                    F.slice(s, F.lit(2), F.size(s)), F.array(F.size(ordered))
                ),
                lambda a, b: F.when(
                    a.isNotNull(), F.struct(F.get(ordered, a).alias("term"), (b - a).alias("tf"))
                ),
            ),
        )

    return F.filter(let(F.sort_array(tokens), runs), lambda x: x.isNotNull())


def numbered(tokens: Column) -> Column:
    """Tokens with their occurrence number, so a multiset becomes a set.

    The intersection of two numbered lists is then the clipped match count.
    """
    return F.flatten(
        F.transform(
            term_counts(tokens),
            lambda x: F.transform(
                F.sequence(F.lit(1), x["tf"]), lambda i: F.concat(x["term"], F.lit("\t"), i.cast("string"))
            ),
        )
    )


def clipped_matches(pairs: list[tuple[Column, Column]]) -> Column:
    """``array<int>``: for each pair of token lists the size of the multiset intersection."""
    sides = F.array(*[F.array(a, b) for a, b in pairs])
    return F.transform(
        sides,
        lambda pair: let(
            F.transform(pair, numbered),
            lambda n: F.size(F.array_intersect(F.get(n, F.lit(0)), F.get(n, F.lit(1)))),
        ),
    )


def render(template: str, **fields: Column) -> Column:
    """Fill ``{name}`` fields of a template. Callers settle nulls: one null field
    makes the whole text null."""
    parts: list[Column] = []
    rest = template
    while fields:
        hits = [(rest.find("{" + name + "}"), name) for name in fields]
        hits = [(at, name) for at, name in hits if at >= 0]
        if not hits:
            break
        at, name = min(hits)
        parts += [F.lit(rest[:at]), fields[name]]
        rest = rest[at + len(name) + 2:]
    parts.append(F.lit(rest))
    return F.concat(*parts)
