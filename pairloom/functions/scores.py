"""Row scores of a prediction against a reference."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from pairloom.functions.text import SPACE, let


def rouge_tokens(c: Column) -> Column:
    """Runs of lower-case ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def bleu_tokens(c: Column) -> Column:
    """The mteval-v13a tokeniser: split off symbols, and marks not inside numbers."""
    c = F.coalesce(c, F.lit(""))
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    for old, new in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for pattern, new in (
        # the published class has the space too; more spaces beside one change no token
        (r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", " $1 "),
        (r"([^0-9])([\.,])", "$1 $2 "),
        (r"([\.,])([^0-9])", " $1 $2"),
        (r"([0-9])(-)", "$1 $2 "),
    ):
        c = F.regexp_replace(c, pattern, new)
    return F.filter(F.split(c, rf"(?U){SPACE}+"), lambda t: t != "")


def f_measure(matches: Column, made: Column, wanted: Column) -> Column:
    """``struct<precision, recall, fmeasure>`` from counts; 0 where there is nothing."""
    shares = let(
        matches.cast("double"),
        lambda m: F.struct(
            (m / F.greatest(made, F.lit(1))).alias("precision"),
            (m / F.greatest(wanted, F.lit(1))).alias("recall"),
        ),
    )
    return let(
        shares,
        lambda s: F.struct(
            s["precision"].alias("precision"),
            s["recall"].alias("recall"),
            F.coalesce(
                F.try_divide(
                    s["precision"] * s["recall"] * 2, s["precision"] + s["recall"]
                ),
                F.lit(0.0),
            ).alias("fmeasure"),
        ),
    )


def lcs(a: list, b: list) -> int:
    """Longest common subsequence, one whole-row bit operation per token of ``a``
    (Hyyro 2004): a zero bit of ``row`` marks one step of the subsequence."""
    places: dict = {}
    for i, token in enumerate(b):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for token in a:
        hits = row & places.get(token, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(b) - row.bit_count()


def _places(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands in the sorted ``known``, -1 where it does not."""
    if not len(known):
        return np.full(len(keys), -1)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[place] == keys, place, -1)


@dataclass(frozen=True)
class _Side:
    """Tokens of a batch that both lists of their row have: row, position in the batch, number."""

    row: np.ndarray
    at: np.ndarray
    token: np.ndarray


def _shared(made: pa.Array, wanted: pa.Array) -> tuple[_Side, _Side, int]:
    """Both sides' shared tokens, and how many numbers there are. A number stands for a token of one row."""
    flat = pa.concat_arrays([made.flatten(), wanted.flatten()])
    words = pc.dictionary_encode(flat, null_encoding="encode")
    rows = [
        np.repeat(np.arange(len(x)), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False))
        for x in (made, wanted)
    ]
    keys = np.concatenate(rows) * max(len(words.dictionary), 1) + words.indices.to_numpy(zero_copy_only=False)
    cut = len(rows[0])
    known = np.unique(keys[cut:])
    place = _places(known, keys[:cut])
    seen = np.zeros(len(known), bool)
    seen[place[place >= 0]] = True
    sides = []
    for row, token in zip(rows, (place, np.searchsorted(known, keys[cut:]))):
        at = np.flatnonzero((token >= 0) & seen[token] if len(known) else token >= 0)
        sides.append(_Side(row[at], at, token[at]))
    return sides[0], sides[1], len(known)


def clipped_counts(made: pa.Array, wanted: pa.Array, most: int) -> np.ndarray:
    """Rows times ``most``: n-grams that both token lists of a row have, each as often as both have it.

    A shared n-gram has only shared tokens, so all others leave first. An n-gram's number
    stands for its first n - 1 tokens and its last one.
    """
    *sides, numbers = _shared(made, wanted)
    found = np.zeros((len(made), most), np.int64)
    starts = [np.arange(len(x.at)) for x in sides]
    grams = [x.token for x in sides]
    for n in range(1, most + 1):
        if n > 1:
            for i, x in enumerate(sides):
                start, last = starts[i], starts[i] + n - 1
                fits = last < len(x.at)
                start, last, gram = start[fits], last[fits], grams[i][fits]
                # neighbours in one row: shared tokens follow each other without a gap
                fits = (x.at[last] - x.at[start] == n - 1) & (x.row[last] == x.row[start])
                starts[i], grams[i] = start[fits], gram[fits] * numbers + x.token[last[fits]]
        known, first, wants = np.unique(grams[1], return_index=True, return_counts=True)
        place = _places(known, grams[0])
        hit = place >= 0
        has = np.bincount(place[hit], minlength=len(known))
        row = sides[1].row[starts[1][first]]
        found[:, n - 1] = np.bincount(row, weights=np.minimum(has, wants), minlength=len(made))
        # only what both sides have can grow
        starts[0], grams[0] = starts[0][hit], place[hit]
        both = _places(known, grams[1])
        both = np.where(has[both] > 0, both, -1) if len(known) else both
        starts[1], grams[1] = starts[1][both >= 0], both[both >= 0]
    return found


def ngram_matches(made: Column, wanted: Column, most: int) -> Column:
    """``array<int>``: for n = 1 to ``most`` the size of the multiset intersection of two token lists' n-grams."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def ngram_matches(made: pa.Array, wanted: pa.Array) -> pa.Array:
        counts = clipped_counts(made, wanted, most).astype(np.int32)
        return pa.FixedSizeListArray.from_arrays(pa.array(counts.ravel()), most).cast(pa.list_(pa.int32()))

    return ngram_matches(made, wanted)


@F.arrow_udf(IntegerType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """Row-wise LCS length of two token lists of any length; tokens that only one has take no part."""
    *sides, _ = _shared(a, b)
    ends = [np.searchsorted(x.row, np.arange(len(a) + 1)) for x in sides]
    made, wanted = [
        [x.token[i:j].tolist() for i, j in zip(end[:-1], end[1:])] for x, end in zip(sides, ends)
    ]
    return pa.array([lcs(x, y) for x, y in zip(made, wanted)], pa.int32())


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double; 0 when either has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0), lambda total, v: total + v,
        )

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))
