"""Porter's suffix stripping (1980) with the extensions common in Python NLP tools.

A small per-word helper; words are stemmed by the thousand, once per distinct word
of an Arrow batch, through ``stem_tokens``.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

VOWELS = "aeiou"

# Words that do not follow the rules.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# Suffix pairs of steps 2, 3 and 4, longest match first where they overlap.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
STEP_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """One letter per character: v or c; y is a vowel after a consonant."""
    shape = ""
    for i, letter in enumerate(word):
        vowel = letter in VOWELS or (letter == "y" and i > 0 and shape[-1] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Ends consonant-vowel-consonant, the last not w, x or y; or a vowel-consonant pair alone."""
    shape = _shape(word)
    return (shape[-3:] == "cvc" and word[-1] not in "wxy") or shape == "vc"


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    for suffix, cut in (("sses", 2), ("ies", 2), ("ss", 0), ("s", 1)):
        if word.endswith(suffix):
            return word[:len(word) - cut]
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix) and _has_vowel(word[:-len(suffix)]):
            stem = word[:-len(suffix)]
            break
    else:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_consonant(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _final_y(word: str) -> str:
    ends = word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c"
    return word[:-1] + "i" if ends else word


def _replace(word: str, pairs: list[tuple[str, str]]) -> str:
    for suffix, new in pairs:
        if word.endswith(suffix):
            stem = word[:-len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


def _derived(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derived(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _replace(word, STEP_2)


def _residue(word: str) -> str:
    for suffix in STEP_4:
        if word.endswith(suffix):
            stem = word[:-len(suffix)]
            if suffix == "ion" and stem[-1:] not in ("s", "t"):
                return word
            return stem if _measure(stem) > 1 else word
    return word


def _final_e(word: str) -> str:
    if not word.endswith("e"):
        return word
    stem = word[:-1]
    if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
        return stem
    return word


def _final_l(word: str) -> str:
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _final_y(_past(_plural(word)))
    word = _replace(_derived(word), STEP_3)
    return _final_l(_final_e(_residue(word)))


def _stem_batch(tokens: pa.Array) -> pa.Array:
    flat = pc.dictionary_encode(tokens.flatten())
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    stems = [stem(w) if len(w) > 3 else w for w in flat.dictionary.to_pylist()]
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(tokens), 0))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, pa.array(stems, pa.string()).take(flat.indices))


@F.arrow_udf(ArrayType(StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Token lists with every token of four or more characters stemmed."""
    return _stem_batch(tokens)
