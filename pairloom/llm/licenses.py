"""License scan by ordered signature rules over normalised words.

A text becomes its lower-cased words joined by single spaces, so that layout, punctuation
and comment marks don't matter. Every rule is a regex with a priority, a confidence and a
literal keyword; only rules whose keyword the text contains are run. Names times context
forms give some hundreds of rules, and full-text signatures come first. A detection that
lies inside the word interval of a better one (lower priority number, then longer, then
the earlier rule) is suppressed. Base phrases are never suppressed.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairloom.llm.batches import map_texts

# Base phrases, whose labels always count.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

VERSION = r"(?:version |v )?"
# Label, keyword that has to be in the text, name as it reads after normalisation.
NAMES = [
    ("0bsd", "0bsd", r"0bsd|zero clause bsd"),
    ("afl-3", "academic free", r"academic free license " + VERSION + r"3(?: 0)?"),
    ("agpl-3", "affero", r"gnu affero general public license(?: " + VERSION + r"3(?: 0)?)?"),
    ("agpl-3", "agpl", r"agpl ?" + VERSION + r"3(?: 0)?"),
    ("apache-1", "apache", r"apache(?: software)?(?: license)? " + VERSION + r"1(?: [01])?"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)? " + VERSION + r"2(?: 0)?"),
    ("artistic-1", "artistic", r"artistic(?: license)? " + VERSION + r"1(?: 0)?"),
    ("artistic-2", "artistic", r"artistic(?: license)? " + VERSION + r"2(?: 0)?"),
    ("beerware", "beer", r"beer ?ware"),
    ("blueoak-1", "blue oak", r"blue oak model license(?: 1 0 0)?"),
    ("bsd-1", "bsd", r"(?:bsd 1 clause|1 clause bsd)"),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd", "bsd", r"bsd"),
    ("bsl-1", "boost", r"boost software(?: license)?(?: " + VERSION + r"1(?: 0)?)?"),
    ("busl-1", "business source", r"business source license(?: " + VERSION + r"1(?: 1)?)?"),
    ("cc-by-nc-nd", "nd", r"cc by nc nd"),
    ("cc-by-nc-nd", "noderiv", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "sa", r"cc by nc sa"),
    ("cc-by-nc-sa", "alike", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "nc", r"cc by nc"),
    ("cc-by-nc", "commercial", r"creative commons attribution non ?commercial"),
    ("cc-by-nd", "nd", r"cc by nd"),
    ("cc-by-nd", "noderiv", r"creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by-sa", "sa", r"cc by sa"),
    ("cc-by-sa", "alike", r"creative commons attribution share ?alike"),
    ("cc-by", "cc by", r"cc by"),
    ("cc-by", "creative commons", r"creative commons attribution"),
    ("cc0", "cc0", r"cc0"),
    ("cc0", "creative commons", r"creative commons (?:zero|public domain)"),
    ("cddl-1", "cddl", r"cddl(?: " + VERSION + r"1(?: [01])?)?"),
    ("cddl-1", "common development", r"common development and distribution license(?: " + VERSION + r"1(?: [01])?)?"),
    ("cecill-2", "cecill", r"cecill(?: " + VERSION + r"2(?: 1)?)?"),
    ("cpl-1", "common public", r"common public license(?: " + VERSION + r"1(?: 0)?)?"),
    ("ecl-2", "educational", r"educational community license(?: " + VERSION + r"2(?: 0)?)?"),
    ("epl-1", "eclipse", r"eclipse public license " + VERSION + r"1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public license " + VERSION + r"2(?: 0)?"),
    ("eupl-1", "european union", r"european union public licen[cs]e(?: " + VERSION + r"1(?: [012])?)?"),
    ("gfdl-1", "free documentation", r"gnu free documentation license(?: " + VERSION + r"1(?: [123])?)?"),
    ("gpl-1", "gpl", r"gpl ?" + VERSION + r"1(?: 0)?"),
    ("gpl-2", "gpl", r"gpl ?" + VERSION + r"2(?: 0)?"),
    ("gpl-3", "gpl", r"gpl ?" + VERSION + r"3(?: 0)?"),
    ("gpl-2", "general public", r"(?:gnu )?general public license " + VERSION + r"2(?: 0)?"),
    ("gpl-3", "general public", r"(?:gnu )?general public license " + VERSION + r"3(?: 0)?"),
    ("gpl", "general public", r"gnu general public license"),
    ("isc", "isc", r"isc"),
    ("lgpl-2", "lgpl", r"lgpl ?" + VERSION + r"2(?: [01])?"),
    ("lgpl-3", "lgpl", r"lgpl ?" + VERSION + r"3(?: 0)?"),
    ("lgpl-2", "general public", r"gnu (?:lesser|library) general public license " + VERSION + r"2(?: [01])?"),
    ("lgpl-3", "general public", r"gnu lesser general public license " + VERSION + r"3(?: 0)?"),
    ("lgpl", "general public", r"gnu (?:lesser|library) general public license"),
    ("lppl-1", "project public", r"latex project public license(?: " + VERSION + r"1(?: 3[abc]?)?)?"),
    ("mit-0", "mit", r"mit (?:0|no attribution)"),
    ("mit", "mit", r"(?:mit|expat)(?: x11)?"),
    ("mpl-1", "mozilla", r"mozilla public license " + VERSION + r"1(?: [01])?"),
    ("mpl-2", "mozilla", r"mozilla public license " + VERSION + r"2(?: 0)?"),
    ("mpl-2", "mpl", r"mpl ?" + VERSION + r"2(?: 0)?"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("odbl-1", "open database", r"open database license(?: " + VERSION + r"1(?: 0)?)?"),
    ("ofl-1", "open font", r"(?:sil )?open font license(?: " + VERSION + r"1(?: [01])?)?"),
    ("osl-3", "open software", r"open software license " + VERSION + r"3(?: 0)?"),
    ("php-3", "php", r"php license(?: " + VERSION + r"3(?: 0)?1?)?"),
    ("psf-2", "python", r"python software foundation(?: license)?(?: " + VERSION + r"2)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("upl-1", "universal permissive", r"universal permissive license(?: " + VERSION + r"1(?: 0)?)?"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("x11", "x11", r"x11"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("zpl-2", "zope", r"zope public license(?: " + VERSION + r"2(?: [01])?)?"),
]
# Priority, confidence, form. Lower numbers are stronger.
FORMS = [
    (2, 0.99, r"spdx license identifier (?:{name})"),
    (3, 0.95, r"(?:licen[sc]ed|released|distributed|available|published|redistributed|provided) under (?:the )?"
              r"(?:terms (?:of|and conditions of) )?(?:the )?(?:{name})(?: licen[sc]e)?"),
    (4, 0.9, r"under (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?(?:{name})(?: [0-9]+){{0,3}} licen[sc]e"),
    (5, 0.75, r"(?:{name})(?: [0-9]+){{0,3}} licen[sc]e"),
    (5, 0.75, r"licen[sc]e (?:is )?(?:the )?(?:{name})"),
]
# Sentences of the licenses themselves.
SENTENCES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("mpl-2", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1", "boost software", r"distributed under the boost software license version 1 0"),
    ("apache-2", "apache org", r"www apache org licenses license 2 0"),
    ("cc0", "no rights reserved", r"no rights reserved"),
    ("proprietary", "rights reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|unauthorized copying of this file)"),
    ("public-domain", "public domain", r"(?:released into|placed in|dedicated to) the public domain"),
]
BASE_CONFIDENCE = 0.9
_WORD_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32
    for b in range(256)
)


def signature_rules() -> list[tuple[int, float, str, bytes, re.Pattern]]:
    """(priority, confidence, label, keyword, regex) of every rule, in order."""
    def whole(pattern):
        return re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])")

    rules = [(1, 0.97, label, key.encode(), whole(p)) for label, key, p in SENTENCES]
    rules += [
        (priority, confidence, label, key.encode(), whole(form.format(name=name)))
        for priority, confidence, form in FORMS for label, key, name in NAMES
    ]
    return rules


def normalise(text: str) -> bytes:
    """Words (ASCII letters and digits, and all beyond ASCII), A-Z lower-cased, one space between."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split())


def unsuppressed(found: list[tuple]) -> list[tuple]:
    """Detections (start, end, rank, ...) that lie inside no better-ranked one.

    ``rank`` orders detections, better first. One sweep by start: only intervals that
    still reach the current start are looked at, and each rule has at most one of those.
    """
    kept, open_ = [], []
    for one in sorted(found, key=lambda d: (d[0], -d[1], d[2])):
        open_ = [o for o in open_ if o[1] > one[0]]
        if not any(o[1] >= one[1] and o[2] < one[2] for o in open_):
            kept.append(one)
        open_.append(one)
    # of equal intervals the better comes first; a longer one with the same start also does
    return kept


def _word_index(words: bytes):
    """Number of the word that starts at a place of the normalised text."""
    spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    return lambda at: int(np.searchsorted(spaces, at))


class Scanner:
    """Scans normalised texts; rules with the same keyword share one look for it."""

    def __init__(self):
        self.by_keyword: dict[bytes, list] = {}
        for order, (priority, confidence, label, key, regex) in enumerate(signature_rules()):
            self.by_keyword.setdefault(key, []).append((order, priority, confidence, label, regex))
        self.base = [(p.encode(), re.compile(rb"(?<![^ ])" + p.encode() + rb"(?![^ ])"), label) for p, label in BASE.items()]

    def detections(self, text: bytes) -> list[tuple[int, int, tuple, str, float]]:
        """(start, end, rank, label, confidence) in characters of the normalised text."""
        found = []
        for key, rules in self.by_keyword.items():
            if key in text:
                for order, priority, confidence, label, regex in rules:
                    for m in regex.finditer(text):
                        rank = (priority, m.start() - m.end(), order)
                        found.append((m.start(), m.end(), rank, label, confidence))
        return unsuppressed(found)

    def scan(self, text: str) -> tuple:
        words = normalise(text)
        places = [(m.start(), label) for key, regex, label in self.base if key in words for m in regex.finditer(words)]
        found = self.detections(words)
        best = {label: BASE_CONFIDENCE for _, label in places}
        for *_, label, confidence in found:
            best[label] = max(best.get(label, 0.0), confidence)
        miss = 1.0
        for confidence in best.values():
            miss *= 1 - confidence
        word_at = _word_index(words) if best else None
        starts = [at for at, _ in places]
        return (
            words.count(b" ") + 1 if words else 0, len(places),
            word_at(min(starts)) if starts else None, word_at(max(starts)) if starts else None,
            ",".join(sorted({label for _, label in places})), ",".join(sorted(best)),
            round(1 - miss, 9) if best else 0.0,
            [{"label": label, "start": word_at(a), "end": word_at(b - 1) + 1, "priority": rank[0], "confidence": c}
             for a, b, rank, label, c in found],
        )


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, and ``detections`` (label, word interval, priority, confidence).

    Whole texts, in bounded pieces of each task; nothing is shuffled. A null or empty text
    has no words, empty labels, null positions and score 0. Null ids, repeated rows and
    ids stay as they are; other columns are left out. Equal detections of one place are settled by
    priority, then length, then rule order. An empty table gives no rows. ``score`` is one minus the
    product of one minus each label's best confidence.
    """
    one = T.StructType([
        T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()), T.StructField("priority", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
    ])
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()), T.StructField("detections", T.ArrayType(one)),
    ]
    names = [f.name for f in fields]

    def make():
        scanner = Scanner()

        def work(texts):
            rows = [scanner.scan(t) for t in texts]
            return {name: [r[k] for r in rows] for k, name in enumerate(names)}

        return work

    return map_texts(docs, make, fields, id_col=id_col, text_col=text_col)
