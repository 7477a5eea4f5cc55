import re

from pairloom.llm.licenses import scan_licenses, signature_rules, unsuppressed
from tests.llm.conftest import EDGES, by_id

BASE = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
CASES = [
    *EDGES, (20, "Released under the MIT License."), (21, "Apache License, Version 2.0; under the MIT/license CC-BY-NC cc by nc"),
    (22, "This is licensed under the GNU General Public License, version 3."), (23, "// SPDX-License-Identifier: BSD-3-Clause"),
    (24, "submit license version"), (25, "Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software"),
    (26, "CC BY-NC-SA 4.0 license"), (27, "under the mit license " * 500), (28, "ünder the mit license undér the mit license"),
]


def base(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for p, label in BASE.items() for i in range(len(words)) if tuple(words[i:i + len(p)]) == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base(documents):
    got = [(r["doc_id"], *[r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")]) for r in by_id(scan_licenses(documents(CASES)))]
    assert sorted(map(str, got)) == sorted(str((i, *base(t))) for i, t in CASES)


def test_labels_and_scores(documents):
    rows = {r["doc_id"]: r for r in by_id(scan_licenses(documents(CASES)))}
    assert rows[22]["labels"] == "gpl-3" and rows[23]["labels"] == "bsd-3" and rows[24]["labels"] == "" and rows[25]["labels"] == "mit"
    assert rows[26]["labels"] == "cc-by-nc,cc-by-nc-sa" and rows[21]["labels"] == "apache-2,cc-by-nc,mit"
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in rows.values())
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in rows.values())
    assert [(d["start"], d["end"]) for d in rows[20]["detections"]] == [(0, 5)]


def test_suppression_against_all_pairs():
    import random
    rng = random.Random(3)
    for _ in range(200):
        found = []
        for order in range(12):
            a = rng.randint(0, 20)
            b = a + rng.randint(1, 8)
            found.append((a, b, (rng.randint(1, 3), a - b, order)))
        want = {d for d in found if not any(o[0] <= d[0] and o[1] >= d[1] and o[2] < d[2] for o in found)}
        assert set(unsuppressed(found)) == want


def test_there_are_hundreds_of_rules():
    assert len(signature_rules()) > 300


def test_empty(documents):
    assert scan_licenses(documents([])).count() == 0
