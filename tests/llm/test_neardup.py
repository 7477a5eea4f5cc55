import random
import re

import numpy as np
from pyspark.sql import functions as F

from pairloom.llm import neardup
from pairloom.llm.neardup import _contracted, components, near_duplicates, one_of_each, set_key, shingle_set, signatures
from pairloom.session import stored
from tests.llm.conftest import EDGES, by_id, prose


def sets_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lower)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked_rows(rows, percent):
    """A number per row, the same for rows linked directly or by others."""
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                parent[root(a)] = root(b)
    return [root(k) for k in range(len(rows))]


def brute(rows, percent):
    linked, out = linked_rows(rows, percent), []
    for k, (i, text) in enumerate(rows):
        n = len(sets_of(text))
        ids = [j for c, (j, _) in zip(linked, rows) if c == linked[k] and j is not None] if n else [i]
        least = min(ids, default=None)
        out.append((i, n, least, i == least))
    return sorted(map(str, out))


def edited(words, n, seed):
    rng, out = random.Random(seed), list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def chain(first, start, n):
    """Texts of which each is linked to the next alone."""
    words, rows = prose(start, 300, 9000), []
    for k in range(n):
        rows.append((first + k, " ".join(words)))
        words = [*words[22:], *prose(start + 1 + k, 22, 9000)]
    return rows


ROWS = [
    *EDGES,
    *[(100 + k, edited(prose(1, 400, 9000), k % 12, k)) for k in range(40)],  # near copies, some over the bound
    *[(200 + k, " ".join(prose(2, 80, 9000))) for k in range(25)],  # copies
    *chain(300, 50, 9),
    *[(400 + k, " ".join([*prose(60, 60, 9000), *prose(70 + k, 50, 9000)])) for k in range(25)],  # a shared passage
    *[(500 + k, " ".join(prose(900 + k, 30, 9000))) for k in range(25)],
    (600, "one two three four"), (601, "ONE two\tthree FOUR"), (602, "one two three four five"), (603, "one two three four five six"),
]


def test_against_all_pairs(documents):
    for percent in (85, 80):
        got = near_duplicates(documents(ROWS), percent=percent).collect()
        assert sorted(map(str, map(tuple, got))) == brute(ROWS, percent)


def test_one_of_each(documents):
    """All rows without words, and one row of every component, that of its least id."""
    twice = [(3, "\t"), (None, ""), (None, None), (5, " ".join(prose(950, 70, 9000))), (5, edited(prose(950, 70, 9000), 1, 1)),
             (100, " ".join(prose(960, 70, 9000))), (None, " ".join(prose(970, 70, 9000))), (None, edited(prose(970, 70, 9000), 1, 2))]
    rows = ROWS + twice
    docs = documents(rows)
    kept = one_of_each(docs, percent=85)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    empty = sorted(str(r) for r in rows if not sets_of(r[1]))
    assert sorted(str(r) for r in got if not sets_of(r[1])) == empty
    linked = linked_rows(rows, 85)
    assert all(r in rows for r in got)
    stands = sorted(linked[rows.index(r)] for r in got if sets_of(r[1]))
    assert stands == sorted({c for c, r in zip(linked, rows) if sets_of(r[1])})
    for i, text in got:
        if sets_of(text):
            ids = [j for c, (j, _) in zip(linked, rows) if c == linked[rows.index((i, text))]]
            assert i == min((j for j in ids if j is not None), default=None)


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    edges = [(a, a + 1) for a in range(0, 200)] + [(1000, b) for b in range(1001, 1100)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(80)]
    key = lambda n: n.to_bytes(4, "big")
    df = spark.createDataFrame([(key(a), key(b)) for a, b in edges if a != b], "u binary, v binary").repartition(5)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {int.from_bytes(r["key"], "big"): int.from_bytes(r["root"], "big") for r in components(df).collect()}
    assert got == {x: root(x) for x in list(parent) if root(x) != x}


def test_stars_need_no_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(neardup, "stored", lambda df, purpose: made.append(purpose) or stored(df, purpose))
    edges = [(b"a", b"b"), (b"c", b"a"), (b"a", b"c"), (b"x", b"y"), (b"b", b"a")]
    df = spark.createDataFrame(edges, "u binary, v binary").repartition(1)
    assert sorted((bytes(r["key"]), bytes(r["root"])) for r in components(df).collect()) == [(b"b", b"a"), (b"c", b"a"), (b"y", b"x")]
    assert made == ["links"]


def test_unlike_texts_of_a_bucket_are_not_compared(documents, monkeypatch):
    compared, rng = [], random.Random(4)
    real = neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, texts, percent: compared.append(pairs.count()) or real(pairs, texts, percent))
    base, rows = prose(77, 120, 5000), []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(15), 5):
            words[4 + 8 * at] = f"other{at}"
        rows.append((k, " ".join(words)))
    got = by_id(near_duplicates(documents(rows), percent=80))
    groups = linked_rows(rows, 80)
    assert [r["component_id"] for r in got] == [min(i for (i, _), g in zip(rows, groups) if g == own) for own in groups]
    assert compared[1] < 100, compared


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for n, shared in ((30, 20), (300, 150), (2000, 1800), (5, 5)):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[:shared], rng.integers(0, 2**63, n - shared).astype(np.uint64)])
        s = signatures([np.unique(a), np.unique(b)], 192)
        true = shared / (2 * n - shared)
        assert abs((s[0] == s[1]).mean() - true) < 4.5 * (true * (1 - true) / 192) ** 0.5 + 1e-9
    whole = signatures([np.unique(a)], 192)
    assert (whole[0] == signatures([np.empty(0, np.uint64), np.unique(a)], 192)[1]).all()


def test_sets():
    h = np.arange(1, 9, dtype=np.uint64)
    assert len(shingle_set(h)) == 4 and len(shingle_set(h[:3])) == 1 and not len(shingle_set(h[:0]))
    assert set_key(shingle_set(h)) != set_key(shingle_set(h[:7]))


def test_empty(documents):
    assert by_id(near_duplicates(documents([]))) == [] and one_of_each(documents([])).count() == 0


def test_one_of_each_with_columns_of_its_own_names(documents):
    names = ["own_id", "touched_id", "key", "own", "single", "root", "several", "id"]
    docs = documents([(1, "a b c d e f"), (2, "a b c d e f"), (3, ""), (4, "g h"), (4, "i j"), (None, "k l")])
    for name in names:
        docs = docs.withColumn(name, F.col("doc_id") + 10)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"], r["touched_id"]) for r in kept.collect()), key=str) == [
        (0, "k l", None), (1, "a b c d e f", 11), (3, "", 13), (4, "g h", 14), (4, "i j", 14)]


def test_contracted_links_keep_components(spark):
    rows = [(u, v) for u in range(20, 60) for v in (u % 3, 10, 11) if u % 2] + [(100, 101), (70, 80)]
    links = spark.createDataFrame(rows, "u long, v long")
    made = [tuple(r) for r in _contracted(links).collect()]

    def groups(edges):
        root = {}
        for u, v in edges:
            a, b = root.get(u, {u}), root.get(v, {v})
            for x in a | b:
                root[x] = a | b
        return {frozenset(g) for g in root.values()}

    assert groups(made) == groups(rows) and len(made) < len(rows)
