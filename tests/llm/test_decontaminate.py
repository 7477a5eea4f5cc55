import numpy as np
import pytest

from pairloom.llm.decontaminate import RADIUS, ItemIndex, Matcher, SignedWords, find_leaks, shingles, similarity, without_leaks
from pairloom.llm.words import PLAIN
from tests.llm.conftest import EDGES, prose

ITEMS = [(k, " ".join(prose(1000 + k, n, 5000))) for k, n in enumerate([3, 4, 5, 7, 8, 12, 15, 16, 21, 31, 32, 40, 59, 63, 64, 90, 130, 300])]


def place(text, seed, before):
    return " ".join([*prose(seed, before, 5000), text, *prose(seed + 1, 50, 5000)])


def edit(text, k):
    words = text.split()
    words[k] = "changed"
    return " ".join(words)


COPIES = [(100 + 10 * k + d, place(t, 50 + k, 20 + d)) for k, t in ITEMS for d in range(9)]
NEAR = [(1000 + k, place(edit(edit(t, 0), -1), k, 33)) for k, t in ITEMS if len(t.split()) >= 31]
CLEAN = [(2000 + k, " ".join(prose(3000 + k, 200, 5000))) for k in range(40)]
HALF = [(2100 + k, place(" ".join(t.split()[:len(t.split()) // 2]), k, 10)) for k, t in ITEMS if len(t.split()) >= 30]


@pytest.fixture
def benchmark(spark):
    rows = [*ITEMS, (90, None), (91, ""), (None, ITEMS[9][1]), (9, ITEMS[9][1])]
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, doc_id int")


def test_leaks(documents, benchmark):
    rows = [*EDGES, *COPIES, *NEAR, *CLEAN, *HALF]
    got = find_leaks(documents(rows), benchmark).collect()
    exact = {(r["doc_id"], r["item_id"]) for r in got}
    for k, text in ITEMS:
        for d in range(9):
            assert (100 + 10 * k + d, k) in exact, (k, d)
            r = next(r for r in got if (r["doc_id"], r["item_id"]) == (100 + 10 * k + d, k))
            assert (r["similarity"], r["first_word"], r["n_words"]) == (1.0, 20 + d, len(text.split()))
    assert {r["doc_id"] for r in got if r["doc_id"] and 1000 <= r["doc_id"] < 2000} == {i for i, _ in NEAR}
    assert not [r for r in got if r["doc_id"] is None or r["doc_id"] < 100 or r["doc_id"] >= 2000]
    # repeated items match each, also under a null id
    assert sum(r["doc_id"] == 190 for r in got) == 3


def test_clean_rows_stay_whole(documents, benchmark):
    docs = documents([*EDGES, *COPIES[:20], *CLEAN])
    kept = without_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    want = [(i, t) for i, t in [*EDGES, *CLEAN]]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, want))


def test_blocks_of_items_give_the_same(documents, benchmark):
    docs = documents(COPIES[:60])
    whole, parts = (sorted(map(str, find_leaks(docs, benchmark, block_bytes=b).collect())) for b in (1 << 20, 700))
    assert whole == parts


def test_every_window_within_the_radius_is_measured():
    words = SignedWords(PLAIN)
    index = ItemIndex([k for k, _ in ITEMS], [t for _, t in ITEMS])
    matcher = Matcher(index, 0.8)
    rng = np.random.default_rng(4)
    assert words is not None
    for step, size, tables, prints, items, _ in index.classes:
        for p, item in zip(prints, items, strict=True):
            flips = rng.choice(64, RADIUS, replace=False)
            near = p ^ np.uint64(sum(1 << int(f) for f in flips))
            values, own = np.array([near], "<u8").view("<u2"), list(prints).index(p)
            assert any(own in number[start[v]:start[v] + count[v]] for (count, start, number), v in zip(tables, values, strict=True))
            assert item < len(index.ids) and size % step == 0
    assert matcher.match([]) == []


def test_weighted_similarity():
    a = np.array([1, 1, 2, 3], np.uint64)
    assert similarity(a, np.array([1, 2, 2, 4], np.uint64)) == 2 / 6
    assert similarity(a, a) == 1.0 and similarity(a[:0], a[:0]) == 0.0
    assert len(shingles(a)) == 1 and len(shingles(np.arange(9, dtype=np.uint64))) == 5


def test_empty(documents, benchmark):
    assert find_leaks(documents([]), benchmark).count() == 0
    assert find_leaks(documents(COPIES[:3]), benchmark.limit(0)).count() == 0
    assert without_leaks(documents(COPIES[:3]), benchmark.limit(0)).count() == 3


def altered(words, rng, seed):
    """The words with one run replaced, left out or put in, as long as similarity stays 0.8."""
    n, best = len(words), None
    at, new = int(rng.integers(0, n)), prose(seed, n, 5000)
    kind = rng.choice(["replace", "leave out", "put in"])
    index = ItemIndex([0], [" ".join(words)])
    for run in range(1, n):
        if kind == "replace":
            got = words[:at] + new[:len(words[at:at + run])] + words[at + run:]
        elif kind == "leave out":
            got = words[:at] + words[at + run:]
        else:
            got = words[:at] + new[:run] + words[at:]
        # the place that the search measures has the item's length, at any start: brute force
        line = prose(seed + 1, n, 5000) + got + prose(seed + 2, n, 5000)
        hashes = SignedWords(PLAIN)
        numbers = hashes.texts([" ".join(line)])[0]
        own = hashes.hashes[numbers]
        value = max(similarity(index.shingles[0], shingles(own[a:a + n])) for a in range(n // 2, 2 * n))
        if value < 0.8:
            break
        best = line
    return best


@pytest.mark.parametrize("n", [15, 24, 32, 39, 59, 79, 100, 159, 300])
def test_recall_of_altered_passages(n):
    """Against brute force over all windows: the longest alteration that leaves 0.8 somewhere."""
    rng, found, tried = np.random.default_rng(n), 0, 0
    for k in range(40 if n < 60 else 12):
        words = prose(7000 + 100 * n + k, n, 5000)
        line = altered(words, rng, 90000 + 100 * n + k)
        if line is None:
            continue
        matcher = Matcher(ItemIndex([0], [" ".join(words)]), 0.8)
        tried += 1
        found += bool(matcher.match([" ".join(line)])[0])
    print(f"{n} words: {found} of {tried} found")
    assert found >= 0.95 * tried


def test_word_table_of_a_task_stays_small():
    matcher = Matcher(ItemIndex([1], [ITEMS[9][1]]), 0.8)
    for k in range(3):
        matcher.match([" ".join(f"w{k}x{i}" for i in range(70_000)), place(ITEMS[9][1], k, 5)])
    assert len(matcher.words.signs) <= 1 << 17
    assert [[f[:2] for f in found] for found in matcher.match(["nothing", ITEMS[9][1]])] == [[], [(0, 1.0)]]
