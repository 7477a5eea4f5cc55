import random
import re

from pairloom.llm.groupjoin import similar_groups, spare
from tests.llm.conftest import EDGES, prose


def sets_of(text, width):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lower)
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, percent, width):
    sets = [sets_of(t, width) for _, t in rows]
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
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None] if sets[k] else [i]
        out.append((i, len(sets[k]), min(ids, default=None)))
    return sorted(map(str, out))


def edited(words, n, seed, fresh=True):
    rng, out = random.Random(seed), list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}" if fresh else rng.choice(words)
    return " ".join(out)


def chain(first, start, n):
    """Texts of which each is linked to the next alone."""
    words, rows = prose(start, 300, 9000), []
    for k in range(n):
        rows.append((first + k, " ".join(words)))
        words = [*words[22:], *prose(start + 1 + k, 22, 9000)]
    return rows


def copies_that_share_alterations(first):
    """Texts of one size whose rare elements are alike, so that prefixes are identical while the sets differ."""
    base = prose(77, 200, 9000)
    out = []
    for k in range(30):
        words = list(base)
        words[20 + 6 * (k % 5)] = "one"
        words[100 + 6 * (k // 5)] = "two"
        out.append((first + k, " ".join(words)))
    return out


ROWS = [
    *EDGES,
    *[(100 + k, edited(prose(1, 400, 9000), k % 18, k)) for k in range(40)],  # near copies, some over the bound
    *[(200 + k, " ".join(prose(2, 80, 9000))) for k in range(25)],  # copies
    *chain(300, 50, 9),
    *[(400 + k, " ".join([*prose(60, 60, 9000), *prose(70 + k, 50, 9000)])) for k in range(25)],  # a shared passage
    *[(430 + k, " ".join([*prose(60, 60, 9000), *prose(170 + k, 9, 9000)])) for k in range(25)],  # hardly more than the passage
    *[(500 + k, " ".join(prose(900 + k, 30, 9000))) for k in range(25)],
    (600, "one two three"), (601, "ONE two\tthree"), (602, "one two three four"), (603, "one two three four five"),
    *copies_that_share_alterations(700),
    *[(800 + k, edited(prose(8, 60, 30), 3, k, fresh=False)) for k in range(40)],  # few different words
]


def test_against_all_pairs(documents):
    for percent, width in ((85, 4), (60, 3)):
        got = similar_groups(documents(ROWS), percent=percent, width=width).collect()
        assert sorted(str(tuple(r)) for r in got) == brute(ROWS, percent, width)


def test_random_small_sets(documents):
    for seed in range(2):
        rng = random.Random(seed)
        bases = [prose(seed * 10 + k, rng.randint(3, 40), 60) for k in range(12)]
        rows = [(i, edited(rng.choice(bases), rng.randrange(4), 1000 * seed + i, fresh=i % 2 == 0)) for i in range(150)]
        got = similar_groups(documents(rows)).collect()
        assert sorted(str(tuple(r)) for r in got) == brute(rows, 85, 4)


def test_empty(documents):
    assert similar_groups(documents([])).collect() == []
    assert [tuple(r) for r in similar_groups(documents([(1, None), (None, " ")])).orderBy("doc_id").collect()] == [(None, 0, None), (1, 0, 1)]


def test_spare_is_the_most_a_linked_set_may_lack():
    for n in range(1, 400):
        assert 100 * (n - spare(n, 85)) >= 85 * n and (100 * (n - spare(n, 85) - 1) < 85 * n)
