import random
import string

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, label string, bucket int, train boolean"


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(vocabulary)]
    return [rng.choice(words) for _ in range(n)]


@pytest.fixture(scope="session")
def documents(spark):
    """A documents frame from (doc_id, text) pairs, with columns whose names the operators use inside."""
    def make(rows):
        rows = list(rows)
        return spark.createDataFrame(
            [(i, t, "en", "s", len(t or ""), 7, "k", "l", 1, None) for i, t in rows], COLUMNS
        ).repartition(3 if rows else 1)

    return make


EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (None, "lost and found"), (4, "one two three"), (4, "one two three"),
    (5, " ".join(prose(5, 60))), (6, " ".join(prose(5, 60))), (7, " ".join(prose(7, 30000))),
    (8, "Ünïcode 日本語 🙂 Straße ÉTÉ"), (9, "a" * 3000), (None, None), (10, " ".join(prose(5, 60)).upper()),
]


@pytest.fixture(scope="session")
def edges(documents):
    return documents(EDGES)


def by_id(df):
    """Rows as dicts, in order of id and the rest; null ids first."""
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, str(r)))
