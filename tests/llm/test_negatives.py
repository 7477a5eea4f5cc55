import random

import numpy as np

from pairloom.llm import negatives
from pairloom.llm.negatives import GROUP, Index, mine_negatives, rests

COLUMNS = "vec_id long, embedding array<float>, label int, no int, part int, chunk int, anchor boolean, score long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, 2, 3, True, 4) for i, v, c in rows], COLUMNS).repartition(3 if rows else 1)


def brute(rows, every=10, positives=5, keep=5):
    kept = [(i, [int(np.floor(float(np.float32(x)) * 256)) for x in v], c) for i, v, c in rows
            if v is not None and c is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, p, c) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(p, q)), j, d) for b, (j, q, d) in enumerate(kept) if a != b]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for score, j, _ in [s for s in scored if s[2] == c][:positives]:
            fits = [s for s in scored if s[2] != c and 80 * score <= 100 * s[0] <= 100 * score][:keep]
            out += [(i, j, rank, n, score, s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(map(str, out))


def rows_of(seed, n, width, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    out = []
    for i in range(n):
        k = rng.randrange(labels)
        out.append((i, [x + rng.gauss(0, 0.4) for x in centres[k]], k if rng.random() < 0.8 else rng.randrange(labels)))
    return out


EDGES = [
    (None, [1.0] * 20, 1), (None, [1.0] * 20, 2), (500, None, 1), (510, [1.0] * 19 + [None], 1), (520, [float("inf")] * 20, 1),
    (530, [float("nan")] * 20, 2), (540, [1.0] * 20, None), (550, [], 1), (560, [0.5], 2), (570, [0.0] * 20, 3), (580, [2.0] * 25, 3),
    (590, [-1.0] * 20, 9), (600, [0.1] * 20, 8), (601, [0.1] * 20, 8), (601, [0.1] * 20, 8), (602, [0.1] * 20, 7), (603, [0.1] * 20, 7),
    (610, [1.0] + [0.0] * 19, 6), (611, [0.0, 1.0] + [0.0] * 18, 6), (612, [0.0, 0.0, 1.0] + [0.0] * 17, 5),
]


def test_against_all_pairs(spark, monkeypatch):
    for seed, n, width in ((1, 300, 20), (2, 120, 3), (3, 60, 64)):
        rows = rows_of(seed, n, width) + (EDGES if width == 20 else [])
        got = mine_negatives(frame(spark, rows), lambda c: c % 10 == 0).collect()
        assert sorted(str(tuple(r)) for r in got) == brute(rows)
    # many small blocks, chunks and tiles
    for name, value in (("PART_ROWS", 40), ("BLOCK_ROWS", 7), ("CHUNK_ROWS", 5), ("TILE", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = rows_of(4, 200, 20) + EDGES + rows_of(4, 30, 20)  # ids and rows that repeat
    got = mine_negatives(frame(spark, rows), lambda c: c % 10 == 0).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_none(spark):
    for rows in ([], [(1, [1.0], 1)], [(0, [1.0], 1)], [(0, [], 1), (1, [], 2)], [(0, None, 1)]):
        assert mine_negatives(frame(spark, rows), lambda c: c % 100 == 0).collect() == []


def test_index_finds_all_above_and_leaves_out_the_rest():
    """Exact at any threshold; a high one lists a part of the values only."""
    rng = np.random.default_rng(5)
    values = np.rint(rng.normal(0, 100, (64, 700)) * np.geomspace(2, 0.05, 64)[:, None])
    anchors = np.rint(rng.normal(0, 100, (90, 64)) * np.geomspace(2, 0.05, 64))
    index, rest = Index(values), rests(np.ascontiguousarray(anchors.T))
    scores = anchors @ values
    for share in (0.9, 0.5, 0.1, -1):
        floor = np.quantile(scores, max(share, 0), axis=1) if share >= 0 else np.full(90, -1e18)
        a, r, s = index.above(anchors, rest, floor)
        want = np.nonzero(scores >= floor[:, None])
        assert sorted(zip(a, r, s)) == sorted(zip(*want, scores[want]))
    least = (scores.max(axis=1) / rest[0]).min()
    listed = sum(int((index.rest[g] >= least).sum()) for g in range(64 // GROUP))
    assert listed < 0.7 * values.shape[1] * 64 // GROUP
