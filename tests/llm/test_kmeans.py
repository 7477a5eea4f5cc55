import hashlib
import random

import numpy as np

from pairloom.llm.kmeans import assign, cluster_vectors, distances

COLUMNS = "vec_id long, embedding array<float>, cluster int, point string, id int, found array<int>"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, "p", 4, [1]) for i, v in rows], COLUMNS).repartition(3 if rows else 1)


def brute(rows, components, clusters, rounds, scale=64):
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows
            if v is not None and len(v) == components and all(x is not None and np.isfinite(x) for x in v)]
    place = {i: hashlib.sha256(f"1:{i}".encode()).hexdigest() for i, _ in kept}
    start = sorted(kept, key=lambda r: (r[0] is None, place[r[0]], r[1]))[:clusters]
    centroids = [p for _, p in start]

    def near(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, p in kept:
            groups.setdefault(near(p)[1], []).append(p)
        for k, members in groups.items():
            centroids[k] = [sum(c) // len(members) for c in zip(*members)]
    got = [(i, *near(p)) for i, p in kept]
    return sorted(((
        i, k, d, sum(e for _, e, c in got if c == k), sum(e for _, e, _ in got),
        hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in got), key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice((-1, 0, 1)) * 2 + rng.gauss(0, 0.5) for _ in range(6)]) for i in range(300)]
    rows += [(7, rows[7][1]), (7, [0.0] * 6), (None, [1.0] * 6), (None, rows[3][1])]
    rows += [(1000 + i, [0.015625 * (i % 2), 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0] * 5 + [None]), (2004, [1.0] * 5 + [float("nan")]),
             (2005, [float("-inf")] + [1.0] * 5), (2006, [1.0] * 7)]
    for clusters, rounds in ((16, 3), (5, 5), (1, 1)):
        got = cluster_vectors(frame(spark, rows), components=6, clusters=clusters, rounds=rounds).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, 6, clusters, rounds)


def test_few_and_none(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)]
    got = cluster_vectors(frame(spark, rows), components=2).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 2, 16, 3)
    for none in ([], [(1, None)], [(1, [1.0])]):
        out = cluster_vectors(frame(spark, none), components=2)
        assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_save_distances_and_stay_exact():
    """A round with stored bounds gives what a full scan gives, from fewer distances; a centroid that comes back has moved by nothing."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(m, 8, (500, 8)) for m in (-200, 0, 200, 400)]).astype(np.int64)
    start = points[[0, 10, 600, 700, 1200, 1300, 1700, 1900]]
    history, state, evaluated = start[None], (None, None, None), []
    for _ in range(8):
        state = assign(points, history, *state)
        full = np.stack([distances(points, c) for c in history[-1]], axis=1)
        assert (state[0] == full.argmin(axis=1)).all()
        evaluated.append(int((state[2] == len(history) - 1).sum()))
        means = np.stack([points[state[0] == k].sum(axis=0) // max(1, (state[0] == k).sum()) if (state[0] == k).any() else history[-1, k] for k in range(8)])
        history = np.concatenate([history, means[None]])
    assert evaluated[0] == points.shape[0] * 8 and all(e < evaluated[0] / 2 for e in evaluated[1:])
    # out and back: drifts add up to a lot, the displacement is none
    there, back = np.concatenate([start[None], start[None] + 500]), np.concatenate([start[None], start[None] + 500, start[None]])
    old = assign(points, there[:1], None, None, None)
    kept = assign(points, back, *old)
    assert (kept[0] == old[0]).all() and (kept[2] == 2).sum() < points.shape[0]
