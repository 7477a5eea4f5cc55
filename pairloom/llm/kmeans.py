"""Exact k-means whose bounds are loosened by what a centroid moved in total (ns-bounds).

A vector keeps, for every centroid, the distance found when it was last evaluated, and the round of that
evaluation. The centroids of all rounds are retained, so a stored distance bounds today's one by the
norm of the centroid's total displacement since that round; that norm is never above the sum of the
per-round drifts, and is far below it where a centroid turns back. Only where the bound of another
centroid does not stay above that of the own one are distances evaluated anew, exactly, in integers.

A round is one pass over a table in the shared folder: narrow Arrow batches, no shuffle of vectors. What
leaves a task is one row of sums per batch and cluster; what a task is sent is the history
(rounds x clusters x components). So a cluster with most of all vectors is no hot key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.session import stored

CLUSTERS, ROUNDS, SCALE, COMPONENTS, SEED = 16, 3, 64, 64, 1
# Beyond it a squared distance of 64 components might leave 64 bits.
MOST = 1 << 27
SLACK = 1e-9


def whole(vector: Column) -> Column:
    """Whether a vector is there, with no null and no infinite or undefined component."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, worked out in doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def distances(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    apart = points - centroid
    return np.einsum("ij,ij->i", apart, apart)


def assign(points: np.ndarray, history: np.ndarray, cluster, found, at):
    """One round: cluster, found and at of every point, after the centroids ``history[-1]``.

    ``found[i, j]`` is the squared distance of point i to the centroid j of round ``at[i, j]``. In the
    first round they are None, and every distance is evaluated. Ties go to the smaller number.
    """
    now, k = len(history) - 1, history.shape[1]
    if cluster is None:
        found = np.stack([distances(points, c) for c in history[-1]], axis=1)
        return found.argmin(axis=1), found, np.zeros(found.shape, np.int32)
    rows = np.arange(len(points))
    apart = (history - history[-1]).astype(float)
    moved = np.sqrt((apart * apart).sum(axis=2))
    loose = moved[at, np.arange(k)]
    root = np.sqrt(found.astype(float))
    slack = SLACK * (1 + root + loose)
    lower, upper = root - loose - slack, (root + loose + slack)[rows, cluster]
    lower[rows, cluster] = np.inf
    open_ = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
    found, at = found.copy(), at.copy()
    # the own distance first: it may close the row
    for j in np.unique(cluster[open_]):
        mine = open_[cluster[open_] == j]
        found[mine, j], at[mine, j] = distances(points[mine], history[-1, j]), now
    exact = np.sqrt(found[open_, cluster[open_]].astype(float))
    failed = lower[open_] <= (exact * (1 + SLACK) + SLACK)[:, None]
    for j in np.flatnonzero(failed.any(axis=0)):
        mine = open_[failed[:, j]]
        found[mine, j], at[mine, j] = distances(points[mine], history[-1, j]), now
    known = np.where(at[open_] == now, found[open_], np.iinfo(np.int64).max)
    cluster = cluster.copy()
    cluster[open_] = known.argmin(axis=1)
    return cluster, found, at


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1), kind))


def _round(state: DataFrame, history: np.ndarray) -> DataFrame:
    """The state after a round: id, point, cluster, found, at."""
    schema = T.StructType([
        *state.select("id", "point").schema.fields, T.StructField("cluster", T.IntegerType()),
        T.StructField("found", T.ArrayType(T.LongType())), T.StructField("at", T.ArrayType(T.IntegerType())),
    ])
    width, k, started = history.shape[2], history.shape[1], len(history) > 1

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column("point"), width, np.int64)
            if np.abs(points).max() > MOST:
                raise ValueError(f"a component is beyond {MOST} after scaling")
            old = (batch.column("cluster").to_numpy().astype(np.int64), _matrix(batch.column("found"), k, np.int64),
                   _matrix(batch.column("at"), k, np.int32)) if started else (None, None, None)
            cluster, found, at = assign(points, history, *old)
            columns = [batch.column("id"), batch.column("point"), pa.array(cluster, pa.int32()),
                       _lists(found, pa.int64()), _lists(at, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return state.mapInArrow(run, schema)


def _sums(state: DataFrame, k: int, width: int) -> list:
    """(cluster, place, sum, n) over all points: added up per Arrow batch, then over few rows."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points, cluster = _matrix(batch.column("point"), width, np.int64), batch.column("cluster").to_numpy()
            n = np.bincount(cluster, minlength=k)
            held = np.flatnonzero(n)
            sums = np.stack([points[cluster == c].sum(axis=0) for c in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array(n[held], pa.int64()), _lists(sums, pa.int64())], names=["cluster", "n", "sums"])

    parts = state.select("point", "cluster").mapInArrow(run, "cluster int, n long, sums array<long>")
    return (
        parts.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
        .groupBy("cluster", "place")
        .agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n")).collect()
    )


def cluster_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
    scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with exactly ``components`` components, none null or non-finite; component x
    counts as floor(scale * x). The first centroids are the vectors with the least hex SHA-256 of
    ``<seed>:<id>`` (null ids last, ties by components), all vectors where there are fewer than
    ``clusters``. Each round assigns every vector to its nearest centroid (ties: the smaller number),
    then moves every centroid that has vectors to their mean, rounded down by component; at the end
    all are assigned once more. Ids may be null or repeated: every row is a vector of its own, and
    comes back with its id. Other columns are left out. An empty table, or none kept, gives no rows.
    Components beyond 2^27 after scaling raise an error, as distances would leave 64 bits.
    """
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(
        (F.size("vector") == components) & whole(F.col("vector")))
    state = stored(kept.select("id", scaled(F.col("vector"), scale).alias("point")), "points")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = state.orderBy(F.asc_nulls_last(place), "point").limit(clusters).select("point").collect()
    k = len(start)
    history = np.array([[r["point"] for r in start]], np.int64).reshape(1, k, components)
    for _ in range(rounds if k else 0):
        state = stored(_round(state, history), "assigned")
        centroids = history[-1].copy()
        for r in _sums(state, k, components):
            centroids[r["cluster"], r["place"]] = int(r["sum"]) // r["n"]
        history = np.concatenate([history, centroids[None]])
    if not k:
        return state.select(
            F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit("").alias("centroid_sha256"))
    state = stored(_measured(_round(state, history), history[-1]), "clustered")
    # as many numbers as clusters
    per = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]
    row = F.struct(
        F.array(*[F.lit(per.get(c, 0)).cast("long") for c in range(k)]).alias("inertias"), F.array(*map(F.lit, digests)).alias("digests"))
    return state.select(
        F.col("id").alias("vec_id"), "cluster", "distance", F.get(row["inertias"], F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(per.values())).cast("long").alias("inertia"), F.get(row["digests"], F.col("cluster")).alias("centroid_sha256"))


def _measured(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster and the exact squared distance to the own centroid."""
    schema = T.StructType([*state.select("id", "cluster").schema.fields, T.StructField("distance", T.LongType())])
    width = centroids.shape[1]

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            apart = _matrix(batch.column("point"), width, np.int64) - centroids[batch.column("cluster").to_numpy()]
            own = np.einsum("ij,ij->i", apart, apart)
            columns = [batch.column("id"), batch.column("cluster"), pa.array(own, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return state.select("id", "point", "cluster").mapInArrow(run, schema)
