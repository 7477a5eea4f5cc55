"""Hard negatives by threshold joins: a partial inverted index, accumulated scores, lowered thresholds.

Vectors are dealt into parts, and each part into blocks. A block holds its values by component
(components with the most energy in all vectors first) and, per vector, the norm of what is left after
every few components: an inverted index whose lists get shorter, since a list leaves out the vectors
whose remaining norm alone cannot reach the threshold any more. For a chunk of anchors the lists are
added up one group of components after the other; a pair is given up once its partial score and
the product of the two remaining norms stay under the anchor's threshold, and what is left is scored
whole. Thresholds start high and are lowered, anchor by anchor, until the windows that the anchor has
to fill are full or their lower ends are reached; from then on the last place of a window is its threshold.

Every chunk of anchors (a stated share of the rows) meets every part once. What comes back is at most the
places of its windows per part, and a last cut makes the result exact. All scores are integers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.kmeans import scaled, whole
from pairloom.session import stored

SCALE = 256
PART_ROWS, BLOCK_ROWS, CHUNK_ROWS, TILE = 32768, 4096, 512, 64
GROUP = 8
# Beyond it a score might leave the integers that doubles hold.
MOST = 1 << 22
LOWER = (0.8, 0.6, 0.4, 0.2)  # of the anchor's own square, for positives
NARROW = (0.96, 0.92, 0.88, 0.84)  # of a window's upper end, for negatives
NONE = -(1 << 62)
SAFE = 1 + 1e-9  # room for what doubles round away from norms


class Index:
    """Lists of one block, by component in the order of energy."""

    def __init__(self, values: np.ndarray):
        self.values = values  # components x vectors
        self.rest = rests(values)  # norms of what is left, by group

    def above(self, anchors: np.ndarray, rest: np.ndarray, floor: np.ndarray):
        """(anchor, vector, score) of all pairs that score ``floor[anchor]`` or more."""
        found = [self._tile(anchors[a:a + TILE], rest[:, a:a + TILE], floor[a:a + TILE], a) for a in range(0, len(anchors), TILE)]
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

    def _tile(self, anchors, rest, floor, first):
        width = len(self.values)
        # the least share of an anchor's norm that any of them asks for
        least = (floor / np.maximum(rest[0], 1e-9)).min()
        rows = np.flatnonzero(SAFE * self.rest[0] >= least)
        total, parts = np.zeros((len(anchors), len(rows))), []
        for group, a in enumerate(range(0, width, GROUP)):
            total += anchors[:, a:a + GROUP] @ self.values[a:a + GROUP, rows]
            left = self.rest[group + 1, rows]
            alive = total + SAFE * rest[group + 1][:, None] * left + 1e-3 >= floor[:, None]
            some = alive.any(axis=0)
            listed = (SAFE * left >= least) & (a + GROUP < width)
            # not in later lists: whole scores for the few pairs that may still reach
            done = some & ~listed
            if done.any():
                i, j = np.nonzero(alive[:, done])
                parts.append((i, rows[done][j], total[:, done][i, j], np.full(len(i), a + GROUP)))
            stay = some & listed
            rows, total = rows[stay], total[:, stay]
            if not len(rows):
                break
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for i, j, score, at in parts:
            if len(i) and at[0] < width:
                score = score + np.einsum("ij,ji->i", anchors[i, at[0]:], self.values[at[0]:, j])
            keep = score >= floor[i]
            out.append((i[keep] + first, j[keep], score[keep]))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def rests(values: np.ndarray) -> np.ndarray:
    """Norms of components ``g * GROUP`` and up, of every column, for every g."""
    square = values.astype(float) ** 2
    starts = range(0, len(values), GROUP)
    sums = np.stack([square[a:a + GROUP].sum(axis=0) for a in starts]) if len(values) else np.zeros((0, values.shape[1]))
    after = np.cumsum(sums[::-1], axis=0)[::-1]
    return np.sqrt(np.concatenate([after, np.zeros((1, values.shape[1]))]))


class Windows:
    """The best of every window of a chunk of anchors, over the blocks met so far.

    ``low`` and ``high`` (anchors x windows) are the ends of the windows, ``levels`` the thresholds to
    try one after the other before ``low``.
    """

    def __init__(self, chunk: dict, keep: int, same: bool):
        self.chunk, self.keep, self.same = chunk, keep, same
        self.low, self.high = chunk["low"], chunk["high"]
        self.levels = [np.maximum(self.low, np.floor(chunk["start"] * f).astype(np.int64)) for f in chunk["steps"]] + [self.low]
        self.level = np.zeros(self.low.shape, np.int64)
        self.best = tuple(np.empty(0, np.int64) for _ in range(6))  # anchor, window, score, id, no id, row
        self._count()

    def _count(self):
        """How many places of each window are taken, and the score of the last one."""
        anchor, window, score = self.best[:3]
        flat = anchor * self.low.shape[1] + window
        self.full = (np.bincount(flat, minlength=self.low.size) >= self.keep).reshape(self.low.shape)
        last = np.full(self.low.size, np.iinfo(np.int64).max)
        np.minimum.at(last, flat, score)
        self.last = last.reshape(self.low.shape)

    def floor(self) -> np.ndarray:
        tried = np.take_along_axis(np.stack(self.levels), self.level[None], 0)[0]
        floors = np.where(self.full, self.last, tried)
        # a window without an upper end above its lower one takes nothing
        return np.where(self.low <= self.high, floors, np.iinfo(np.int64).max).min(axis=1)

    def add(self, block: dict, index: Index) -> None:
        before, todo = self.best, np.arange(len(self.low))
        fresh = [tuple(np.empty(0, np.int64) for _ in range(6))]
        while len(todo):
            floor = self.floor()
            anchor, row, score = index.above(self.chunk["values"][todo], self.chunk["rest"][:, todo], floor[todo].astype(float))
            fresh = [tuple(x[~np.isin(f[0], todo)] for x in f) for f in fresh]
            fresh.append(self._fitting(todo[anchor], row, score.astype(np.int64), block))
            self.best = self._cut(tuple(np.concatenate([before[k], *[f[k] for f in fresh]]) for k in range(6)))
            self._count()
            lower = ~self.full & (self.level < len(self.levels) - 1) & (self.low <= self.high)
            self.level[lower] += 1
            todo = np.flatnonzero(lower.any(axis=1))

    def _fitting(self, anchor, row, score, block):
        label = self.chunk["labels"][anchor] == block["labels"][row]
        fits = (label if self.same else ~label) & (self.chunk["nos"][anchor] != block["nos"][row])
        anchor, row, score = anchor[fits], row[fits], score[fits]
        out = []
        for w in range(self.low.shape[1]):
            inside = (score >= self.low[anchor, w]) & (score <= self.high[anchor, w])
            a, r = anchor[inside], row[inside]
            out.append((a, np.full(len(a), w), score[inside], block["ids"][r], block["no_id"][r], block["nos"][r]))
        return self._cut(tuple(np.concatenate([o[k] for o in out]) for k in range(6)))

    def _cut(self, entries):
        anchor, window, score, id_, no_id, row = entries
        order = np.lexsort((row, id_, no_id, -score, window, anchor))
        flat = (anchor * self.low.shape[1] + window)[order]
        new = np.flatnonzero(np.diff(flat, prepend=-1))
        rank = np.arange(len(flat)) - np.repeat(new, np.diff(np.append(new, len(flat))))
        return tuple(e[order[rank < self.keep]] for e in entries)

    def batch(self) -> pa.RecordBatch:
        anchor, window, score, id_, no_id, row = self.best
        return pa.RecordBatch.from_arrays(
            [pa.array(self.chunk["nos"][anchor]), pa.array(window, pa.int32()), pa.array(score), pa.array(id_, mask=no_id.astype(bool)), pa.array(row)],
            names=["anchor_no", "place", "score", "id", "no"])


def _numbers(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name).slice(i, 1).flatten().to_numpy(zero_copy_only=False)


def _pack(rows: DataFrame, order: list[int], most: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Up to ``most`` rows of a partition as one: nos, ids, labels, values by component in ``order``, and ``extra`` lists."""
    width = len(order)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                n = part.num_rows
                lengths = pc.list_value_length(part.column("point")).to_numpy().astype(np.int64)
                flat = part.column("point").flatten().to_numpy()
                if len(flat) and np.abs(flat).max() > MOST:
                    raise ValueError(f"a component is beyond {MOST} after scaling")
                values = np.zeros((n, width), np.int32)
                at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                values[np.repeat(np.arange(n), lengths), at] = flat
                columns = [[part.column(c).to_pylist()] for c in ("no", "id", "label")]
                columns += [[values[:, order].T.reshape(-1)]] + [[part.column(c).to_pylist()] for c in extra]
                kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.list_(pa.int64())] * len(extra)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds, strict=True)], names=["nos", "ids", "labels", "values", *extra])

    schema = "nos array<long>, ids array<long>, labels array<long>, values array<int>" + "".join(f", {c} array<array<long>>" for c in extra)
    return rows.select("no", "id", "label", "point", *extra).mapInArrow(run, schema)


def _search(chunks: DataFrame, blocks: DataFrame, parts: int, width: int, keep: int, same: bool, limits: Callable) -> DataFrame:
    """anchor_no, place (of the window), score, id and no of at most ``keep`` rows per window and part."""
    def run(batches):
        current, held, index_of = None, None, (None, None)
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("chunk")[i].as_py()
                if name != current:
                    if held is not None:
                        yield held.batch()
                    nos = _numbers(batch, "a_nos", i)
                    values = _numbers(batch, "a_values", i).reshape(width, len(nos)).astype(float)
                    chunk = {"nos": nos, "labels": _numbers(batch, "a_labels", i), "values": np.ascontiguousarray(values.T), "rest": rests(values)}
                    chunk |= limits(chunk, batch, i)
                    current, held = name, Windows(chunk, keep, same)
                b_nos = _numbers(batch, "nos", i)
                place = (batch.column("part")[i].as_py(), int(b_nos[0]))
                if place != index_of[0]:
                    index_of = place, Index(_numbers(batch, "values", i).reshape(width, len(b_nos)).astype(float))
                ids = batch.column("ids").slice(i, 1).flatten()
                block = {"nos": b_nos, "labels": _numbers(batch, "labels", i), "no_id": pc.is_null(ids).to_numpy(zero_copy_only=False),
                         "ids": pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)}
                held.add(block, index_of[1])
        if held is not None:
            yield held.batch()

    own = [F.col(c).alias(f"a_{c}") for c in chunks.columns if c != "chunk"]
    everywhere = chunks.select("chunk", *own, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    # chunks stream, the blocks of a part are held: one chunk after the other meets all of them
    pairs = everywhere.hint("merge").join(blocks, "part")
    return pairs.mapInArrow(run, "anchor_no long, place int, score long, id long, no long")


def _best(found: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` of every window over all parts, with their rank."""
    order = Window.partitionBy("anchor_no", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "no")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mine_negatives(
    vectors: DataFrame, anchors: Callable[[Column], Column], *, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", scale: int = SCALE, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A component x counts
    as floor(scale * x); a score is the integer inner product with the anchor, and shorter vectors end in
    zeros. Higher scores come first, ties by smaller id, null ids last. Anchors are the rows whose id
    fulfils ``anchors``. An anchor's positives are its first ``positives`` other rows of the same
    label; for each of them the first ``negatives`` rows of another label are returned with
    low * positive_score <= 100 * negative_score <= high * positive_score. Windows that hold fewer rows
    return those. Ids and labels are integers; ids may be null or repeated, every row then is a row of its own, and
    anchors that repeat an id return their rows each. Other columns are left out. Tables without rows or anchors
    give no rows. Components beyond 2^22 after scaling raise an error: scores would leave the integers of a double.
    """
    spark = vectors.sparkSession
    kept = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("vector"),
    ).filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & whole(F.col("vector")))
    points = stored(kept.select(
        "id", "label", scaled(F.col("vector"), scale).alias("point"), F.coalesce(anchors(F.col("id")), F.lit(False)).alias("anchor"),
        F.monotonically_increasing_id().alias("no")), "points")
    energy = points.select(F.posexplode("point").alias("place", "x")).groupBy("place").agg(
        F.sum(F.col("x").cast("double") ** 2).alias("energy")).collect()
    order = [r["place"] for r in sorted(energy, key=lambda r: (-r["energy"], r["place"]))] or [0]
    width = len(order)
    total, asked = points.agg(F.count("*"), F.count_if("anchor")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_ROWS))
    dealt = points.repartition(parts, "no")
    blocks = stored(_pack(dealt, order, BLOCK_ROWS).withColumn("part", F.spark_partition_id()), "blocks")
    count = max(1, -(-asked // CHUNK_ROWS))

    def chunked(rows: DataFrame, *extra: str) -> DataFrame:
        packed = _pack(rows.repartition(count, "no"), order, CHUNK_ROWS, extra)
        return stored(packed.withColumn("chunk", F.get("nos", F.lit(0))), "anchors")

    def any_score(chunk, batch, i):
        shape = (len(chunk["nos"]), 1)
        return {"low": np.full(shape, NONE), "high": np.full(shape, -NONE), "start": (chunk["rest"][0] ** 2)[:, None], "steps": LOWER}

    asking = points.filter("anchor")
    near = _best(_search(chunked(asking), blocks, parts, width, positives, True, any_score), positives)
    near = stored(near, "positives")

    def window(chunk, batch, i):
        """Ends by positive; an anchor with fewer positives has windows that take nothing."""
        lists = batch.column("a_tops").slice(i, 1).flatten()
        top = np.full((len(chunk["nos"]), positives), -1, np.int64)
        lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        top[np.repeat(np.arange(len(top)), lengths), at] = lists.flatten().to_numpy()
        return {"low": -((-low * top) // 100), "high": (high * top) // 100, "start": ((high * top) // 100).astype(float), "steps": NARROW}

    tops = near.groupBy("anchor_no").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("tops"))
    tops = tops.select(F.col("anchor_no").alias("no"), F.transform("tops", lambda t: t["score"]).alias("tops"))
    far = _best(_search(chunked(asking.join(tops, "no"), "tops"), blocks, parts, width, negatives, False, window), negatives)
    mine = near.select("anchor_no", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        far.select("anchor_no", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(mine, ["anchor_no", "place"]).join(asking.select(F.col("no").alias("anchor_no"), F.col("id").alias("anchor_id")), "anchor_no")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
