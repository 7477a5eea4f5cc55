"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed character n-grams of its lower-cased form. Each gets the
log ratio of its smoothed share among toxic and among other labelled texts; a logistic
regression over the features so scaled gives the score. Ratios are counted by Spark over the
sample of labelled rows; the regression is fitted on the driver from the few strongest features
of each sampled row. Scoring looks hashes up in one table and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.batches import filter_texts, map_texts, pieces, release, settled
from pairloom.session import stored

# n-grams of a piece of text take some forty times its bytes
PIECE = 1 << 20
BITS = 19
SIZES = (3, 4, 5)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BITS)


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of a text, padded with one space; one entry per place and size."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out, rolled = [], codes
    for size in range(2, max(SIZES) + 1):
        if len(rolled) < 2:
            break
        rolled = rolled[:-1] * np.uint64(1_000_003) + codes[size - 1:]
        if size in SIZES:
            mixed = (rolled ^ (rolled >> np.uint64(29)) ^ np.uint64(size)) * _PRIME
            out.append((mixed >> _SHIFT).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


@dataclass(frozen=True)
class ToxicityModel:
    """Hashes of the chosen n-grams in order, their weights (ratio times coefficient), and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def place(self) -> np.ndarray:
        """Number of every hash among the chosen, or -1."""
        table = np.full(1 << BITS, -1, np.int32)
        table[self.hashes] = np.arange(len(self.hashes), dtype=np.int32)
        return table


def labelled_sample(docs: DataFrame, labels: DataFrame, learn, *, id_col, text_col, label_col, max_rows) -> DataFrame:
    """At most ``max_rows`` labelled rows, chosen by a hash of the id; their ids are the
    broadcast side, so only their texts move. Rows with a null id or label are not used."""
    chosen = (
        labels.select(F.col(id_col).alias("chosen_id"), F.col(label_col).alias("label"))
        .filter(F.col("chosen_id").isNotNull() & F.col("label").isin(0, 1) & learn(F.col("chosen_id")))
        .groupBy("chosen_id").agg(F.max("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("chosen_id"), "chosen_id").limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("chosen_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "chosen_id").select("text", "label")


def _count(sample: DataFrame) -> DataFrame:
    """(gram, positive, negative): labelled texts that have a gram; gram -1 counts the texts."""
    def run(batches):
        counts = np.zeros((2, 1 << BITS), np.int32)
        totals = [0, 0]
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for a, b in pieces(batch.column(0)):
                for text, label in zip(batch.column(0).slice(a, b - a).to_pylist(), labels[a:b], strict=True):
                    counts[label, np.unique(grams(text))] += 1
                    totals[label] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_pydict({
            "gram": np.append(seen, -1).astype(np.int32),
            "positive": np.append(counts[1, seen], totals[1]).astype(np.int64),
            "negative": np.append(counts[0, seen], totals[0]).astype(np.int64),
        })

    partial = sample.mapInArrow(settled(run), "gram int, positive long, negative long")
    return partial.groupBy("gram").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


def _regression(sizes: np.ndarray, flat: np.ndarray, labels: np.ndarray, ratios: np.ndarray, penalty: float, steps: int):
    """Coefficients and bias of an L2-penalised logistic regression, by full-batch Adam. ``flat`` has the
    features of all rows, one row after the other, ``sizes`` how many each has."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    scale = ratios[flat]
    w, b, n, k = np.zeros(len(ratios)), 0.0, max(1, len(sizes)), len(ratios)
    moment, spread = np.zeros(k + 1), np.zeros(k + 1)
    share = min(max(labels.mean() if len(labels) else 0.5, 1e-3), 1 - 1e-3)
    b = float(np.log(share / (1 - share)))
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights=w[flat] * scale, minlength=len(sizes)) + b
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        g = np.bincount(flat, weights=error[owner] * scale, minlength=k) / n + penalty * w
        g = np.append(g, error.mean() if len(sizes) else 0.0)
        moment = 0.9 * moment + 0.1 * g
        spread = 0.99 * spread + 0.01 * g * g
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        b -= float(move[-1])
    return w, b


def fit(
    docs: DataFrame, labels: DataFrame, *, learn=lambda c: F.lit(True), id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", max_rows: int = 20_000, max_features: int = 4096, smoothing: float = 1.0,
    penalty: float = 1e-4, steps: int = 250,
) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows whose id ``learn`` admits.

    Both bounds are parameters: what reaches the driver is at most 2**19 counts and
    ``max_features`` small numbers per sampled row. Without a labelled row, or with one class
    only, the model has no feature and gives every text the same score.
    """
    sample = stored(
        labelled_sample(docs, labels, learn, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows)
        .repartition(8), "toxicity-sample",
    )
    counted = _count(sample).toArrow().to_pandas()
    total = counted[counted.gram == -1]
    positive, negative = (int(total[c].sum()) for c in ("positive", "negative"))
    if not positive or not negative:
        share = (positive + 1) / (positive + negative + 2)
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    counted = counted[counted.gram >= 0]
    p, q = counted.positive.to_numpy(float), counted.negative.to_numpy(float)
    pooled = (p + q) / (positive + negative)
    z = np.abs(p / positive - q / negative) / np.sqrt(pooled * (1 - pooled) * (1 / positive + 1 / negative) + 1e-12)
    best = np.lexsort((counted.gram.to_numpy(), -np.round(z, 9)))[:max_features]
    hashes = np.sort(counted.gram.to_numpy()[best]).astype(np.int64)
    at = counted.set_index("gram").loc[hashes]
    p, q = at.positive.to_numpy(float) + smoothing, at.negative.to_numpy(float) + smoothing
    ratios = np.log(p / p.sum()) - np.log(q / q.sum())
    table = ToxicityModel(hashes, ratios, 0.0).place()

    def chosen(batches):
        for batch in batches:
            labels_ = batch.column(1)
            for a, b in pieces(batch.column(0)):
                found = [table[grams(t)] for t in batch.column(0).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([np.unique(f[f >= 0]) for f in found], pa.list_(pa.int32())), labels_.slice(a, b - a)],
                    names=["found", "label"])

    rows = sample.mapInArrow(settled(chosen), "found array<int>, label int").toArrow()
    found = rows.column("found").combine_chunks()
    sizes, flat = pc.list_value_length(found).to_numpy(zero_copy_only=False), found.flatten().to_numpy()
    w, bias = _regression(sizes, flat, rows.column("label").to_numpy().astype(float), ratios, penalty, steps)
    del counted, at, rows, found, flat
    release()  # the driver goes on for long
    return ToxicityModel(hashes, w * ratios, bias)


def _scorer(model: ToxicityModel):
    table, weights, bias = model.place(), model.weights, model.bias

    def one(text):
        at = table[grams(text)]
        at = np.unique(at[at >= 0])
        return 1 / (1 + np.exp(-np.clip(weights[at].sum() + bias, -40, 40)))

    return lambda texts: np.array([one(t) for t in texts])


def score(
    docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
) -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1), predicted (1 from ``threshold`` on).

    Whole texts. A null or empty text has the score of a text without a known n-gram. Null ids,
    repeated rows and ids stay as they are; other columns are left out. An empty table gives no rows.
    """
    def make():
        scores_of = _scorer(model)

        def work(texts):
            scores = scores_of(texts)
            return {"score": scores, "predicted": (scores >= threshold).astype(np.int32)}

        return work

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_texts(docs, make, fields, id_col=id_col, text_col=text_col, most=PIECE)


def without_toxic(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns."""
    def make():
        scores_of = _scorer(model)
        return lambda texts: scores_of(texts) < threshold

    return filter_texts(docs, make, text_col=text_col, most=PIECE)
