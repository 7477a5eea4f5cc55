"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a document as long as some benchmark item gets a 64-bit SimHash of its words.
Fingerprints of the items are filed in four tables of 16-bit blocks, under every value within two
bits of their own: if a window is within ``RADIUS`` = 11 bits of an item, one of its four
blocks is within two bits of the item's, so the tables miss none. What they let through is measured
by its full Hamming distance, and what remains by the exact similarity of five-word shingles,
weighted by how often they occur: the sum of the lesser counts over the sum of the greater.

Windows start at every fourth word (every word for items under 8 words, every eighth from 64 words on,
every sixteenth from 128 on, and so on). Each item is filed once per alignment, from its first word that a window can start at
to the last whole stride, so a copied passage meets a fingerprint of its own words wherever it starts. Documents pass by once per block of items; a block is at most ``block_bytes`` of item text in
expectation, so what is sent to the tasks is bounded. Nothing of a document is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.llm.batches import filter_texts, pieces, ragged, settled
from pairloom.llm.words import PLAIN, WordTable

RADIUS = 11
SHINGLE = 5
CHUNK = 1 << 14
PIECE = 1 << 20
# every word of the table has 64 signs
HELD = 1 << 16


def shingles(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit number per window of five words; fewer words make one shingle, none make none."""
    width = min(SHINGLE, len(hashes))
    if not width:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + len(out)]
    return out


def similarity(left: np.ndarray, right: np.ndarray) -> float:
    """Weighted Jaccard similarity of two shingle lists; 0 if both are empty."""
    a, n = np.unique(left, return_counts=True)
    b, m = np.unique(right, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = int(np.minimum(n[i], m[j]).sum())
    return shared / max(1, len(left) + len(right) - shared)


def _stride(n_words: int) -> int:
    """Words between window starts for items of a length."""
    return 1 if n_words < 8 else 1 << max(2, n_words.bit_length() - 4)


class SignedWords(WordTable):
    """Words with the bits of their hashes as +1 and -1; number 0, the padding, has zeros."""

    def clear(self):
        super().clear()
        self.signs = np.zeros((1024, 64), np.int8)

    def added(self, first, n):
        if len(self.signs) < len(self.hashes):
            more = np.zeros((len(self.hashes) - len(self.signs), 64), np.int8)
            self.signs = np.concatenate([self.signs, more])
        own = self.hashes[first:first + n].astype("<u8").view(np.uint8).reshape(-1, 8)
        self.signs[first:first + n] = 2 * np.unpackbits(own, axis=1, bitorder="little").astype(np.int8) - 1


_SINGLE = [1 << i for i in range(16)]
# all differences of at most two bits within a block
FLIPS = np.array([0, *_SINGLE, *(a ^ b for a in _SINGLE for b in _SINGLE if a < b)], np.uint16)


def _block_table(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints filed under every 16-bit number within two bits of their block's value:
    how many, where they start, and their numbers."""
    near = (values[:, None] ^ FLIPS[None, :]).ravel()
    kind = np.int32 if near.size < 1 << 31 else np.int64
    number = np.repeat(np.arange(len(values), dtype=kind), len(FLIPS))
    count = np.bincount(near, minlength=1 << 16)
    small = count.astype(np.min_scalar_type(int(count.max())))
    return small, (np.cumsum(count) - count).astype(kind), number[np.argsort(near, kind="stable")]


class ItemIndex:
    """Fingerprints of items by window size, and the items' own shingles."""

    def __init__(self, ids: list, texts: list[str]):
        words, self.ids, self.shingles, self.sizes = SignedWords(PLAIN), [], [], []
        filed: dict[tuple[int, int], list] = {}
        for key, numbers in zip(ids, words.texts(texts), strict=True):
            n = len(numbers)
            if not n:
                continue
            item, step = len(self.ids), _stride(n)
            self.ids.append(key)
            self.sizes.append(n)
            self.shingles.append(shingles(words.hashes[numbers]))
            for offset in range(min(step, n)):
                size = (n - offset) // step * step
                if size:
                    total = words.signs[numbers[offset:offset + size]].sum(axis=0, dtype=np.int32)
                    print_ = np.packbits(total > 0, bitorder="little").view("<u8")[0]
                    filed.setdefault((step, size), []).append((print_, item, offset))
        self.all_shingles = np.unique(np.concatenate([*self.shingles, np.empty(0, np.uint64)]))
        self.need = np.array([len(s) if n >= SHINGLE else 0 for s, n in zip(self.shingles, self.sizes, strict=True)])
        self.steps = np.array([_stride(n) for n in self.sizes])
        self.sizes = np.array(self.sizes, np.int64)
        self.classes = []  # (stride, size, four block tables, fingerprints, items, offsets)
        for (step, size), rows in sorted(filed.items()):
            prints = np.array([r[0] for r in rows], np.uint64)
            tables = [_block_table(values) for values in prints.view(np.uint16).reshape(-1, 4).T]
            self.classes.append((step, size, tables, prints, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])))


class Matcher:
    """Finds the items whose passages stand in documents."""

    def __init__(self, index: ItemIndex, threshold: float):
        self.index, self.threshold, self.words = index, threshold, SignedWords(PLAIN, HELD)

    def _windows(self, signs: np.ndarray, step: int, classes: list):
        """(start, item offset, item) of windows within the radius, for one stretch of words."""
        n, longest = len(signs) // step, max(c[1] for c in classes)
        # running sums may wrap around; the difference over a window that fits the type does not
        kind = np.int8 if longest < 1 << 7 else np.int16 if longest < 1 << 15 else np.int32
        parts = signs[:n * step].reshape(n, step, 64)
        sums = parts[:, 0].astype(kind)
        for k in range(1, step):
            sums += parts[:, k]
        total = np.zeros((n + 1, 64), kind)
        np.cumsum(sums, axis=0, dtype=kind, out=total[1:])
        for _, size, tables, prints, items, offsets in classes:
            wide = size // step
            if wide > n:
                continue
            blocks = np.packbits((total[wide:] - total[:-wide]) > 0, axis=1, bitorder="little").view("<u2")
            own = blocks.view("<u8").ravel()
            for b, (count, start, number) in enumerate(tables):
                value = blocks[:, b]
                some = count[value]
                at = np.flatnonzero(some)
                if len(at):
                    some = some[at].astype(np.int64)
                    k = number[ragged(start[value[at]], some)]
                    w = np.repeat(at, some)
                    near = np.bitwise_count(own[w] ^ prints[k]) <= RADIUS
                    w, k = w[near], k[near]
                    yield w * step, offsets[k], items[k]

    def candidates(self, numbers: np.ndarray):
        """(first word, item) of near windows in a padded line of word numbers."""
        by_step: dict[int, list] = {}
        for one in self.index.classes:
            by_step.setdefault(one[0], []).append(one)
        for step, classes in by_step.items():
            longest = max(c[1] for c in classes)
            span = max(CHUNK, 2 * longest) // step * step
            for first in range(0, len(numbers), span):
                signs = self.words.signs.take(numbers[first:first + span + longest], axis=0)
                short = -len(signs) % step
                if short:
                    signs = np.concatenate([signs, np.zeros((short, 64), np.int8)])
                for at, offset, item in self._windows(signs, step, classes):
                    yield first + at - offset, item

    def match(self, texts: list[str]) -> list[list[tuple[int, float, int, int]]]:
        """For every text: (item, similarity, first word, words) of its best place per item."""
        numbers = self.words.texts(texts)
        # windows may stick out of a document by as much as the threshold allows
        pad = int(max(self.index.sizes.tolist(), default=0) * (1 - self.threshold)) + 8
        gap = np.zeros(pad, np.int64)
        line = np.concatenate([gap, *(x for n in numbers for x in (n, gap))])
        begins = pad + np.cumsum([0] + [len(n) + pad for n in numbers[:-1]]) if numbers else np.empty(0, np.int64)
        ends = begins + np.array([len(n) for n in numbers], np.int64)
        # an exact bound: a place similar enough shares that part of the item's shingles
        own, listed = shingles(self.words.hashes[line]), self.index.all_shingles
        shared = np.zeros(len(line) + 1, np.int64)
        if len(listed):
            at = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
            np.cumsum(listed[at] == own, out=shared[1:len(own) + 1])
            shared[len(own) + 1:] = shared[len(own)]
        places: dict[tuple[int, int], set] = {}
        for at, item in self.candidates(line):
            size, step = self.index.sizes[item], self.index.steps[item]
            reach = np.clip([at - step, at + size + step - SHINGLE + 1], 0, len(line))
            full = shared[reach[1]] - shared[reach[0]] >= self.threshold * self.index.need[item]
            at, item, size = at[full], item[full], size[full]
            # the document that holds the window's middle; one in the padding belongs to none
            middle = at + size // 2
            doc = np.searchsorted(begins, middle, side="right") - 1
            ok = (doc >= 0) & (middle < ends[doc])
            for d, i, a in zip(doc[ok].tolist(), item[ok].tolist(), at[ok].tolist(), strict=True):
                places.setdefault((d, i), set()).add(a - int(begins[d]))
        found: list[list] = [[] for _ in texts]
        for (d, i), starts in places.items():
            size, step = int(self.index.sizes[i]), int(self.index.steps[i])
            hashes, best = self.words.hashes[numbers[d]], (0.0, 0, 0)
            tried = {a + k for a in starts for k in range(-step, step + 1)}
            for a in sorted(tried):
                low, high = max(0, a), min(len(hashes), a + size)
                if high > low:
                    value = similarity(self.index.shingles[i], shingles(hashes[low:high]))
                    best = max(best, (value, -low, high - low))
            if best[0] >= self.threshold:
                found[d].append((i, best[0], -best[1], best[2]))
        return found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The benchmark in index blocks of bounded size, one at a time."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).toArrow()
        yield ItemIndex(own.column("item").to_pylist(), own.column("text").to_pylist())


def _matcher(spark, index: ItemIndex, threshold: float) -> Callable[[], Matcher]:
    shared = spark.sparkContext.broadcast(index)
    return lambda: Matcher(shared.value, threshold)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", threshold: float = 0.8, block_bytes: int = 8 << 20,
) -> DataFrame:
    """One row per document row and item whose passage it holds: doc_id, item_id, similarity,
    first_word, n_words (the best place; of equal ones the first).

    A row with no match gives no row; so do null and empty texts, and items that are null or have no
    word match nothing. An item of under five words is one shingle. Null ids are kept, repeated rows
    and items match each by themselves; other columns are left out. An empty table on either
    side gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType),
        T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()),
    ])
    out = docs.sparkSession.createDataFrame([], schema)
    for k, index in enumerate(_blocks(benchmark, item_col, item_text_col, block_bytes)):
        make = _matcher(docs.sparkSession, index, threshold)

        def run(batches, make=make):
            matcher, arrow = make(), to_arrow_schema(schema)
            for batch in batches:
                ids = batch.column(0).cast(arrow.field(0).type)
                for a, b in pieces(batch.column(1), PIECE):
                    got = [
                        (a + row, matcher.index.ids[i], round(value, 6), first, n)
                        for row, found in enumerate(matcher.match(batch.column(1).slice(a, b - a).to_pylist()))
                        for i, value, first, n in found
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([g[0] for g in got], pa.int64()))]
                        + [pa.array([g[c] for g in got], arrow.field(c).type) for c in range(1, 5)], schema=arrow)

        made = rows.mapInArrow(settled(run), schema)
        out = made if k == 0 else out.union(made)
    return out


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", threshold: float = 0.8, block_bytes: int = 8 << 20,
) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with all their columns."""
    for index in _blocks(benchmark, item_col, item_text_col, block_bytes):
        make = _matcher(docs.sparkSession, index, threshold)

        def clean(make=make):
            matcher = make()
            return lambda texts: [not found for found in matcher.match(texts)]

        docs = filter_texts(docs, clean, text_col=text_col, most=PIECE)
    return docs
