"""Token ids in Simple-8b segments: written in document order, read back without Python loops.

A 64-bit word holds a 4-bit selector and 60 bits of ids, all of one width: 120 zeros, or 60, 30,
20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 ids. Selector 0 is the escape: its payload numbers a raw 64-bit
value behind the words, for ids of 60 bits or more. Ids are packed in blocks; the segment stores
every block's first word, so a reader may start at any block.

The file format is a folder of Parquet part files, in ascending order of id, whose rows are
segments: shard and segment number, the documents' ids and lengths, and the packed payload. Spark's
writer commits parts whole, so a lost executor leaves no half segment. Texts move once, into
ranges of the document id; nothing else is shuffled but sums per segment.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from pairloom.llm.batches import pieces, ragged
from pairloom.llm.words import SPACED, WordTable
from pairloom.session import new_folder

# Ids per word and bits per id of selectors 1 to 15. Selector 1 packs zeros.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
MAGIC = b"S8B1"
BLOCK = 1 << 14
SEGMENT_IDS = 1 << 20
HELD_WORDS = 1_200_000
STOPS = (b".", b",", b";", b":", b"!", b"?")


def _greedy(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First id and selector of every word of one block: at each place the fullest word."""
    n = len(ids)
    # bits of each id; rounding may call an id of 60 bits wider, which then is escaped
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    choice = np.full(n, 15, np.uint8)
    choice[bits > 60] = 0
    widest, width = bits, 1  # most bits of any of ``width`` ids from each place on
    for s in range(14, 0, -1):
        count = int(COUNTS[s])
        while width < count and width < n:
            step = min(width, count - width)
            widest, width = np.maximum(widest[:-step], widest[step:]), width + step
        fits = widest <= WIDTHS[s]
        if width < count or not fits.any():
            break
        choice[:len(fits)][fits] = s
    step = COUNTS[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    first = np.array(starts, np.int64)
    return first, choice[first].astype(np.int64)


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment's payload: header, first word of each block, words, escaped values."""
    ids = np.ascontiguousarray(ids, np.uint64)
    starts, selectors, offsets = [], [], [0]
    for at in range(0, len(ids), block):
        first, chosen = _greedy(ids[at:at + block])
        starts.append(first + at)
        selectors.append(chosen)
        offsets.append(offsets[-1] + len(first))
    first = np.concatenate([*starts, np.empty(0, np.int64)])
    chosen = np.concatenate([*selectors, np.empty(0, np.int64)])
    words = chosen.astype(np.uint64) << np.uint64(60)
    escaped = chosen == 0
    words[escaped] |= np.arange(escaped.sum(), dtype=np.uint64)
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        for k in range(COUNTS[s] if len(rows) else 0):
            words[rows] |= ids[first[rows] + k] << np.uint64(k * WIDTHS[s])
    head = struct.pack("<4sQQQQ", MAGIC, len(ids), block, len(words), int(escaped.sum()))
    return b"".join([
        head, np.array(offsets, "<u8").tobytes(), words.astype("<u8").tobytes(), ids[first[escaped]].astype("<u8").tobytes(),
    ])


def unpack(payload: bytes, first_block: int = 0, blocks: int | None = None) -> np.ndarray:
    """The ids of a payload, or of ``blocks`` blocks from ``first_block`` on."""
    magic, n, block, n_words, n_escaped = struct.unpack_from("<4sQQQQ", payload)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    at, n_blocks = struct.calcsize("<4sQQQQ"), -(-n // block)
    offsets = np.frombuffer(payload, "<u8", n_blocks + 1, at).astype(np.int64)
    at += 8 * (n_blocks + 1)
    last = n_blocks if blocks is None else min(n_blocks, first_block + blocks)
    first_block = min(first_block, n_blocks)
    words = np.frombuffer(payload, "<u8", n_words, at)[offsets[first_block]:offsets[max(last, first_block)]]
    escapes = np.frombuffer(payload, "<u8", n_escaped, at + 8 * n_words)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    sizes = COUNTS[chosen]
    places = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    body = words & np.uint64((1 << 60) - 1)
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s] if len(rows) else 0):
            out[places[rows] + k] = (body[rows] >> np.uint64(k * WIDTHS[s])) & mask
    rows = np.flatnonzero(chosen == 0)
    out[places[rows]] = escapes[body[rows].astype(np.int64)]
    return out


class WordEncoder(WordTable):
    """Ids of words for a tokenizer that ignores case, whose tokens never reach across white space
    and whose pretokens end with a token of their own kind.

    With ``added``, the strings of the file's added tokens are those tokens, as the library has it: texts are
    cut at them first. Without, they are ordinary text. A stop behind a word of letters is a
    pretoken by itself, so such a word takes the ids of the word and those of the stop.
    """

    def __init__(self, definition: str, added: bool = False):
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        listed = json.loads(definition).get("added_tokens") or [] if added else []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in listed):
            raise ValueError("added tokens other than plain strings")
        # upper-case words never come from a text: its words are lower-cased
        self.added_tokens = {t["content"].encode(): (b"T%d" % t["id"], t["id"]) for t in listed}
        # the first that fits at a place, the longest of several
        self.cut = re.compile(b"|".join(re.escape(c) for c in sorted(self.added_tokens, key=len, reverse=True)))
        super().__init__(SPACED, HELD_WORDS)

    def clear(self):
        super().clear()
        self.ids = np.zeros(0, np.uint32)
        self.first, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        if self.added_tokens:
            names, ids = zip(*self.added_tokens.values(), strict=True)
            self._add(list(names), np.array(ids, np.uint32), np.ones(len(ids), np.int64))

    def prepared(self, text):
        if not self.added_tokens or not self.cut.search(text):
            return super().prepared(text)
        parts, at = [], 0
        for found in self.cut.finditer(text):
            parts += [super().prepared(text[at:found.start()]), self.added_tokens[found[0]][0]]
            at = found.end()
        return b" ".join([*parts, super().prepared(text[at:])])

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and ids per word."""
        every = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        sizes = np.array([len(e.ids) for e in every], np.int64)
        return np.fromiter(itertools.chain.from_iterable(e.ids for e in every), np.uint32, int(sizes.sum())), sizes

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are one pretoken each, as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        # a letter may turn into two pretokens when its case changes
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else self._encoded(words)

    def _add(self, words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.number) + 1, len(self.number) + 1 + len(words)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])

    def _numbers(self, words):
        new = [w for w in words if w not in self.number]
        if new:
            plain, odd, stopped = {}, [], []
            for w in new:
                text = w.decode()
                if text.isalpha():
                    plain[w] = text
                elif w[-1:] in STOPS and text[:-1].isalpha():
                    stopped.append(w)
                else:
                    odd.append(w)
            for w in stopped:
                if w[:-1] not in self.number:
                    plain[w[:-1]] = w[:-1].decode()
            odd += [s for s in {w[-1:] for w in stopped}.difference(odd) if s not in self.number]
            listed = list(plain.values())
            made = [self._letters(listed[k:k + 1000]) for k in range(0, len(listed), 1000)]
            made.append(self._encoded([w.decode() for w in odd]))
            self._add([*plain, *odd], *(np.concatenate(m) for m in zip(*made)))
            if stopped:
                two = np.array([(self.number[w[:-1]], self.number[w[-1:]]) for w in stopped]).ravel()
                size = self.size[two]
                self._add(stopped, self.ids[ragged(self.first[two], size)], size.reshape(-1, 2).sum(axis=1))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """32-bit ids of every text."""
        numbers = self.texts(texts)
        flat = np.concatenate([*numbers, np.empty(0, np.int64)])
        size = self.size[flat]
        ids = self.ids[ragged(self.first[flat], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([len(n) for n in numbers], dtype=np.int64)]
        return np.split(ids, ends[:-1]) if len(texts) else []


_encoders: dict[tuple[int, bool], WordEncoder] = {}


def _encoder(definition: str, added: bool) -> WordEncoder:
    key = hash(definition), added
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[key] = WordEncoder(definition, added)
    return _encoders[key]


SEGMENT = T.StructType([
    T.StructField("segment", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()),
])


def write_ids(
    docs: DataFrame, definition_path: str, end_id: int, path: str, *, id_col: str = "doc_id", text_col: str = "text",
    added: bool = False,
) -> None:
    """Encode every text, append ``end_id``, and write segments in ascending order of id.

    A null id comes first, equal ids follow the order of their texts, a null text is empty and has the
    end id alone. A text longer than a segment is one segment. An empty table writes no
    segment. Other columns are left out. ``added`` takes the strings of the file's added tokens for those
    tokens, the library's default.
    """
    with open(definition_path) as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)), *SEGMENT.fields])
    end = int(end_id)

    def run(batches):
        encoder, arrow = _encoder(definition.value, added), to_arrow_schema(schema)
        tail, number, held, ids = np.array([end], np.uint32), 0, 0, []
        texts: list[np.ndarray] = []

        def segment():
            lengths = [len(t) + 1 for t in texts]
            flat = np.concatenate([x for t in texts for x in (t, tail)])
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(
                    ([ids], [number], [len(flat)], [lengths], [pack(flat)]), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for a, b in pieces(batch.column(1)):
                encoded = encoder.encode(batch.column(1).slice(a, b - a).to_pylist())
                for key, one in zip(batch.column(0).slice(a, b - a).to_pylist(), encoded, strict=True):
                    if texts and held + len(one) > SEGMENT_IDS:
                        yield segment()
                        number, held, ids, texts = number + 1, 0, [], []
                    ids.append(key)
                    texts.append(one)
                    held += len(one) + 1
        if texts:
            yield segment()

    (rows.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, schema).withColumn("shard", F.spark_partition_id())
     .write.option("compression", "none").parquet(path))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a written folder: doc_id, start among all ids, n_tokens, ids_crc32.

    Segments are read one by one; the places of segments come from sums per segment.
    """
    table = spark.read.parquet(path)
    sizes = table.select("shard", "segment", "n_ids")
    inside = Window.partitionBy("shard").orderBy("segment")
    # one row per written file: its number is that of the writer's partitions
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn(
        "shard_start", F.sum("n").over(Window.orderBy("shard")) - F.col("n")
    )
    places = sizes.withColumn("inside", F.sum("n_ids").over(inside) - F.col("n_ids")).join(shards, "shard").select(
        "shard", "segment", (F.col("shard_start") + F.col("inside")).alias("place")
    )
    id_type = table.schema["doc_ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("segment", T.LongType()), T.StructField("doc_id", id_type),
        T.StructField("inside", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for row in range(batch.num_rows):
                shard, segment, ids, lengths, payload = (batch.column(c)[row] for c in range(5))
                flat = unpack(payload.as_py()).astype("<u4")
                size = np.array(lengths.as_py(), np.int64)
                start = np.cumsum(size) - size
                sums = [zlib.crc32(flat[a:a + n].tobytes()) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
                n = len(size)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard.as_py()] * n, arrow.field(0).type), pa.array([segment.as_py()] * n, arrow.field(1).type),
                    ids.values.cast(arrow.field(2).type), pa.array(start, arrow.field(3).type),
                    pa.array(size, arrow.field(4).type), pa.array(sums, arrow.field(5).type),
                ], schema=arrow)

    documents = table.select("shard", "segment", "doc_ids", "lengths", "payload").mapInArrow(run, schema)
    return documents.join(places, ["shard", "segment"]).select(
        "doc_id", (F.col("place") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def write_and_read(docs: DataFrame, definition_path: str, end_id: int, **columns) -> DataFrame:
    """Write the ids of ``docs`` to a new folder and read the documents back from it."""
    spark = docs.sparkSession
    path = new_folder(spark, "token-ids")
    write_ids(docs, definition_path, end_id, path, **columns)
    return read_documents(spark, path)
