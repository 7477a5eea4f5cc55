"""Byte-level BPE by DuckDB recursive queries inside each task, and decoding by ordered aggregation.

A task cuts its texts into pretokens, and encodes every pretoken it has not met lately. All new ones
of a batch go through one recursive query: rows (piece, position, token) meet the table of
mergeable pairs, each piece contracts its leftmost pair of minimum rank, and so on until no pair
is left. Ids of a text are the ids of its pretokens in order. Decoding joins (text, position, id)
rows with the vocabulary and concatenates the bytes in order of position, again in DuckDB.

Nothing is shuffled. A task holds one piece of texts of bounded size, a bounded cache, and a DuckDB
connection with a memory limit and one thread.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterable, Sequence

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairloom.llm.batches import map_texts, ragged

MEMORY = "160MB"
HELD = 1_000_000
PIECE = 2 << 20
LONG_PIECE = 48
LONG_STEPS = 24
LONG_BATCH = 1 << 17
# A chunk ends where white space follows something else, or where a plain run of letters and
# digits ends before a stop. No pretoken reaches across such a place, so chunks are cut into
# pretokens one by one. The four controls are white space to Python alone; texts with them
# are taken as one chunk.
CHUNK = re.compile(r"\s*[^\W_]+(?=[\s.,;:!?]|\Z)|\s*\S+|\s+")
ODD_SPACE = re.compile(r"[\x1c-\x1f]")

# One row per piece and step; its tokens are unnested into positions to meet the pairs.
STEP = """
WITH RECURSIVE step(w, ids, n) AS (
  SELECT w, ids, 0 FROM pieces
  UNION ALL
  (WITH pairs AS (SELECT w, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, unnest(range(1, len(ids))) AS p FROM step),
   best AS (SELECT w, min(m * 65536::BIGINT + p) AS b FROM pairs
            JOIN merges ON pairs.l = merges.l AND pairs.r = merges.r GROUP BY w)
   SELECT w, ids[:b % 65536 - 1] || [(b // 65536)::INTEGER] || ids[b % 65536 + 2:], n + 1
   FROM step JOIN best USING (w))
)
SELECT w, arg_max(ids, n) FROM step GROUP BY w
"""

# For long pieces: where no pair with the merged token ranks lower than that token, its other
# places may be contracted in the same step, every second one of a run of overlapping pairs.
LONG_STEP = """
WITH RECURSIVE step(w, p, t, n) AS (
  SELECT w, p, t, 0 FROM bytes
  UNION ALL
  (WITH pairs AS (SELECT w, p, t, n, lead(t) OVER o AS r, lag(p) OVER o AS before, row_number() OVER o AS k
                  FROM step WHERE n < {steps} WINDOW o AS (PARTITION BY w ORDER BY p)),
   ranked AS (SELECT pairs.*, m FROM pairs LEFT JOIN merges ON t = merges.l AND pairs.r = merges.r),
   best AS (SELECT *, min(struct_pack(m := m, p := p)) FILTER (m IS NOT NULL) OVER (PARTITION BY w) AS b
            FROM ranked),
   hits AS (SELECT w, p, k - row_number() OVER (PARTITION BY w ORDER BY k) AS run, k
            FROM best WHERE m = b.m AND (p = b.p OR m NOT IN (SELECT m FROM unsafe))),
   taken AS (SELECT w, p FROM hits QUALIFY row_number() OVER (PARTITION BY w, run ORDER BY k) % 2 = 1)
   SELECT best.w, best.p, CASE WHEN taken.p IS NULL THEN best.t ELSE b.m END, n + 1
   FROM best LEFT JOIN taken ON best.w = taken.w AND best.p = taken.p
             LEFT JOIN taken AS previous ON best.w = previous.w AND best.before = previous.p
   WHERE b IS NOT NULL AND previous.p IS NULL)
), final AS (SELECT w, max(n) AS n FROM step GROUP BY w)
SELECT w, p, t, n FROM step JOIN final USING (w, n) ORDER BY w, p
"""

DECODE = """
SELECT d, string_agg(piece, '' ORDER BY p) AS text FROM tokens JOIN vocabulary USING (id) GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and number per line."""
    with open(path, "rb") as lines:
        return _ranks(lines)


def _ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """Encodes and decodes with one rank table and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: str = MEMORY, held: int = HELD):
        self.pattern, self.held = regex.compile(pattern), held
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1")
        self.con.execute(f"SET memory_limit = '{memory}'")
        self.con.execute("SET temp_directory = ''")  # nothing is spilled to a worker's own disk
        self._table("merges", l=left, r=right, m=merged)
        self.con.execute("CREATE TABLE unsafe AS SELECT DISTINCT l AS m FROM merges WHERE m < l"
                         " UNION SELECT DISTINCT r FROM merges WHERE m < r")
        self.con.register("given", pa.table({
            "id": pa.array(list(ranks.values()), pa.int32()), "piece": [t.hex() for t in ranks],
        }))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.decimal = np.array([str(i) for i in range(max(ranks.values()) + 1)], object)
        self.clear()

    def clear(self) -> None:
        """Forget the chunks met so far."""
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _table(self, name: str, **columns) -> None:
        self.con.register("given", pa.table({c: pa.array(v, pa.int32()) for c, v in columns.items()}))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _bytes(self, pieces: Sequence[bytes]) -> pa.Table:
        sizes = np.array([len(p) for p in pieces], np.int64)
        starts = np.cumsum(sizes) - sizes
        all_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        return pa.table({
            "w": np.repeat(np.arange(len(pieces), dtype=np.int32), sizes),
            "p": (np.arange(len(all_bytes)) - np.repeat(starts, sizes)).astype(np.int32),
            "t": self.single[all_bytes],
        })

    def _encode_long(self, pieces: Sequence[bytes]) -> list[list[int]]:
        rows, done = self._bytes(pieces), {}
        while rows.num_rows:
            self.con.register("bytes", rows)
            got = self.con.execute(LONG_STEP.format(steps=LONG_STEPS)).fetchnumpy()
            w, p, t, n = (np.asarray(got[c]) for c in "wptn")
            open_ = n == LONG_STEPS
            for piece in np.unique(w[~open_]):
                done[int(piece)] = t[w == piece].tolist()
            rows = pa.table({c: v[open_].astype(np.int32) for c, v in (("w", w), ("p", p), ("t", t))})
        return [done[k] for k in range(len(pieces))]

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct pretokens. Those of over 48 bytes go in small groups."""
        distinct = sorted(set(pieces), key=len)
        short = [p for p in distinct if 0 < len(p) <= LONG_PIECE]
        out = {b"": []}
        for at in range(0, len(short), 20_000):
            part = short[at:at + 20_000]
            ends = np.cumsum([0] + [len(p) for p in part]).astype(np.int32)
            tokens = self.single[np.frombuffer(b"".join(part), np.uint8)]
            self.con.register("pieces", pa.table({
                "w": np.arange(len(part), dtype=np.int32), "ids": pa.ListArray.from_arrays(ends, tokens)}))
            out.update((part[w], ids) for w, ids in self.con.execute(STEP).fetchall())
        group: list[bytes] = []
        for piece in [p for p in distinct if len(p) > LONG_PIECE] + [None]:
            if group and (piece is None or sum(map(len, group)) + len(piece) > LONG_BATCH):
                out.update(zip(group, self._encode_long(group), strict=True))
                group = []
            if piece is not None:
                group.append(piece)
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Encode those of the distinct chunks that are new."""
        new = [c for c in chunks if c not in self.number]
        if not new:
            return
        cut = [
            [c.encode()] if (c[1:] if c[0] == " " else c).isalpha() else [w.encode() for w in self.pattern.findall(c)]
            for c in new
        ]
        ids = self.encode_pieces(w for words in cut for w in words)
        own = [ids[words[0]] if len(words) == 1 else [i for w in words for i in ids[w]] for words in cut]
        size = np.array([len(o) for o in own], np.int64)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(own), np.int32, int(size.sum()))])

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of every text."""
        if len(self.number) > self.held:
            self.clear()
        chunked = [[t] if ODD_SPACE.search(t) else CHUNK.findall(t) for t in texts]
        flat = pa.array(itertools.chain.from_iterable(chunked), pa.large_string()).dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        self._learn(distinct)
        at = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[flat.indices.to_numpy()]
        size = self.size[at]
        ids = self.ids[ragged(self.first[at], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([len(c) for c in chunked], dtype=np.int64)]
        return np.split(ids, ends[:-1]) if len(texts) else []

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids joined by commas."""
        return hashlib.sha256(",".join(self.decimal[ids].tolist()).encode()).hexdigest()

    def decode(self, ids: Sequence[np.ndarray]) -> list[bytes]:
        """Bytes of every id sequence; an empty one gives no bytes."""
        sizes = np.array([len(i) for i in ids], np.int64)
        flat = np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)
        self.con.register("tokens", pa.table({
            "d": np.repeat(np.arange(len(ids), dtype=np.int32), sizes),
            "p": np.arange(len(flat), dtype=np.int32), "id": flat,
        }))
        out = [b""] * len(ids)
        for d, text in self.con.execute(DECODE).fetchall():
            out[d] = bytes.fromhex(text)
        return out


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = False, piece_bytes: int = PIECE, held: int = HELD,
) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256, decoded_equal, and
    with ``keep_ids`` the ids.

    The rank file is read on the driver (a fixed vocabulary) and sent with the function. Special
    tokens are ordinary text. A null or empty text has no ids; both digests are then those of empty
    input. Null ids, repeated rows and ids stay as they are; other columns are left out. An empty
    table gives no rows. A task takes texts of ``piece_bytes`` at a time, or one, and remembers about
    ``held`` chunks. Texts of any length are encoded whole; a single pretoken of very many bytes
    costs time by its length times its steps, never more memory than its own rows times a
    fixed number of steps.
    """
    with open(ranks_path, "rb") as file:
        lines = docs.sparkSession.sparkContext.broadcast(file.read())
    fields = [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()), T.StructField("decoded_equal", T.BooleanType()),
    ]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def make():
        # one per task: workers are used again by other steps, which need the memory of its tables
        coder = Coder(_ranks(lines.value.splitlines()), pattern, held=held)

        def work(texts):
            encoded = coder.encode(texts)
            decoded = coder.decode(encoded)
            out = {
                "n_tokens": [len(ids) for ids in encoded],
                "ids_sha256": [coder.digest(ids) for ids in encoded],
                "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in decoded],
                "decoded_equal": [b == t.encode() for b, t in zip(decoded, texts, strict=True)],
            }
            return out | ({"ids": encoded} if keep_ids else {})

        return work

    return map_texts(docs, make, fields, id_col=id_col, text_col=text_col, most=piece_bytes)
