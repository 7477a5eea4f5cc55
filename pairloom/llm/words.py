"""Words of many texts at once, numbered and hashed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

HELD = 300_000
_LOWER = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
# Byte tables over UTF-8: A-Z lower-cased, and what separates words made a space.
SPACED = bytes(32 if 9 <= b <= 13 else _LOWER[b] for b in range(256))
PLAIN = bytes(_LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words, the number among them of each word in order, and words per text."""
    plain = pa.array([t.strip() for t in texts], pa.large_string())
    split = pc.ascii_split_whitespace(plain)
    # splitting an empty text gives one empty word
    sizes = np.where(pc.binary_length(plain).to_numpy() > 0, pc.list_value_length(split).to_numpy(), 0)
    listed = pc.filter(split, pa.array(sizes > 0, pa.bool_())).flatten().dictionary_encode()
    return listed.dictionary.cast(pa.large_binary()).to_pylist(), listed.indices.to_numpy(), sizes


class WordTable:
    """Numbers and 64-bit hashes of the words met lately. Number 0 is no word, with hash 0."""

    def __init__(self, table: bytes, held: int = HELD):
        self.table, self.held = table, held
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hashes = np.zeros(1024, np.uint64)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the words of every text. A full table is emptied first, so numbers of an
        earlier call are then void."""
        if len(self.number) > self.held:
            self.clear()
        distinct, places, sizes = split_words([self.prepared(t.encode()) for t in texts])
        return np.split(self._numbers(distinct)[places], np.cumsum(sizes)[:-1]) if texts else []

    def prepared(self, text: bytes) -> bytes:
        """A text with its words as they count, white space between them."""
        return text.translate(self.table)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in words if w not in self.number]
        if new:
            first = len(self.number) + 1
            self.number.update(zip(new, range(first, first + len(new)), strict=True))
            while first + len(new) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[first:first + len(new)] = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
            self.added(first, len(new))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def added(self, first: int, n: int) -> None:
        """Called after words got the numbers ``first`` to ``first + n - 1``."""
