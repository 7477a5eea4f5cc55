"""Texts handed to Arrow functions in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.functions.memory import release

PIECE_BYTES = 4 << 20


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held + size > most and row > first:
            yield first, row
            first, held = row, 0
        held += size
    if len(sizes) > first:
        yield first, len(sizes)


def settled(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, and memory given back after its end, when nothing of its own is held any longer."""
    def call(batches):
        yield from run(batches)
        release()

    return call


def map_texts(
    docs: DataFrame, make: Callable[[], Callable[[list], dict]], fields: list[T.StructField],
    *, id_col: str, text_col: str, most: int = PIECE_BYTES,
) -> DataFrame:
    """``doc_id`` and ``fields`` per row of ``docs``, worked out by ``make()(texts)``.

    ``make`` runs once per task; its result gets a list of texts (null as empty) and returns
    a value list per field. Ids of any type, null or repeated, come back as they are.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *fields])

    def run(batches):
        work, arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in pieces(texts, most):
                made = work(texts.slice(a, b - a).to_pylist())
                columns = [ids.slice(a, b - a).cast(arrow.field(0).type)]
                columns += [pa.array(made[f.name], type=arrow.field(f.name).type) for f in fields]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(settled(run), schema)


def filter_texts(
    docs: DataFrame, make: Callable[[], Callable[[list], list]], *, text_col: str, most: int = PIECE_BYTES,
) -> DataFrame:
    """The rows of ``docs``, with all columns, for which ``make()(texts)`` is true."""
    schema, place = docs.schema, docs.columns.index(text_col)

    def run(batches):
        work, arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            for a, b in pieces(batch.column(place), most):
                part = batch.slice(a, b - a)
                keep = work([t or "" for t in part.column(place).to_pylist()])
                held = part.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(held.columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(settled(run), schema)


def crc32_remainder(key, parts: int):
    """crc32 of an id column as text, modulo ``parts``; a null id counts as empty text."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "utf-8")) % parts


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1`` of every i, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) if total else np.empty(0, np.int64)
    return shift + np.arange(total)
