"""Memory of Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Give back what Arrow and the C library hold for later; a worker may stay idle while others
    need the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def settled(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, and memory given back after its end, when nothing of its own is held any longer."""
    def call(batches):
        yield from run(batches)
        release()

    return call
