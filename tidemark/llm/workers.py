"""What Arrow workers do about memory.

Spark keeps a worker for later tasks, and what an idle one holds counts for its
executor while other stages run, so tasks give freed memory back when they end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

from tidemark.llm import textvec

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system, where the allocator has a call for it."""
    textvec.shorten_tables()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, after which the worker gives back what its task no longer uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run
