"""Python workers outlive their tasks; what a task has freed goes back to the system at its end."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def releasing(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``fn`` over a partition's batches, with the memory it has freed released at the end."""

    @functools.wraps(fn)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            release()

    return run
