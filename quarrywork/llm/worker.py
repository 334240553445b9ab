"""What Python workers do with threads and memory.

Tasks already use all cores, so numpy's matrix products get one thread.  Workers live on after a task,
so what they no longer need goes back to the system at its end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

from ..session import one_thread


def keep_memory() -> None:
    """Arrays of some MB that are made again and again take the same memory until the task ends, where the C library
    can; else each comes from the system anew, page by page."""
    tell = getattr(ctypes.CDLL(None), "mallopt", None)
    if tell is not None:
        tell(-3, 1 << 25), tell(-1, 1 << 27)  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD


def give_back() -> None:
    """Returns free memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for ``mapInArrow`` that gives memory back when its task ends."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
