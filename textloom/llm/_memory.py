"""Memory of Python workers, which Spark uses again for later stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_MMAP_THRESHOLD, _TRIM_THRESHOLD = -3, -1  # numbers of mallopt
_set: list[bool] = []


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives freed memory back to the system: large arrays at once, the rest when its task ends."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None)
        if not _set and hasattr(libc, "mallopt"):  # glibc; otherwise thresholds rise with the largest array ever freed
            libc.mallopt(_MMAP_THRESHOLD, 4 << 20)
            libc.mallopt(_TRIM_THRESHOLD, 16 << 20)
            _set.append(True)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return bounded
