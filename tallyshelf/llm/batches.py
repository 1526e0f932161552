"""Arrow batches in slices, so that a worker holds few texts as Python objects, and
names for helper columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a slice.
ROWS = 256


def _trim() -> None:
    """Give freed memory of this worker back to the system, where its C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, at most ROWS at a time, in order.  Memory that the
    last batch took is given back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
    pa.default_memory_pool().release_unused()
    _trim()


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """As ``slices``, but of at most ``most`` bytes of a text column, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), side="right")))
            yield batch.slice(at, stop - at)
            at = stop
    pa.default_memory_pool().release_unused()
    _trim()


def unused(taken: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as set it apart from the
    columns ``taken`` (Spark's names ignore case)."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name)
        out.append(name)
    return out
