"""Arrow batches in slices, so that a worker's memory follows the slice and not the batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, size: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``size`` bytes each, without copying; a larger row is alone."""
    n = batch.num_rows
    step = n
    while step > 1 and n and batch.nbytes * step / n > size:
        step = (step + 1) // 2
    if step >= n:
        if n:
            yield batch
        return
    for at in range(0, n, step):
        part = batch.slice(at, step)
        if part.num_rows > 1 and part.nbytes > 2 * size:
            yield from slices(part, size)
        else:
            yield part


def in_slices(make: Callable[[pa.RecordBatch], pa.RecordBatch], size: int = _SLICE_BYTES) -> Callable:
    """A mapInArrow function that applies ``make`` to slices of its batches and at its end returns freed memory.

    Workers are used again by later stages, so what one has freed must not stay with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size):
                yield make(part)
        release()

    return run


def release() -> None:
    """Hand freed memory back to the system, where it has a way to."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        return
