"""Arrow batches in tasks: small pieces, and memory given back."""

from __future__ import annotations

import ctypes
import gc
from typing import Callable, Iterator

import pyarrow as pa

#: Rows of a batch that are worked on at once.
ROWS = 128


def in_pieces(run: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` (batch to batch) for ``mapInArrow``, on ``rows`` rows at a time.

    Python objects exist for one piece only, and what is freed goes back to the system after each batch: a worker process
    serves many tasks, and its allocators keep freed memory otherwise.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield run(batch.slice(at, rows))
            del batch
            give_back()

    return pieces


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
