"""Arrow batches in Python workers, in pieces of bounded size.

Spark cuts its batches at 10,000 rows or 64 MiB, unless set otherwise.  A worker that makes objects of all rows of one, and holds what it
makes of them, takes many times that; one that goes through it in pieces holds the batch in Arrow and one piece in objects.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa

#: Rows of a piece, and bytes of its input.
ROWS, BYTES = 256, 1 << 20


def cut(batch: pa.Array, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.Array]:
    """All of ``batch`` in order, in parts of at most ``rows`` rows and ``size`` bytes; a larger row stands alone."""
    for lo in range(0, len(batch), rows):
        todo = [batch.slice(lo, rows)]
        while todo:
            part = todo.pop()
            if len(part) > 1 and part.nbytes > size:
                half = len(part) // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def pieces(batches: Iterator[pa.StructArray], rows: int = ROWS, size: int = BYTES) -> Iterator[pd.DataFrame]:
    """The rows of struct batches as frames with a column a field, cut as by :func:`cut`."""
    for batch in batches:
        for part in cut(batch, rows, size):
            yield pd.DataFrame({f.name: _series(c) for f, c in zip(part.type, part.flatten())})
        part = batch = None  # noqa: PLW2901  (the next batch comes only then)
        give_back()


def _series(column: pa.Array) -> pd.Series:
    """As a pandas UDF gets it: maps as dictionaries, local times without a zone."""
    out = column.to_pandas(date_as_object=True, coerce_temporal_nanoseconds=True, maps_as_pydicts="strict")
    return out.dt.tz_localize(None) if isinstance(out.dtype, pd.DatetimeTZDtype) else out


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and an executor has one or more a core."""
    pa.default_memory_pool().release_unused()
    if (trim := _allocator()) is not None:
        trim(0)


@lru_cache(maxsize=1)
def _allocator():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
