"""Memory of Python workers: size of Arrow batches, and giving freed memory back."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHIFT = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """At most ``rows`` rows and about ``size`` bytes a batch, so that batches of long texts stay small in a Python
    worker. A lazy plan reads both settings when it runs, so they stay as they are put here; a smaller one is kept."""
    for key, most in ((_ROWS, rows), (_BYTES, size)):
        number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)[a-z]*", spark.conf.get(key).strip().lower()).groups()
        now = int(number) << _SHIFT[unit]
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def bounded(batches: Iterator[pa.RecordBatch], text: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of all batches whose strings in column ``text`` have ``size`` bytes at most, or one row."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def give_back() -> None:
    """At the end of a task: return freed memory to the system. Spark keeps Python workers for later tasks, and what
    their allocators hold on to would count against the executor meanwhile."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to do
        pass
