"""Bounds on what Python workers hold at once: bytes of an Arrow batch, and of the piece of it that lies there as Python objects."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, SparkSession

#: Bytes of rows that go to a Python worker at once; rows may hold long texts or large blobs.
BATCH_BYTES = 8 << 20
#: Bytes of rows that are Python objects at once; a single longer row is a piece of its own.
PIECE_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session are bounded by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def bounded(run: Callable[..., Column], *columns: Column) -> Column:
    """An Arrow function of columns, with the batches of the session at work bounded."""
    if spark := SparkSession.getActiveSession():
        bound_batches(spark)
    return run(*columns)


def pieces(arrays: Sequence[pa.Array], limit: int = PIECE_BYTES) -> Iterator[list[pa.Array]]:
    """Slices of arrays of one length, in order, with at most `limit` bytes each, or with one row; of empty arrays one empty slice."""
    todo = [list(arrays)]
    while todo:
        some = todo.pop()
        n = len(some[0])
        if n < 2 or sum(a.nbytes for a in some) <= limit:
            yield some
        else:
            todo += [[a.slice(n // 2) for a in some], [a.slice(0, n // 2) for a in some]]


def by_pieces(f: Callable[..., list[Any]], kind: pa.DataType, *arrays: pa.Array) -> pa.Array:
    """What f makes of lists of the arrays' values, which it gets piece by piece."""
    done = [pa.array(f(*(a.to_pylist() for a in some)), kind) for some in pieces(arrays)]
    return done[0] if len(done) == 1 else pa.concat_arrays(done)


def give_back() -> None:
    """Returns memory that this worker has freed to the system; workers idle between tasks, also those of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not that C library
        pass
