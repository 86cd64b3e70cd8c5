"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_memo(name: str, make: Callable[[], Any]) -> Any:
    """A value that a Python worker keeps from one task to the next.

    Functions reach workers by value, so their module globals are new in each
    task; a module object in ``sys.modules`` is not. ``make`` builds the value
    when the worker has none.
    """
    store = sys.modules.setdefault("_wiresift_llm_memo", types.ModuleType("_wiresift_llm_memo"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives freed memory back to the machine.

    Workers outlive their tasks; what an idle one keeps for later, the rest of its
    executor must do without.
    """
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
        if trim is not None:
            trim(0)

    return runs


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def long_id(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("long")


#: Rows up to which a stored side of a join is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 250_000


def small(rows: DataFrame) -> DataFrame:
    """``rows``, which are stored and narrow, with a broadcast hint if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
