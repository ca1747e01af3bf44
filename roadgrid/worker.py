"""What a Python worker keeps from task to task, and what it gives back."""

from __future__ import annotations

import sys
import types

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def kept(name: str) -> dict:
    """A dict that lives as long as the worker.

    Modules that travel with their functions are new in each task, so their
    globals don't last.
    """
    return sys.modules.setdefault("_roadgrid_worker", types.ModuleType("_roadgrid_worker")).__dict__.setdefault(name, {})


def give_back() -> None:
    """Returns what earlier tasks have left, and the memory that Arrow and the C library hold free, to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()  # functions of finished tasks and what they hold lie in cycles
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


_set: set = {"10000"}  # Spark's own number of rows, and those set here


def batches_of(spark, rows: int) -> None:
    """Arrow batches of what this session runs from now on have so many rows at most: rows can be large, and both sides hold a batch several times.

    A session for which someone else has set a number keeps it.
    """
    if spark.conf.get(BATCH_ROWS) in _set:
        _set.add(str(rows))
        spark.conf.set(BATCH_ROWS, str(rows))


def tidy(step):
    """step, a function over a task's batches; after its last the worker gives memory back instead of idling with it."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            give_back()

    return run
