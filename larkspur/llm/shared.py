"""Tables in the shared folder, under the name that the operators here use, and bounds for Python workers."""

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from ..sources.shared import dropped, shared_folder, written

__all__ = ["bounded_batches", "dropped", "shared_folder", "tidy", "written"]

#: Arrow batches to and from Python workers, in bytes; a longer text makes a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of this session small: numpy works on chunks of a MB anyway, and the JVM keeps buffers of their size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving free memory back to the system when it ends: Python workers stay for later tasks, with what they once held."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return whole


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
