"""Arrow batch sizes of steps whose rows are large."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import SparkSession

_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, Python workers get at most so many rows at once. Only for steps that run inside, such as a cut."""
    before = spark.conf.get(_KEY, None)
    spark.conf.set(_KEY, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_KEY)
        else:
            spark.conf.set(_KEY, before)


def trimmed(run):
    """The same step, but its worker gives freed memory back to the system when a task ends.

    Workers stay for later tasks and stages; without this, each holds what its largest task once took.
    """

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            with suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return inner
