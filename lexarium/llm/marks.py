"""A bitmap of fixed size that tells most rows a join will not need before they are shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame

from lexarium.llm import textkernel as tk

#: 4 MB, whatever the input; where it fills up, more rows pass to the join, which decides alone.
MARK_BITS = 25
_BLOCK_BYTES = 1 << 14


def places(keys: np.ndarray) -> np.ndarray:
    return (tk.mix(keys.astype(np.uint64)) >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _mark(batches):
    bits = np.zeros(1 << MARK_BITS, bool)
    for b in batches:
        bits[places(b.column(0).to_numpy())] = True
    full = np.packbits(bits).reshape(-1, _BLOCK_BYTES)
    at = [i for i in range(len(full)) if full[i].any()]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([zstandard.compress(full[i].tobytes(), 1) for i in at], pa.binary())], ["block", "bits"])


def _join(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zstandard.decompress(raw, max_output_size=_BLOCK_BYTES), np.uint8)
            total[block] = total.get(block, np.uint8(0)) | x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "bits"])


def marked(keys: DataFrame) -> Broadcast:
    """The bitmap of the only column of ``keys`` (long, no nulls), joined on executors and broadcast."""
    bits = np.zeros((1 << MARK_BITS) // 8, np.uint8).reshape(-1, _BLOCK_BYTES)
    for block, raw in keys.mapInArrow(_mark, "block int, bits binary").repartition("block").mapInArrow(_join, "block int, bits binary").collect():
        bits[block] = np.frombuffer(raw, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def has(marks: Broadcast, keys: np.ndarray) -> pa.Array:
    """Which keys may be marked."""
    at = places(keys)
    return pa.array((marks.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1, pa.bool_())
