"""Range partitioning by sampled splitters over several 64-bit keys, and multikey sorting of what a bucket holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.llm.batches import trimmed
from lexarium.session import cut

#: Sampled keys for each bucket, and one text in how many gives samples.
PER_BUCKET, ONE_IN = 40, 32
#: Rows of a bucket, about: with more, there are more buckets than shuffle partitions.
BUCKET_ROWS = 1_000_000


def share(df: DataFrame) -> DataFrame:
    """One row in ONE_IN, drawn row by row, so that copies are drawn as often as they are there."""
    return df.where(F.rand(7) < 1 / ONE_IN)


def multikey(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of rows by several tokens, and how many leading tokens each shares with the row before it.

    Multikey quicksort over arrays: sort by one token, then order only the groups of ties by the next.
    """
    n = len(keys[0])
    order, shared = np.argsort(keys[0], kind="stable"), np.zeros(n, np.int64)
    if n < 2:
        return order, shared
    at, group = np.arange(n), np.zeros(n, np.int64)
    for depth, key in enumerate(keys):
        if depth:
            order[at] = order[at[np.lexsort((key[order[at]], group))]]
        k = key[order[at]]
        same = (k[1:] == k[:-1]) & (group[1:] == group[:-1])
        shared[at[1:][same]] = depth + 1
        tied = np.r_[same, False] | np.r_[False, same]
        at, group = at[tied], np.cumsum(np.r_[0, ~same])[tied]
        if not len(at):
            break
    return order, shared


def bucket_of(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """How many splitters, sorted by all tokens, come before each row."""
    low = np.searchsorted(splitters[0], keys[0], "left")
    if len(keys) > 1 and len(low):
        high = np.searchsorted(splitters[0], keys[0], "right")
        tied = np.flatnonzero(high > low)
        start = low[tied]
        for a in np.unique(start):
            which = tied[start == a]
            z = int(high[which[0]])
            low[which] = a + bucket_of([k[which] for k in keys[1:]], [s[a:z] for s in splitters[1:]])
    return low


def dealt(source: DataFrame, sample: DataFrame, make, kinds: str, keys: list[str], work, schema: str) -> DataFrame:
    """``work`` on each bucket of the rows (of ``kinds``) that ``make`` gives from batches of ``source``; cut.

    Splitters are sampled from what ``make`` gives from ``sample``, one part in ONE_IN of the source, about; the driver
    gets PER_BUCKET keys a bucket of it. One worker a task makes rows and finds their buckets.
    """
    spark = source.sparkSession
    sample = cut(sample.mapInArrow(trimmed(make), kinds).select(*keys))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sample.count() * ONE_IN // BUCKET_ROWS))
    drawn = np.array([tuple(r) for r in sample.orderBy(F.xxhash64(*keys)).limit(PER_BUCKET * parts).collect()], np.int64).reshape(-1, len(keys))
    drawn = drawn[np.lexsort(drawn.T[::-1])]
    splitters = spark.sparkContext.broadcast(drawn[np.unique(np.linspace(0, len(drawn), parts + 1)[1:-1].astype(np.int64))] if len(drawn) else drawn)

    def deal(batches):
        split = list(splitters.value.T)
        for b in make(batches):
            own = bucket_of([b.column(k).to_numpy() for k in keys], split)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], [*b.schema.names, "bucket"])

    def each(batches):
        held, bucket = [], None
        for b in batches:
            own = b.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z > a:
                    if held and own[a] != bucket:
                        yield from work(pa.Table.from_batches(held), bucket)
                        held = []
                    bucket = int(own[a])
                    held.append(b.slice(a, z - a))
        if held:
            yield from work(pa.Table.from_batches(held), bucket)

    return cut(source.mapInArrow(trimmed(deal), f"{kinds}, bucket int").repartitionById(parts, "bucket").mapInArrow(trimmed(each), schema))


def whole(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def sliced(columns: list, names: list[str], most: int = 100_000):
    for i in range(0, len(columns[0]), most):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + most]) for c in columns], names)
