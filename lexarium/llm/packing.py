"""Best-fit packing of token pieces into sequences of a fixed capacity.

Large-item matching: pieces above a third of the capacity fit at most twice into a sequence, so they are paired
by greedy matching, each largest with the largest that still fits beside it; smaller pieces then go, longest
first, into the tightest remaining gap. All decisions are made on the histogram of lengths, which has at most
``capacity`` entries whatever the input, and come out as a plan table that every piece looks its place up in.

Rows: null texts count as empty and hold the end id alone. Repeated ids are packed each on its own. An empty
table gives no rows. Ties (equal lengths) go by partition and row order. Other columns are not read.

``pack_mixed`` packs in the order of a mixture of sources: every window of consecutive slots is packed on its own, and
sequences are numbered by window and, in a window, by the first document that they hold.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexarium.llm import mixing
from lexarium.llm.batches import trimmed
from lexarium.llm.tokenizing import encoder
from lexarium.session import cut

#: Slots of the mixture that are packed together.
WINDOW = 16
_PIECES = "row_key string, doc_id long, piece int, start long, length long, ids_crc32 long, pid int, place long"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit plan rows (length, first rank, end rank, first sequence, per sequence, offset).

    The pieces of a length with ranks from first to end lie ``per sequence`` to a sequence from its number
    ``first sequence`` on, one behind the other from ``offset``.
    """
    left = {n: c for n, c in histogram.items() if c}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a piece is empty or longer than the capacity")
    groups: list[list] = [[] for _ in range(capacity + 1)]  # by gap: [copies, contents]
    large = [n for n in range(capacity, capacity // 3, -1) if n in left and 3 * n > capacity]
    for n in large:
        while left[n]:
            mate = next((m for m in range(min(n, capacity - n), capacity // 3, -1) if 3 * m > capacity and left.get(m, 0) > (m == n)), None)
            if mate is None:
                groups[capacity - n].append([left[n], [(n, 1)]])
                left[n] = 0
            elif mate == n:
                groups[capacity - 2 * n].append([left[n] // 2, [(n, 2)]])
                left[n] %= 2
            else:
                both = min(left[n], left[mate])
                groups[capacity - n - mate].append([both, [(n, 1), (mate, 1)]])
                left[n] -= both
                left[mate] -= both
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count, gap = left[n], n
        while count:
            while gap <= capacity and not groups[gap]:
                gap += 1
            if gap > capacity:
                per = capacity // n
                groups[capacity].append([-(-count // per), []])
                gap = capacity
            copies, held = groups[gap].pop()
            per = gap // n
            used = min(copies, count // per)
            if used:
                groups[gap - per * n].append([used, [*held, (n, per)]])
                count -= used * per
                copies -= used
            if copies and count and count < per:
                groups[gap - count * n].append([1, [*held, (n, count)]])
                count, copies = 0, copies - 1
            if copies and (held or count):
                groups[gap].append([copies, held])
    rows, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for copies, held in (x for gap in groups for x in gap):
        offset = 0
        for n, per in held:
            rows.append((n, ranks[n], ranks[n] + copies * per, sequence, per, offset))
            ranks[n] += copies * per
            offset += n * per
        sequence += copies if held else 0
    return sorted(rows)


def pieces(docs: DataFrame, tokenizer: str, chunks: str = "", capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache: int = 1_200_000, keep: bool = True) -> DataFrame:
    """Encode whole texts, add the end id, and cut those above the capacity; one row a piece.

    Workers cache the ids of ``cache`` chunks (about 200 bytes each) and keep them between tasks unless told not to.
    """

    def cut_up(batches):
        seen, pid = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for key, doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoder(tokenizer, chunks, cache).encode_many(b.column(2).to_pylist()), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    n = len(part) // 4
                    for column, value in zip(out, (key, doc_id, k, at // 4, n, zlib.crc32(part), pid, int(seen[n])), strict=True):
                        column.append(value)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["row_key", "doc_id", "piece", "start", "length", "ids_crc32", "pid", "place"])

    rows = docs.select(docs[id_col].cast("string").alias("row_key"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    def lean(batches):
        yield from cut_up(batches)
        if not keep:
            encoder(tokenizer, chunks, cache).known.clear()

    return rows.mapInArrow(trimmed(lean), _PIECES)


def pack(rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to rows with length, pid and place (rank among a partition's equal lengths).

    ``rows`` must be cut from its lineage, so that pid and place stay as they are.
    """
    counts = rows.groupBy("length", "pid").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "pid", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table = np.array(plan(histogram, capacity), np.int64).reshape(-1, 6)
    held = rows.sparkSession.sparkContext.broadcast(table)
    ranked = rows.join(counts, ["length", "pid"])

    def place(batches):
        t = held.value
        keys = (t[:, 0] << 48) | t[:, 1]
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("place").to_numpy() + b.column("before").to_numpy()
            row = t[np.searchsorted(keys, (n << 48) | rank, "right") - 1]
            k = rank - row[:, 1]
            where = row[:, 3] + k // row[:, 4]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row_key", "doc_id", "piece", "start", "length", "ids_crc32")), pa.array(where), pa.array(row[:, 5] + k % row[:, 4] * n)], ["row_key", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "row_key string, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").drop("row_key")


def pack_documents(docs: DataFrame, tokenizer: str, chunks: str = "", capacity: int = 2048, end_id: int = 0, **cache) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(cut(pieces(docs, tokenizer, chunks, capacity, end_id, **cache)), capacity)


def _pack_window(rows: list[tuple], capacity: int) -> list[np.ndarray]:
    """doc_id, piece, start, length, ids_crc32, sequence and offset of a window's (doc_id, length, crcs) in their order."""
    count = np.array([len(r[2]) for r in rows])
    doc, total = np.repeat(np.arange(len(rows)), count), np.array([r[1] for r in rows])
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = piece * capacity
    n = np.minimum(capacity, total[doc] - start)
    order = np.argsort(n, kind="stable")
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n)) - np.searchsorted(n[order], n[order])
    t = np.array(plan(Counter(n.tolist()), capacity), np.int64)
    row = t[np.searchsorted((t[:, 0] << 48) | t[:, 1], (n << 48) | rank, "right") - 1]
    k = rank - row[:, 1]
    _, first, sequence = np.unique(row[:, 3] + k // row[:, 4], return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    return [doc, piece, start, n, np.concatenate([r[2] for r in rows]), number[sequence], row[:, 5] + k % row[:, 4] * n]


def pack_mixed(docs: DataFrame, weights: dict[str, float], tokenizer: str, chunks: str = "", capacity: int = 2048, end_id: int = 0, cache: int = 1_200_000, keep: bool = True, window: int = WINDOW) -> DataFrame:
    """Rows as of ``pack_documents``, in sequences that follow the mixture of ``mixing.mixed``."""
    spark = docs.sparkSession

    def encode(batches):
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids = [raw + end for raw in encoder(tokenizer, chunks, cache).encode_many(b.column("body").to_pylist())]
            crcs = [[zlib.crc32(raw[at : at + 4 * capacity]) for at in range(0, len(raw), 4 * capacity)] for raw in ids]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "text")), pa.array([len(raw) // 4 for raw in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "source", "text", "length", "crcs"])
        if not keep:
            encoder(tokenizer, chunks, cache).known.clear()

    def place(batches):
        def packed(key, rows):
            doc, piece, *rest = _pack_window(rows, capacity)
            ids = pa.array([r[0] for r in rows], pa.int64()).take(pa.array(doc))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), key)), ids, pa.array(piece.astype(np.int32)), *map(pa.array, rest)], ["window", "doc_id", "piece", "start", "length", "ids_crc32", "sequence", "offset"])

        key, rows = None, []
        for b in batches:
            for w, *r in zip(*(b.column(c).to_pylist() for c in ("window", "doc_id", "length", "crcs")), strict=True):
                if rows and w != key:
                    yield packed(key, rows)
                    rows = []
                key = w
                rows.append(r)
        if rows:
            yield packed(key, rows)

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"), F.xxhash64(docs["text"]).cast("string").alias("text"), docs["text"].alias("body"))
    encoded = cut(slim.mapInArrow(trimmed(encode), "doc_id long, source string, text string, length long, crcs array<long>"))
    slots = mixing.mix(encoded, weights).select(F.expr(f"_slot div {window}").alias("window"), "_slot", "_rank", "doc_id", "length", "crcs")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = cut(slots.repartition(parts, "window").sortWithinPartitions("window", "_slot", "_rank").mapInArrow(place, "window long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence long, offset long"))
    sizes = sorted((r[0], r[1] + 1) for r in own.groupBy("window").agg(F.max("sequence")).collect())  # a row a window
    windows = np.array([w for w, _ in sizes], np.int64)
    held = spark.sparkContext.broadcast((windows, np.cumsum([0, *(n for _, n in sizes)])))

    def number(batches):
        windows, first = held.value
        for b in batches:
            where = first[np.searchsorted(windows, b.column("window").to_numpy())] + b.column("sequence").to_numpy()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(where), b.column("offset")], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return own.mapInArrow(number, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
