"""Token-ID output: shards of independent zstandard frames with a trailing seek table.

A shard is a sequence of frames, each one zstandard frame with the ids of whole documents, then a zstandard
skippable frame that holds the seek table: per frame its place, sizes, document-id range and the CRC-32 of its
compressed bytes. A reader reads the table, then only the frames whose documents it wants; plain ``zstd -d``
can also decompress a shard.

Rows: null texts count as empty, each document gets the end id, so an empty one holds it alone. Null ids come
first. Rows with equal ids are all kept, ordered by text. An empty table gives no shards and no rows. Columns
besides the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lexarium.llm.tokenizing import encoder, id_bytes
from lexarium.session import cut, shared_dir

MAGIC = 0x184D2A5D  # of a skippable frame
_HEAD, _ENTRY, _TAIL = struct.Struct("<II"), struct.Struct("<QIIQqqII"), struct.Struct("<IBQ4s")
#: Raw bytes of ids after which a frame ends; a longer document fills a frame alone.
FRAME_BYTES = 1 << 18


@dataclass(frozen=True)
class Frame:
    start: int
    size: int
    raw: int
    tokens_before: int
    first_id: int
    last_id: int
    documents: int
    crc32: int


class ShardWriter:
    """Writes documents in the order given; ``width`` is 2 or 4 bytes an id."""

    def __init__(self, out, width: int = 4, frame_bytes: int = FRAME_BYTES, level: int = 1):
        self.out, self.width, self.most = out, width, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[Frame] = []
        self.at = self.tokens = self.raw = self.documents = 0
        self.begin = 0
        self.held: list[tuple[int | None, np.ndarray]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append((doc_id, ids))
        self.raw += len(ids) * self.width
        self.tokens += len(ids)
        self.documents += 1
        if self.raw >= self.most:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        keys = np.array([0 if i is None else i for i, _ in self.held], "<i8")
        known = np.array([i is not None for i, _ in self.held], "u1")
        lengths = np.array([len(x) for _, x in self.held], "<u4")
        body = np.concatenate([x for _, x in self.held])
        if len(body) and int(body.max()) >> 8 * self.width:
            raise ValueError(f"an id does not fit in {self.width} bytes")
        body = body.astype(f"<u{self.width}")
        raw = struct.pack("<I", len(keys)) + keys.tobytes() + known.tobytes() + lengths.tobytes() + body.tobytes()
        data = self.zip.compress(raw)
        ids = keys[known == 1]
        self.frames.append(Frame(self.at, len(data), len(raw), self.begin, int(ids.min()) if len(ids) else -(2**63), int(ids.max()) if len(ids) else -(2**63), len(keys), zlib.crc32(data)))
        self.out.write(data)
        self.at += len(data)
        self.begin, self.raw, self.held = self.tokens, 0, []

    def close(self) -> None:
        self.flush()
        table = b"".join(_ENTRY.pack(f.start, f.size, f.raw, f.tokens_before, f.first_id, f.last_id, f.documents, f.crc32) for f in self.frames)
        tail = _TAIL.pack(len(self.frames), self.width, self.tokens, b"LXTK")
        self.out.write(_HEAD.pack(MAGIC, len(table) + len(tail)) + table + tail)
        self.at += _HEAD.size + len(table) + len(tail)


class ShardReader:
    """Random access to the documents of a shard; ``source`` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        source.seek(size - _TAIL.size)
        count, self.width, self.tokens, magic = _TAIL.unpack(source.read(_TAIL.size))
        if magic != b"LXTK":
            raise ValueError("not a token shard")
        source.seek(size - _TAIL.size - count * _ENTRY.size)
        table = source.read(count * _ENTRY.size)
        self.frames = [Frame(*_ENTRY.unpack_from(table, i * _ENTRY.size)) for i in range(count)]

    def frame(self, f: Frame) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, tokens of the shard before it, ids) of a frame's documents."""
        self.source.seek(f.start)
        data = self.source.read(f.size)
        if zlib.crc32(data) != f.crc32:
            raise ValueError(f"the frame at byte {f.start} is damaged")
        raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=f.raw)
        n = struct.unpack_from("<I", raw)[0]
        keys, known = np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, "u1", n, 4 + 8 * n)
        lengths = np.frombuffer(raw, "<u4", n, 4 + 9 * n).astype(np.int64)
        ends = np.cumsum(lengths)
        body = np.frombuffer(raw, f"<u{self.width}", int(ends[-1]) if n else 0, 4 + 13 * n)
        for i in range(n):
            yield int(keys[i]) if known[i] else None, f.tokens_before + int(ends[i] - lengths[i]), body[ends[i] - lengths[i] : ends[i]]

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """All documents, or those wanted; frames without any are neither read nor decompressed."""
        ids = None if wanted is None else np.unique(np.fromiter(wanted, np.int64))
        for f in self.frames:
            if ids is not None and np.searchsorted(ids, f.first_id) == np.searchsorted(ids, f.last_id, "right"):
                continue
            for row in self.frame(f):
                if ids is None or row[0] is not None and ids[min(np.searchsorted(ids, row[0]), len(ids) - 1)] == row[0]:
                    yield row


def _open(uri: str, mode: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if mode == "w" else store.open_input_file(path)


def write_shards(docs: DataFrame, path: str, tokenizer: str, chunks: str = "", end_id: int = 0, width: int = 4, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all rows in ascending id order under ``path``; returns the manifest.

    Manifest: shard int (in id order), uri, documents, tokens, tokens_before. Each task attempt writes a file of
    its own name, and the manifest, cut from its lineage, names those that count, so lost executors and repeated
    tasks do no harm.
    """
    spark = docs.sparkSession
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place, recursive=True)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        context = TaskContext.get()
        out = writer = None
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), encoder(tokenizer, chunks).encode_many(b.column(1).to_pylist()), strict=True):
                if writer is None:
                    uri = f"{path}/{context.partitionId():06d}-{context.taskAttemptId()}.tok"
                    out = _open(uri, "w")
                    writer = ShardWriter(out, width)
                writer.add(doc_id, np.frombuffer(raw + end, "<u4"))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": context.partitionId(), "uri": uri, "documents": writer.documents, "tokens": writer.tokens}], schema=pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    written = cut(rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, "shard int, uri string, documents long, tokens long"))
    found, before = [], 0
    for r in sorted(written.collect()):  # one row a shard
        found.append((*r, before))
        before += r.tokens
    return spark.createDataFrame(found, "shard int, uri string, documents long, tokens long, tokens_before long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """All documents of a manifest's shards: doc_id, start (ids before it), n_tokens, ids (array<int>)."""
    return _read(manifest, True)


def _read(manifest: DataFrame, full: bool) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())) if full else ("ids_crc32", pa.int64())])

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                held, size = [], 0
                with _open(row["uri"], "r") as source:
                    for doc_id, at, ids in ShardReader(source).documents():
                        last = ids.astype("<i4") if full else zlib.crc32(ids.astype("<u4").tobytes())
                        held.append((doc_id, row["tokens_before"] + at, len(ids), last))
                        size += len(ids) if full else 1
                        if size >= 1_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(parts, "shard").mapInArrow(read, f"doc_id long, start long, n_tokens long, {'ids array<int>' if full else 'ids_crc32 long'}")


def token_digests(docs: DataFrame, tokenizer: str, chunks: str, path: str | None = None) -> DataFrame:
    """Write all rows to shards in the shared folder and read each document's digest back from the files."""
    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return _read(write_shards(docs, path, tokenizer, chunks, width=id_bytes(tokenizer)), False)


def open_manifest(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A manifest kept elsewhere, as a table again."""
    return spark.createDataFrame(rows, "shard int, uri string, documents long, tokens long, tokens_before long")
