"""Language-model scoring with a log-frequency Bloom filter.

Bigram counts of the training texts are quantised to powers of two; an n-gram of level q is entered in a Bloom
filter with each of the numbers 1 to q, so probing upwards until a miss gives its count back to within a factor.
The same filter holds each history's retained mass, and P(w | h) = (c(h, w) + mu * P(w)) / (m(h) + mu), with the
exact add-one unigram P(w) below. The filter is cut into shards by the hash of the history, and each shard has
eight bits an entry or more, so it grows with the bigrams of the corpus and no count keeps one from entering unless
the caller asks for a least count. A shard is built and probed where its bigrams are added up; none is broadcast.

Texts are cut into chunks of some MB; each chunk sends its distinct words and bigrams with their training counts to
the buckets and shards of their hashes, which add them up and answer each chunk.

Tokens are lower-cased words (see textkernel) and one end of text each. Rows: null texts count as empty and have
the end alone; rows with a null id are training rows; repeated rows count each. Words are told apart by 64-bit
hashes. Other columns are not read. An empty table gives an empty result; with no training rows N and V are 0.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.llm import textkernel as tk
from lexarium.llm.batches import batch_rows
from lexarium.llm.textkernel import pack_keys, unpack_keys
from lexarium.session import cut, shared_dir
from lexarium.sources.files import remove

#: Bit probes of an entry.
PROBES = 5
#: A bit more than PROBES / ln 2: a shard is at most half full.
BITS_PER_ENTRY = 8
_LEAST_WIDTH = 17  # log2 of the bits of the smallest shard
_SHARDS = 11  # log2 of the shards, or more with many partitions
#: Text bytes of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20
MU = 4.0
_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1).astype(np.int64)


def totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end behind each text, and the place of each text's first token."""
    parts, at = [], [np.zeros(1, np.int64)]
    for a, b in tk.slices(offsets):
        words, first = tk.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        out = np.insert(words, first[1:], _END)
        parts.append(out)
        at.append(first[1:] + np.arange(1, b - a + 1) + at[-1][-1])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate(at)


def bigram_keys(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key for each token and the one before it; the high half tells the history."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[at[:-1]] = _BEGIN
    return history_keys(before) | (tk.mix(before * np.uint64(3) + words) & np.uint64(0xFFFFFFFF))


def history_keys(words: np.ndarray) -> np.ndarray:
    return tk.mix(words) & np.uint64(0xFFFFFFFF00000000)


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised log count: 1 for 1, 2 for 2 and 3, 3 for 4 to 7, ..."""
    return np.frexp(counts.astype(np.float64))[1]


def middle(levels: np.ndarray) -> np.ndarray:
    """The count a level stands for: 0, 1, 2.5, 5.5, 11.5, ... its range's middle."""
    return np.where(levels > 0, 1.5 * 2.0 ** (levels - 1) - 0.5, 0.0)


def _bits(keys: np.ndarray, number: int, probe: int, width: int) -> np.ndarray:
    """Bit places of entries (key, number) in a shard of 2**width bits."""
    salt = np.uint64((number * 0x9E3779B97F4A7C15 + probe * 0xC2B2AE3D27D4EB4F) % 2**64)
    return (tk.mix(keys + salt) >> np.uint64(64 - width)).astype(np.int64)


def build_shard(keys: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int]:
    """A shard with each key entered under the numbers 1 to its level, and log2 of its bits."""
    width = max(_LEAST_WIDTH, (BITS_PER_ENTRY * int(levels.sum()) - 1).bit_length())
    bits, mixed = np.zeros(1 << width, bool), tk.mix(keys ^ np.uint64(0x6A09E667F3BCC909))
    for number in range(1, int(levels.max(initial=0)) + 1):
        live = mixed[levels >= number]
        for probe in range(PROBES):
            bits[_bits(live, number, probe, width)] = True
    return bits, width


def probe_levels(bits: np.ndarray, width: int, keys: np.ndarray) -> np.ndarray:
    """Levels of keys by repeated membership probes of a shard."""
    out, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
    mixed = tk.mix(keys ^ np.uint64(0x6A09E667F3BCC909))
    number = 0
    while len(live):
        number += 1
        for probe in range(PROBES):
            live = live[bits[_bits(mixed[live], number, probe, width)]]
        out[live] = number
        if number > 60:
            break
    return out


def _chunks(batches, columns):
    """Slices of batches of at most CHUNK_BYTES of text."""
    for b in batches:
        data, offsets = tk.buffers(b.column("text"))
        for i, j in tk.slices(offsets, CHUNK_BYTES):
            yield [b.column(c).slice(i, j - i) for c in columns], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _count(buckets: int, shards: int):
    """A row with the texts of each chunk as places in its sorted words, rows of these words by bucket, and of its bigrams by shard."""

    def run(batches):
        for (ids, held), data, offsets in _chunks(batches, ("doc_id", "held_out")):
            name = uuid.uuid4().hex
            words, at = tokens(data, offsets)
            learn = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), np.diff(at))
            own, place = np.unique(words, return_inverse=True)
            count = np.bincount(place[learn], minlength=len(own))
            known = np.array([i.is_valid for i in ids], np.uint8)
            payload = struct.pack("<qq", len(ids), len(words)) + ids.fill_null(0).to_numpy().astype("<i8").tobytes() + known.tobytes() + held.to_numpy(zero_copy_only=False).astype(np.uint8).tobytes() + at.astype("<i8").tobytes() + np.ascontiguousarray(place.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            edges = np.searchsorted(own, (np.arange(1, buckets, dtype=np.float64) * 2.0**64 / buckets).astype(np.uint64))
            pairs, of_pair = np.unique(bigram_keys(words, at), return_inverse=True)
            found = np.bincount(of_pair[learn], minlength=len(pairs))
            cuts = np.searchsorted(pairs, np.arange(1, 1 << shards, dtype=np.uint64) << np.uint64(64 - shards))
            parts = [*zip(np.split(own, edges), np.split(count, edges), range(buckets), strict=True), *zip(np.split(pairs, cuts), np.split(found, cuts), range(buckets, buckets + (1 << shards)), strict=True)]
            parts = [p for p in parts if len(p[0])]
            rows = [(name, -1, zstandard.compress(payload, 1), None)] + [(name, b, pack_keys(k), pack_counts(c)) for k, c, b in parts]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "bucket", "body", "counts"])

    return run


def _by_first(batches, columns):
    """(key, rows) of batches sorted by the first of ``columns``."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def _entries(keys: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Filter entries of bigrams of at least that count, and of the mass of their histories."""
    k, c = keys[counts >= least], counts[counts >= least]
    history = k & np.uint64(0xFFFFFFFF00000000)
    own, mass = totals([history], [c])
    return np.concatenate([k, own]), np.concatenate([c, mass])


def shard_levels(keys: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """Levels of a shard's sorted bigrams and of their histories' masses, as its filter tells them: two rows of bytes."""
    entered, c = _entries(keys, counts, least)
    bits, width = build_shard(entered, level(c))
    history, of = np.unique(keys & np.uint64(0xFFFFFFFF00000000), return_inverse=True)
    return np.stack([probe_levels(bits, width, keys), probe_levels(bits, width, history)[of]]).astype(np.uint8)


def _answer(buckets: int, least: int):
    """Add up each bucket's words and each shard's bigrams and answer every chunk; with chunk null, a bucket's N and V."""

    def run(batches):
        for bucket, rows in _by_first(batches, ("bucket", "chunk", "body", "counts")):
            keys, counts = [unpack_keys(r[2]) for r in rows], [unpack_counts(r[3]) for r in rows]
            own, total = totals(keys, counts)
            places = (np.searchsorted(own, k) for k in keys)
            if bucket < buckets:
                stats = struct.pack("<qq", int(total.sum()), int((total > 0).sum()))
                out = [(None, bucket, stats)] + [(r[1], bucket, pack_counts(total[p])) for r, p in zip(rows, places, strict=True)]
            else:
                levels = shard_levels(own, total, least)
                out = [(r[1], bucket, zstandard.compress(levels[:, p].tobytes(), 1)) for r, p in zip(rows, places, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], ["chunk", "bucket", "body"])

    return run


def _score(n: int, v: int, buckets: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(batches):
        for _, rows in _by_first(batches, ("chunk", "bucket", "body")):
            raw = zstandard.decompress(rows[0][2])
            docs, size = struct.unpack_from("<qq", raw)
            ids, known, held = np.frombuffer(raw, "<i8", docs, 16), np.frombuffer(raw, np.uint8, docs, 16 + 8 * docs), np.frombuffer(raw, np.uint8, docs, 16 + 9 * docs)
            at = np.frombuffer(raw, "<i8", docs + 1, 16 + 10 * docs)
            place = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, 24 + 18 * docs).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)
            held_words = [r for r in rows[1:] if r[1] < buckets]  # each bucket's words, then its answer
            own = np.concatenate([unpack_keys(r[2]) for r in held_words[::2]])
            count = np.concatenate([unpack_counts(r[2]) for r in held_words[1::2]])
            levels = np.concatenate([np.frombuffer(zstandard.decompress(r[2]), np.uint8).reshape(2, -1) for r in rows[1:] if r[1] >= buckets], axis=1)
            base = (count + 1.0) / (n + v + 1.0)
            _, of_pair = np.unique(bigram_keys(own[place], at), return_inverse=True)
            pair, m = (middle(x.astype(np.int64))[of_pair] for x in levels)
            p = (np.minimum(pair, m) + MU * base[place]) / (m + MU)
            sums = [np.add.reduceat(x, at[:-1]) for x in (np.log10(base)[place], np.log10(p), (count > 0)[place].astype(np.int64))]
            out = [pa.array(ids, pa.int64(), mask=known == 0), pa.array(held.astype(bool)), np.diff(at), sums[2], np.full(docs, n), sums[0], sums[1]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) if isinstance(x, np.ndarray) else x for x, t in zip(out, types, strict=True)], names)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, least: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Bigrams found fewer than ``least`` times in the training texts are left out; 1 keeps all.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(docs[id_col].cast("string")) % folds == held_fold, F.lit(False))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), held.alias("held_out"))
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = max(_SHARDS, (8 * buckets - 1).bit_length())
    path, made = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}", "chunk string, bucket int, body binary, counts binary"
    rows.mapInArrow(_count(buckets, shards), made).withColumn("kept", F.col("bucket") < buckets).write.partitionBy("kept").parquet(path)
    chunks = spark.read.schema(f"{made}, kept boolean").parquet(path)
    with batch_rows(spark, 64):
        asked = chunks.where("bucket >= 0").drop("kept")
        answers = cut(asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(buckets, least), "chunk string, bucket int, body binary"))
        remove(spark, f"{path}/kept=false")  # bigrams that are answered; only the texts and their words are read again
        stats = [struct.unpack("<qq", r.body) for r in answers.where("chunk is null").select("body").collect()]  # a row a bucket
    n, v = sum(s[0] for s in stats), sum(s[1] for s in stats)
    with batch_rows(spark, 512):
        both = chunks.where("kept").select("chunk", "bucket", "body", F.lit(0).alias("side")).union(answers.where("chunk is not null").select("chunk", "bucket", "body", F.lit(1)))
        return cut(both.repartition("chunk").sortWithinPartitions("chunk", "bucket", "side").mapInArrow(_score(n, v, buckets), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
