"""Vectorised byte kernels over Arrow string columns: words, word hashes, shingles.

A word is ``[^\\x20\\x09-\\x0D]+`` on UTF-8 bytes; A-Z count as a-z where lower-casing is asked for.
Hashes are 64-bit polynomials over random byte values, finalised by a multiply-xor mix. They stand for the
words themselves: two different words of one comparison collide with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

_rng = np.random.default_rng(20240229)
EXACT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = EXACT.copy()
LOWER[65:91] = EXACT[97:123]
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}
#: Bytes of text worked on at once; a longer single text makes a slice of its own.
SLICE_BYTES = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_powers.get("up", ())) < n:
        size = max(SLICE_BYTES + 1, 1 << (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without a copy; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], for any ranges."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the place of each text's first word (one more than texts)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SEPARATOR[data]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    if len(data):
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[1:-1][cuts]
        last[cuts - 1] = inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word and the place of each text's first word."""
    starts, ends, at = word_spans(data, offsets)
    return range_hash(prefix_hash(data, table), starts, ends), at


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles; a text of fewer words has its whole sequence as one.

    Returns the hashes of all texts and the place of each text's first.
    """
    n, lengths = len(words), np.diff(at)
    counts = np.where(lengths == 0, 0, np.maximum(lengths - k + 1, 1))
    out_at = np.concatenate([[0], np.cumsum(counts)])
    total = np.zeros(n, np.uint64)
    factor = 1
    for j in range(min(k, n)):
        total[: n - j] += words[j:] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % 2**64
    place = np.arange(out_at[-1]) - np.repeat(out_at[:-1] - at[:-1], counts)
    out = mix(total[place])
    for i in np.flatnonzero((lengths > 0) & (lengths < k)):
        value, factor = int(lengths[i]) * 0x2545F4914F6CDD1D, 1
        for w in words[at[i] : at[i + 1]].tolist():
            value += w * factor
            factor = factor * 0xD6E8FEB86659FD93 % 2**64
        out[out_at[i]] = mix(np.array([value % 2**64], np.uint64))[0]
    return out, out_at


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, as differences by byte plane."""
    d = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)
