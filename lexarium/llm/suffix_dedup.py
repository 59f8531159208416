"""Suffix-array deduplication: remove every byte covered by a string of at least ``length`` bytes that starts twice.

Sorting every suffix of a corpus would move hundreds of bytes for each byte of text. Two equal strings of
``length`` bytes hold the same smallest-hashed gram at the same place, though, so only one suffix in about 150, the
one that starts with such an anchor gram, needs to be a row; it stands for the run of starts around it.

1. Splitters, sampled from the suffixes of a random share of the texts, range-partition the anchor suffixes by their
   leading tokens (the anchor gram, then the whole run, then the text), so even one string that a third of all
   documents hold spreads over many buckets. Each bucket sorts its suffixes by multikey quicksort, and what lies at
   its ends is compared with the ends of the others. Runs found twice are repeated as a whole.
2. Runs that only share the gram are cut into blocks of neighbouring starts. All strings that start in a block share
   its core, so blocks are range-partitioned, sorted and compared likewise by their cores, and in blocks of equal cores
   the strings are told apart by the few bytes on both sides that the core leaves out. Strings of a core that goes on
   across buckets are counted over all of them, each once a bucket.
3. The repeated spans of a text are joined to it and cut out.

Texts are keyed by 128 bits of hash, so equal texts share their spans. Tokens are compared by 64-bit hashes each.
Longer repeats lie inside shorter ones, so spans of a second, greater length are searched in the first one's only.

Rows: null texts count as empty and stay so; texts shorter than ``length`` bytes come back whole. Repeated rows
repeat each other, so they are removed where long enough. Ids may be null or repeated. Other columns are not
read, except that ``remove_repeats`` returns all. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.llm import textkernel as tk
from lexarium.llm.batches import batch_rows, trimmed
from lexarium.llm.marks import has, marked
from lexarium.llm.ranges import dealt, multikey, share, sliced, whole
from lexarium.session import cut

_PLACE = np.uint64(24)
#: Starts worked on at once in a long text; places within fit in 24 bits.
_STRETCH = 1 << 22
#: Most neighbouring starts of a block.
BLOCK = 64
_RUN = "gram long, run long, ka long, kb long, base int, s0 int, s1 int, anchor int"
_BLOCK = "core long, ka long, kb long, at int, lo int, hi int, fringe binary"
_SPAN = "ka long, kb long, start int, end int"
#: What a row found in a bucket is: surely repeated, surely to be compared on, either if the bucket's end goes on elsewhere, an end itself.
WHOLE, OPEN, IF_WHOLE, IF_OPEN, END = range(5)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """text, first start, last start, anchor (all within the text), gram hash and hash of the run's bytes."""
    out = []
    for a, b in tk.slices(offsets):
        at = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        for begin in range(0, max(1, len(part)), _STRETCH):
            piece = part[begin : begin + _STRETCH + length - 1]
            n = len(piece) - length + 1  # starts here
            if n <= 0:
                continue
            prefix = tk.prefix_hash(piece, tk.EXACT)
            first = np.arange(len(piece) - gram + 1)
            hashes = tk.range_hash(prefix, first, first + gram)
            least = (hashes >> _PLACE << _PLACE) | first.astype(np.uint64)
            width = length - gram + 1
            blocks = np.full(-(-len(least) // width) * width, np.iinfo(np.uint64).max, np.uint64)
            blocks[: len(least)] = least
            blocks = blocks.reshape(-1, width)
            ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
            behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
            anchor = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
            text = np.searchsorted(at, np.arange(begin, begin + n), "right") - 1
            valid = np.flatnonzero(np.arange(begin, begin + n) + length <= at[text + 1])
            if not len(valid):
                continue
            cuts = np.flatnonzero((np.diff(valid) != 1) | (np.diff(anchor[valid]) != 0) | (np.diff(text[valid]) != 0))
            s0, s1 = valid[np.r_[0, cuts + 1]], valid[np.r_[cuts, len(valid) - 1]]
            k = anchor[s0]
            run = tk.range_hash(prefix, s0, s1 + length) ^ tk.mix((k - s0).astype(np.uint64))
            base = at[text[s0]] - begin
            out.append((text[s0] + a, s0 - base, s1 - base, k - base, hashes[k], run))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchor_rows(length: int, gram: int):
    """The anchor suffixes of (ka, kb, base, body): ``base`` is where the body lies in its text."""

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            rows = []
            for i, key in enumerate(zip(b.column("ka").to_pylist(), b.column("kb").to_pylist(), b.column("base").to_pylist(), strict=True)):
                seen[key] += 1
                if seen[key] < 3:  # two show that the text is repeated; its spans go to all of its copies
                    rows.append(i)
            b = b.take(pa.array(rows, pa.int64())) if len(rows) < len(b) else b
            data, offsets = tk.buffers(b.column("body"))
            text, s0, s1, k, grams, runs = anchors(data, offsets, length, gram)
            if len(text):
                base = b.column("base").to_numpy()[text]
                rest = [b.column("ka").to_numpy()[text], b.column("kb").to_numpy()[text], base, *((x + base).astype(np.int32) for x in (s0, s1, k))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (grams.view(np.int64), runs.view(np.int64), *rest)], ["gram", "run", "ka", "kb", "base", "s0", "s1", "anchor"])

    return run


def _same_runs(table: pa.Table, bucket: int):
    """Rows of runs found twice (WHOLE), one row of each run of grams with several (OPEN), and what the ends may add.

    The two rows of END hold the first and the last gram and run of the bucket.
    """
    names = ["gram", "run", "ka", "kb", "base", "s0", "s1", "anchor"]
    columns = [whole(table.column(n)) for n in names]
    order, shared = multikey(columns[:2])
    columns = [c[order] for c in columns]
    run_id, gram_id, first = np.cumsum(shared < 2) - 1, np.cumsum(shared < 1) - 1, shared < 2
    run_id[0] = gram_id[0] = 0
    twice, several = (np.bincount(run_id) > 1)[run_id], (np.bincount(gram_id[first]) > 1)[gram_id]
    code = np.full(len(order), -1, np.int8)
    code[(run_id == 0) | (run_id == run_id[-1])] = IF_WHOLE
    code[twice] = WHOLE
    other = np.full(len(order), -1, np.int8)
    other[first & ((gram_id == 0) | (gram_id == gram_id[-1]))] = IF_OPEN
    other[first & several] = OPEN
    for c in (code, other):
        pick = np.flatnonzero(c >= 0)
        yield from sliced([c[pick], *(x[pick] for x in columns), np.full(len(pick), bucket, np.int32)], ["code", *names, "bucket"])
    ends = [0, len(order) - 1]
    yield from sliced([np.full(2, END, np.int8), *(x[ends] for x in columns), np.full(2, bucket, np.int32)], ["code", *names, "bucket"])


def _block_rows(length: int, width: int):
    """The blocks of starts of each text's open runs, with the bytes of their strings that the core leaves out."""

    def blocks(b, data, offsets):
        lists = b.column("runs")
        runs = lists.flatten()
        row = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
        s0, s1, anchor, gram = (runs.field(n).to_numpy() for n in ("s0", "s1", "anchor", "gram"))
        low, high = (anchor - s1).astype(np.int64), (anchor - s0).astype(np.int64)  # distances of the starts from the anchor
        count = high // width - low // width + 1
        of = np.repeat(np.arange(len(row)), count)
        block = low[of] // width + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        lo, hi = np.maximum(low[of] - block * width, 0), np.minimum(high[of] - block * width, width - 1)
        at = anchor[of] - block * width  # where the core begins in the text
        place = at - b.column("base").to_numpy()[row[of]] + offsets[row[of]]  # and in the slice
        core_size = length - width + 1
        prefix = tk.prefix_hash(data, tk.EXACT)
        core = tk.range_hash(prefix, place, place + core_size) ^ tk.mix(tk.mix(gram[of].view(np.uint64)) + block.astype(np.uint64))
        steps = np.arange(width - 1)
        gaps = np.concatenate([steps - width + 1, core_size + steps])
        for i in range(0, len(of), 10_000):
            p, l, h = (x[i : i + 10_000, None] for x in (place, lo, hi))
            kept = np.concatenate([steps >= width - 1 - h, steps < width - 1 - l], axis=1)
            body = np.where(kept, data[np.clip(p + gaps, 0, len(data) - 1)], 0).astype(np.uint8)
            fringe = pa.Array.from_buffers(pa.binary(), len(body), [None, pa.py_buffer(np.arange(len(body) + 1, dtype=np.int32) * np.int32(2 * width - 2)), pa.py_buffer(body.tobytes())])
            r = pa.array(row[of[i : i + 10_000]])
            ints = [pa.array(x[i : i + 10_000].astype(np.int32)) for x in (at, lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array(core[i : i + 10_000].view(np.int64)), b.column("ka").take(r), b.column("kb").take(r), *ints, fringe], ["core", "ka", "kb", "at", "lo", "hi", "fringe"])

    def run(batches):
        last = None
        for b in batches:
            keys = list(zip(b.column("ka").to_pylist(), b.column("kb").to_pylist(), b.column("base").to_pylist(), strict=True))
            new = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else last)]  # equal texts lie together
            last = keys[-1] if keys else last
            data, offsets = tk.buffers(b.column("body"))
            for i, j in tk.slices(offsets):
                rows = new[bisect_left(new, i) : bisect_left(new, j)]
                if rows:
                    at = offsets[rows] - offsets[i]
                    yield from blocks(b.take(pa.array(rows, pa.int64())), data[offsets[i] : offsets[j]], at)

    return run


def _strings(table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the strings at each start of the blocks, and which blocks have one there."""
    lo, hi = (table.column(n).to_numpy()[:, None] for n in ("lo", "hi"))
    starts = np.arange(width)
    keys = np.empty((len(lo), width), np.uint64)
    for i in range(0, len(lo), 5_000):
        part = table.slice(i, 5_000)
        prefix = tk.prefix_hash(np.frombuffer(b"".join(part.column("fringe").to_pylist()), np.uint8), tk.EXACT)
        begin = np.arange(len(part))[:, None] * (2 * width - 2) + width - 1 - starts
        keys[i : i + 5_000] = tk.range_hash(prefix, begin, begin + width - 1) ^ tk.mix(part.column("core").to_numpy().view(np.uint64)[:, None] + starts.astype(np.uint64))
    return keys, (lo <= starts) & (starts <= hi)


def _spans(ka, kb, at, tied: np.ndarray, length: int):
    """Rows of repeated spans from the tied starts of blocks: neighbouring starts make one."""
    wide = np.pad(tied, ((0, 0), (1, 1))).astype(np.int8)
    turn = np.diff(wide, axis=1)
    row, first = np.nonzero(turn == 1)
    _, after = np.nonzero(turn == -1)
    yield from sliced([ka[row], kb[row], (at[row] - after + 1).astype(np.int32), (at[row] - first + length).astype(np.int32)], ["ka", "kb", "start", "end"])


def _same_strings(length: int, width: int):
    """Repeated spans of a bucket's blocks, and the strings that other buckets may hold too.

    These are the strings of the cores at the bucket's ends, each once: with a key, and whether they are known to be
    repeated.
    """

    def run(table: pa.Table, bucket: int):
        order, shared = multikey([whole(table.column("core"))])
        core_id = np.cumsum(shared < 1) - 1
        size = np.bincount(core_id)[core_id]
        end = (core_id == 0) | (core_id == core_id[-1])
        pick = (size > 1) | end
        own = table.take(pa.array(order[pick])).combine_chunks()
        outer = end[pick]
        ka, kb, at = (own.column(n).to_numpy() for n in ("ka", "kb", "at"))
        keys, there = _strings(own, width)
        tied = np.zeros((len(own), width), bool)
        for q in range(width):
            which = np.flatnonzero(there[:, q])
            o, same = multikey([keys[which, q]])
            which = which[o]
            twice = np.zeros(len(which), bool)
            twice[1:] |= same[1:] > 0
            twice[:-1] |= same[1:] > 0
            tied[which[twice], q] = True
            first = which[(same == 0) & outer[which]]
            start = (at[first] - q).astype(np.int32)
            for b in sliced([ka[first], kb[first], start, start + np.int32(length), keys[first, q].view(np.int64), tied[first, q]], ["ka", "kb", "start", "end", "key", "known"]):
                if len(b):
                    yield b
        for b in _spans(ka, kb, at, tied, length):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(b), pa.int64()), pa.array(np.ones(len(b), bool))], [*b.schema.names, "key", "known"])

    return run


def _over_ends(found: DataFrame, ends: list[tuple[int, int, int]]) -> tuple[DataFrame, DataFrame]:
    """The WHOLE and OPEN rows, with those that the comparison of all buckets' ends (gram, run, bucket) adds."""
    spark, runs, buckets = found.sparkSession, {}, {}
    for gram, run, bucket in ends:
        runs.setdefault(gram, set()).add(run)
        buckets.setdefault((gram, run), set()).add(bucket)
    again = spark.createDataFrame([k for k, v in buckets.items() if len(v) > 1], "gram long, run long")  # two a bucket at most
    more = spark.createDataFrame([(g,) for g, v in runs.items() if len(v) > 1], "gram long")
    sure = found.where(F.col("code") == IF_WHOLE).join(F.broadcast(again), ["gram", "run"], "left_semi")
    open_ = found.where(F.col("code") == IF_OPEN).join(F.broadcast(more), ["gram"], "left_semi")
    keep = ["ka", "kb", "base", "s0", "s1", "anchor", "gram"]
    return found.where(F.col("code") == WHOLE).select(keep).union(sure.select(keep)), found.where(F.col("code") == OPEN).select(keep).union(open_.select(keep))


def _merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({"_ka": F.xxhash64(text), "_kb": F.xxhash64(F.lit(7), text)})


def _bodies(docs: DataFrame, length: int, text_col: str) -> DataFrame:
    """(ka, kb, base, body) of the whole texts of ``length`` bytes or more."""
    texts = _keyed(docs.select(docs[text_col].alias("text")), "text").where(F.octet_length("text") >= length)
    return texts.select(F.col("_ka").alias("ka"), F.col("_kb").alias("kb"), F.lit(0).alias("base"), F.col("text").cast("binary").alias("body"))


def _pieces(bodies: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """The parts of whole texts that lie in the merged ``spans`` and have ``length`` bytes or more; cut."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for ka, kb, body, found in zip(*(b.column(c).to_pylist() for c in ("ka", "kb", "body", "spans")), strict=True):
                for a, z in _merge(found):
                    if z - a >= length:
                        for column, value in zip(out, (ka, kb, a, body[a:z]), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["ka", "kb", "base", "body"])

    return cut(_marked_only(bodies, spans).join(spans, ["ka", "kb"]).mapInArrow(trimmed(run), "ka long, kb long, base int, body binary"))


def _marked_only(bodies: DataFrame, keys: DataFrame) -> DataFrame:
    """The bodies whose ka is in ``keys``, and a few others, before they are shuffled."""
    marks = marked(keys.select("ka"))

    def run(batches):
        for b in batches:
            yield b.filter(has(marks, b.column("ka").to_numpy()))

    return bodies.mapInArrow(run, "ka long, kb long, base int, body binary")


def repeated_spans(docs: DataFrame, length: int = 400, text_col: str = "text", within: DataFrame | None = None) -> DataFrame:
    """ka, kb and spans (array of start, end in bytes, unmerged) of every text with a repeated byte.

    ``within`` are the spans of a smaller length, which hold all those sought.
    """
    gram, width = max(8, length // 4), max(1, min(BLOCK, length // 4))
    spark, bodies = docs.sparkSession, _bodies(docs, length, text_col)
    if within is not None:
        bodies = _pieces(bodies, within, length)
    found = dealt(bodies, share(bodies), _anchor_rows(length, gram), _RUN, ["gram", "run", "ka"], _same_runs, f"code byte, {_RUN}, bucket int")
    ends = [tuple(r) for r in found.where(F.col("code") == END).select("gram", "run", "bucket").collect()]  # two a bucket
    sure, open_ = _over_ends(found, ends)
    runs = cut(open_.groupBy("ka", "kb", "base").agg(F.collect_set(F.struct("s0", "s1", "anchor", "gram")).alias("runs")))
    near = _marked_only(bodies, runs)

    with batch_rows(spark, 1000):
        keys = ["ka", "kb", "base"]
        compared = dealt(near.join(runs, keys), share(near).join(runs, keys), _block_rows(length, width), _BLOCK, ["core", "ka"], _same_strings(length, width), f"{_SPAN}, key long, known boolean")
    strings = compared.where("key is not null")
    again = strings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    spans = sure.select("ka", "kb", F.col("s0").alias("start"), (F.col("s1") + length).alias("end"))
    for more in (compared.where("key is null"), strings.where("not known").join(again, "key")):
        spans = spans.union(more.select("ka", "kb", "start", "end"))
    return cut(spans.groupBy("ka", "kb").agg(F.collect_set(F.struct("start", "end")).alias("spans")))


def _with_spans(docs: DataFrame, spans: DataFrame, text_col: str, work, schema: str) -> DataFrame:
    """Apply ``work`` to all rows with their spans (columns besides ka and kb); rows without any are not shuffled."""
    rows = _keyed(docs, text_col)
    marks = marked(spans.select("ka"))
    names = [f.name for f in rows.schema]
    own, found = docs.columns, [c for c in spans.columns if c not in ("ka", "kb")]

    def near(batches):
        for b in batches:
            yield b.filter(has(marks, b.column("_ka").to_numpy()))

    def far(batches):
        """The work on rows that have no spans."""
        none = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

        def bare():
            for b in batches:
                b = b.filter(pc.invert(has(marks, b.column("_ka").to_numpy())))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *[pa.nulls(len(b), none)] * len(found)], [*own, *found])

        yield from work(bare())

    joined = rows.mapInArrow(near, rows.schema).select(*names).join(spans.withColumnsRenamed({"ka": "_ka", "kb": "_kb"}), ["_ka", "_kb"], "left")
    return joined.select(*own, *found).mapInArrow(trimmed(work), schema).union(rows.mapInArrow(trimmed(far), schema))


def repeat_digests(docs: DataFrame, length: int = 400, passage: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    With ``passage``, a smaller length, also n_passage_bytes: the bytes covered by repeated strings of that length.
    """
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    short = repeated_spans(slim, passage) if passage else None
    spans = repeated_spans(slim, length, within=short).withColumnRenamed("spans", "_spans")
    if passage:
        spans = short.withColumnRenamed("spans", "_short").join(spans, ["ka", "kb"], "left")

    def work(batches):
        for b in batches:
            rows = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist(), strict=True):
                raw, merged = (text or "").encode(), _merge(spans)
                digest, at = hashlib.sha256(), 0
                for a, z in merged:
                    digest.update(raw[at:a])
                    at = z
                digest.update(raw[at:])
                rows.append((len(raw), sum(z - a for a, z in merged), len(merged), digest.hexdigest()))
            n, gone, spans, sha = zip(*rows, strict=True) if rows else ((),) * 4
            out = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if passage:
                out.append(pa.array([sum(z - a for a, z in _merge(x)) for x in b.column("_short").to_pylist()], pa.int64()))
                names.append("n_passage_bytes")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = dict(slim.dtypes)["doc_id"]
    with batch_rows(docs.sparkSession, 1000):
        return cut(_with_spans(slim, spans, "text", work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', n_passage_bytes long' if passage else ''}"))


def remove_repeats(docs: DataFrame, length: int = 400, text_col: str = "text") -> DataFrame:
    """All rows and columns with the repeated bytes gone from the text; characters cut in two go whole."""
    others = F.struct(F.lit(0).alias("0"), *[docs[c].alias(str(i + 1)) for i, c in enumerate(docs.columns) if c != text_col])
    slim = docs.select(others.alias("row"), docs[text_col].cast("string").alias("text"))

    def work(batches):
        for b in batches:
            texts = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist(), strict=True):
                if spans:
                    raw, at, kept = text.encode(), 0, []
                    for a, z in _merge(spans):
                        kept.append(raw[at:a].decode(errors="ignore"))
                        at = z
                    text = "".join(kept) + raw[at:].decode(errors="ignore")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    out = _with_spans(slim, repeated_spans(slim, length).withColumnRenamed("spans", "_spans"), "text", work, slim.schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[str(i + 1)].alias(c) for i, c in enumerate(docs.columns)])
