"""N-gram Jaccard join with set-relation skipping.

Every text becomes its set of distinct word shingles. Texts with equal sets collapse to one class, first in each task.
Classes are put into index lists under the rarest shingles of their sets (a prefix long enough that linked sets share
one). Two relations are used:

1. Index level: a list is sorted by size, component and position. A block of equal size and component is met as a
   whole: it is skipped if its size, its component or the entry's own position rules a link out, and otherwise only its
   stretch of small enough positions is read. A first round, whose pairs are neighbours in the lists, finds the
   components that make most blocks fall out; a second one meets all that is left.
2. Answer level: every set has the component's representative as a highly similar set, with a known number of shingles
   beyond it. For two components, the overlap of the representatives is computed once, and the answers of all their
   members are derived from it: x and z share at most the overlap, what x has beyond its own representative and what z
   has beyond its own. Only pairs that this leaves open are verified; linked representatives settle all pairs.

So a group of thousands of near copies costs pairs in proportion to its members where it hangs together, and no
link between different components is lost. Lists are range-partitioned by sampled splitters, so a long one spreads
over buckets (the first round needs no pair in particular); what the second round is left with of a list of more than
LIST_ROWS entries is cut into chunks that meet pairwise. The order of shingles by frequency comes from a sketch of fixed
size; any order gives the same result.

Rows: null or empty texts, and texts without words, have empty sets and link with nothing. Rows with a null id
have a set but take no part in links; their component is null. Rows come back one for one; those that share an id
are one document, so their components are one. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.llm import textkernel as tk
from lexarium.llm.batches import batch_rows, trimmed
from lexarium.llm.graph import components
from lexarium.llm.marks import has, marked
from lexarium.llm.ranges import dealt, share, sliced, whole
from lexarium.session import cut

#: Counters of the frequency sketch: 4 MB, whatever the input.
SKETCH_BITS = 20
_BLOCK_BITS = 14
#: Sets are compared pair by pair on 48 bits of each hash: with n shingles each, n * n / 2**48 wrong matches are expected.
_CUT = np.uint64(16)
#: Pairs of sets a worker holds at once.
VERIFY_ROWS = 128
#: How far apart in a list the pairs of round 1 lie.
STEPS = (1, 2, 3, 4, 6, *(2 * 3**i for i in range(2, 16)))
#: Bits of a set's parity bitmap.
BITMAP = 1024
#: Entries of lists a worker takes at once, about; a list with more left for the second round is cut.
LIST_ROWS = 4_000
#: Pairs expanded at once.
PAIR_ROWS = 300_000


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    data, offsets = tk.buffers(texts)
    for a, b in tk.slices(offsets):
        at = offsets[a : b + 1] - offsets[a]
        words, first = tk.word_hashes(data[offsets[a] : offsets[b]], at)
        hashes, first = tk.shingle_hashes(words, first, k)
        for i in range(b - a):
            yield a + i, np.unique(hashes[first[i] : first[i + 1]])


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    return int(s.sum(dtype=np.uint64).astype(np.int64)), int(tk.mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).astype(np.int64))


def needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of linked sets of these sizes: 100 * i >= percent * (na + nb - i)."""
    return -(-percent * (na + nb) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _profiles(k: int):
    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            rows = []
            for i, s in _sets(b.column(1), k):
                f1, f2 = _fingerprint(s)
                rows.append((b.column(0)[i].as_py(), len(s), f1, f2))
                np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            ids, n, f1, f2 = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield _profile_batch(ids, n, f1, f2, [None] * len(ids), [None] * len(ids))
        pack = zstandard.ZstdCompressor(level=1)
        parts = counts.reshape(-1, 1 << _BLOCK_BITS)
        full = [i for i in range(len(parts)) if parts[i].any()]
        none = [None] * len(full)
        yield _profile_batch(none, none, none, none, full, [pack.compress(parts[i].tobytes()) for i in full])

    return run


def _profile_batch(*columns):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n", "f1", "f2", "block", "counts"])


def _add_sketches(batches):
    total: dict[int, np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(unpack.decompress(raw, max_output_size=4 << _BLOCK_BITS), np.uint32)
            total[block] = total.get(block, np.uint32(0)) + x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def _postings(k: int, percent: int, order):
    """(token, f1, f2, n, pos) of each set's prefix: its rarest shingles by the sketch, ties by hash."""

    def run(batches):
        sketch, seen = order.value, set()
        for b in batches:
            tokens, ones, twos, sizes, places = [], [], [], [], []
            for _, s in _sets(b.column(0), k):
                n, (f1, f2) = len(s), _fingerprint(s)
                if not n or (f1, f2) in seen:
                    continue
                seen.add((f1, f2))
                p = prefix_length(n, percent)
                rare = sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                if p < n:
                    cutoff = np.partition(rare, p - 1)[p - 1]
                    near = np.flatnonzero(rare <= cutoff)
                    near = near[np.argsort(rare[near], kind="stable")][:p]
                else:
                    near = np.argsort(rare, kind="stable")
                tokens.append(s[near].view(np.int64))
                for held, value in ((ones, f1), (twos, f2), (sizes, n)):
                    held.append(np.full(p, value, np.int64))
                places.append(np.arange(p, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, sizes, ones, twos, places)], ["token", "n", "f1", "f2", "pos"])

    return run


def _lists(batches, names: list[str], most: int = 2_000_000):
    """Columns of whole index lists (runs of equal first column), many lists at once."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        if not len(b):
            continue
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in names])
        rows += len(b)
        if rows >= most and held[-1][0][-1] != held[0][0][0]:
            joined = [np.concatenate(x) for x in zip(*held, strict=True)]
            end = int(np.searchsorted(joined[0], joined[0][-1]))  # sorted, and the last list may go on
            if end:
                yield [x[:end] for x in joined]
            held = [[x[end:] for x in joined]]
            rows = len(held[0][0])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _passes(n, pos, i, j, percent):
    """Size and position filter of entries i < j of one list, sorted by size."""
    need = needed(n[i], n[j], percent)
    return np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need  # the shared shingle and all behind it


def _groups(*keys) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by the keys: each row's group, and where each group starts (one more than groups)."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new) - 1, np.r_[np.flatnonzero(new), len(new)]


def _blocks(t, n, comp, pos, percent):
    """(i, j) ranges of pairs in lists sorted by t, n, comp and pos: entry i with entries from a to z of one later block.

    Blocks are runs of equal t, n and comp. A block of i's own component, of too large a size, or at which i's own
    position leaves too few shingles, is skipped whole; of others, only the stretch of small enough positions counts.
    """
    block, start = _groups(t, n, comp)
    last = np.searchsorted(t[start[:-1]], t, "right") - 1 if len(t) else block  # the last block of the list
    key = block.astype(np.int64) << 32 | pos
    live, step = np.arange(len(t)), 0
    while True:
        step += 1
        live = live[block[live] + step <= last[live]]
        other = block[live] + step
        size = n[start[other]]
        fits = 100 * n[live] >= percent * size  # sorted by size: all later blocks are larger
        live, other, size = live[fits], other[fits], size[fits]
        if not len(live):
            return
        need = needed(n[live], size, percent)
        open_ = (comp[start[other]] != comp[live]) & (n[live] - pos[live] >= need)
        i, g, most = live[open_], other[open_], (size - need)[open_]
        end = np.searchsorted(key, (g.astype(np.int64) << 32) + np.maximum(most, -1), "right")
        good = (most >= 0) & (end > start[g])
        yield i[good], start[g[good]], end[good]


def _expanded(i, a, z):
    """Pairs of ranges, at most PAIR_ROWS at once."""
    many = z - a
    ends = np.cumsum(many)
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_ROWS, "right")))
        m = many[at:to]
        yield np.repeat(i[at:to], m), np.repeat(a[at:to], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        at = to


def _shared(percent: int):
    """Keep the entries of a bucket's lists that some other class's entry passes the filters with, one a class.

    Whether one is met is told by the least position of each size, so a list costs its entries times its sizes. The
    lists at the bucket's ends may go on elsewhere, so all of their entries are kept.
    """

    def run(table, bucket):
        t, n, f1, f2, pos = (whole(table.column(c)) for c in ("token", "n", "f1", "f2", "pos"))
        pos = pos.astype(np.int64)
        order = np.lexsort((f2, f1, pos, n, t))
        t, n, f1, f2, pos = (x[order] for x in (t, n, f1, f2, pos))
        keep = np.ones(len(t), bool)
        keep[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1]) | (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])
        t, n, f1, f2, pos = (x[keep] for x in (t, n, f1, f2, pos))
        group, start = _groups(t, n)
        met = (t == t[0]) | (t == t[-1])
        least, size, token = pos[start[:-1]], n[start[:-1]], t[start[:-1]]
        # within a size: the one of the least position is met by the second, all others by it
        first = np.zeros(len(t), bool)
        first[start[:-1]] = True
        two = np.flatnonzero(np.diff(start) > 1)
        partner = least[group].copy()
        partner[start[two]] = pos[start[two] + 1]
        alone = np.zeros(len(t), bool)
        alone[start[np.flatnonzero(np.diff(start) == 1)]] = True
        met |= ~alone & (n - np.maximum(pos, partner) >= needed(n, n, percent))
        for way in (1, -1):
            live, step = np.flatnonzero(~met), 0
            while len(live):
                step += 1
                other = group[live] + way * step
                inside = (other >= 0) & (other < len(size))
                live, other = live[inside], other[inside]
                same = (token[other] == t[live]) & (100 * np.minimum(size[other], n[live]) >= percent * np.maximum(size[other], n[live]))
                live, other = live[same], other[same]
                hit = np.minimum(n[live] - pos[live], size[other] - least[other]) >= needed(n[live], size[other], percent)
                met[live[hit]] = True
                live = live[~hit]
        pick = np.flatnonzero(met)
        yield from sliced([t[pick], n[pick], f1[pick], f2[pick], pos[pick].astype(np.int32)], ["token", "n", "f1", "f2", "pos"])

    return run


def _near(n, bits, i, j, percent):
    """Bitmap filter: differing parity bits are at most as many as differing shingles."""
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), 100_000):
        x, y = i[a : a + 100_000], j[a : a + 100_000]
        out[a : a + 100_000] = np.bitwise_count(bits[x] ^ bits[y]).sum(1) <= n[x] + n[y] - 2 * needed(n[x], n[y], percent)
    return out


def _sorted_pairs(a, b):
    return np.stack([np.minimum(a, b), np.maximum(a, b)], 1)


def _first_of_each(rows: np.ndarray) -> np.ndarray:
    """The rows, sorted, with each (first, second) column pair once."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])][: len(rows)]]


def _words(bits) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)


def _neighbours(percent: int):
    """Round 1: pairs of entries of a bucket that lie STEPS apart in their list, sorted by size."""

    def run(table, bucket):
        t, n, doc, pos = (whole(table.column(c)) for c in ("token", "n", "doc", "pos"))
        order = np.lexsort((doc, n, t))
        t, n, doc, pos, bits = t[order], n[order], doc[order], pos[order], _words(table.column("bits").to_pylist())[order]
        ends, found = np.searchsorted(t, t, "right"), [np.zeros((0, 2), np.int64)]
        for step in STEPS:
            i = np.flatnonzero(np.arange(len(t)) + step < ends)
            if not len(i):
                break
            i = i[(100 * n[i] >= percent * n[i + step]) & _passes(n, pos, i, i + step, percent)]
            i = i[_near(n, bits, i, i + step, percent)]
            found.append(_sorted_pairs(doc[i], doc[i + step]))
        pairs = _first_of_each(np.concatenate(found))
        yield from sliced([np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])], ["u", "v"])

    return run


def _across(percent: int):
    """Round 2: all pairs of a list whose components differ and that size, position and bitmap let pass.

    With each its components and the overlap of their representatives below which it cannot link.
    """
    names = ["token", "n", "comp", "pos", "doc", "extra", "side"]

    def flat(found):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in _first_of_each(np.concatenate(found)).T], ["u", "v", "cu", "cv", "least"])

    def run(batches):
        for *columns, bits in _lists(batches, [*names, "bits"], LIST_ROWS):
            t, n, comp, pos, doc, extra, side = columns
            pos, bits = pos.astype(np.int64), _words(bits)
            found: list[np.ndarray] = []
            for ranges in _blocks(t, n, comp, pos, percent):
                for i, j in _expanded(*ranges):
                    apart = (side[i] < 0) | (side[i] != side[j])  # two chunks of one list: pairs of both only
                    i, j = i[apart], j[apart]
                    good = _near(n, bits, i, j, percent)
                    i, j = i[good], j[good]
                    swap = doc[i] > doc[j]
                    u, v = np.where(swap, j, i), np.where(swap, i, j)
                    least = needed(n[i], n[j], percent) - extra[i] - extra[j]
                    found.append(np.stack([doc[u], doc[v], comp[u], comp[v], least], 1))
                    if sum(map(len, found)) > PAIR_ROWS:
                        yield flat(found)
                        found = []
            if found:
                yield flat(found)

    return run


def _bitmaps(batches):
    """The parity of the shingles that fall on each of BITMAP bits."""
    for b in batches:
        rows = []
        for raw in b.column("items"):
            s = tk.unpack_keys(raw.as_buffer())
            odd = np.bincount((s & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1
            rows.append(np.packbits(odd.astype(np.uint8)).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(rows, pa.binary())], ["doc", "bits"])


def _set_rows(k: int, marks):
    """Sets of the rows whose id is marked; a few others pass too and are never asked for."""

    def run(batches):
        for b in batches:
            b = b.filter(has(marks, b.column(0).to_numpy()))
            sets = [s for _, s in _sets(b.column(1), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tk.pack_keys(s >> _CUT) for s in sets], pa.binary())], ["doc", "items"])

    return run


def _only(marks):
    def run(batches):
        for b in batches:
            yield b.filter(has(marks, b.column(0).to_numpy()))

    return run


def _overlaps(batches):
    """How many shingles the sets of each pair share, and how large both are."""
    for b in batches:
        left, right = b.column("left"), b.column("right")
        shared, sizes = [], []
        for i in range(len(b)):
            x, y = tk.unpack_keys(left[i].as_buffer()), tk.unpack_keys(right[i].as_buffer())
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared.append(int((both[1:] == both[:-1]).sum()))
            sizes.append((len(x), len(y)))
        nu, nv = zip(*sizes, strict=True) if sizes else ((), ())
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(shared, pa.int64()), pa.array(nu, pa.int64()), pa.array(nv, pa.int64())], ["u", "v", "shared", "nu", "nv"])


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links of at least ``percent``) of each row."""
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    both = cut(texts.mapInArrow(trimmed(_profiles(k)), "doc_id long, n long, f1 long, f2 long, block int, counts binary"))
    profiles = both.where("block is null").select("doc_id", "n", "f1", "f2")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32).reshape(-1, 1 << _BLOCK_BITS)
    for block, raw in both.where("block is not null").select("block", "counts").repartition("block").mapInArrow(_add_sketches, "block int, counts binary").collect():  # 4 MB
        sketch[block] = np.frombuffer(raw, np.uint32)
    order = spark.sparkContext.broadcast(sketch.reshape(-1))
    classes = cut(profiles.where("doc_id is not null and n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc")))

    listed = texts.where("doc_id is not null").select("text")
    keys = "token long, n long, f1 long, f2 long, pos int"
    shared = dealt(listed, share(listed), _postings(k, percent, order), keys, ["token", "n", "f1"], _shared(percent), keys)
    entries = cut(shared.join(classes, ["f1", "f2", "n"]).select("token", "n", "doc", "pos"))
    marks = marked(entries.select("doc"))
    sets = cut(texts.where("doc_id is not null").mapInArrow(trimmed(_set_rows(k, marks)), "doc long, items binary"))

    def side(pairs: DataFrame, key: str, items: str) -> DataFrame:
        """The sets of one side's documents; most others are left out before the shuffle."""
        return sets.mapInArrow(_only(marked(pairs.select(key))), "doc long, items binary").select(F.col("doc").alias(key), F.col("items").alias(items))

    def overlaps(pairs: DataFrame) -> DataFrame:
        """u, v, shared, linked and the shingles of u that v lacks."""
        both = pairs.select("u", "v").join(side(pairs, "u", "left"), "u").join(side(pairs, "v", "right"), "v")
        with batch_rows(spark, VERIFY_ROWS):
            found = cut(both.mapInArrow(trimmed(_overlaps), "u long, v long, shared long, nu long, nv long"))
        return found.select("u", "v", "shared", (100 * F.col("shared") >= percent * (F.col("nu") + F.col("nv") - F.col("shared"))).alias("linked"), (F.col("nu") - F.col("shared")).alias("extra"))

    with batch_rows(spark, 1000):
        lists = cut(entries.join(sets.mapInArrow(_bitmaps, "doc long, bits binary"), "doc").select("token", "n", "doc", "pos", "bits"))
        tried = cut(dealt(lists, share(lists), iter, "token long, n long, doc long, pos int, bits binary", ["token", "n", "doc"], _neighbours(percent), "u long, v long").distinct())
    first = overlaps(tried)
    edges = first.where("linked").select("u", "v")
    known = components(edges)
    beyond = overlaps(known.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))).select(F.col("u").alias("doc"), "extra")
    labelled = lists.join(known.withColumnRenamed("node", "doc"), "doc", "left").join(beyond, "doc", "left")
    labelled = labelled.select("token", "n", F.coalesce("component", "doc").alias("comp"), "pos", "doc", F.coalesce("extra", F.lit(0)).alias("extra"), "bits")
    mixed = cut(labelled.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("rows")).where("low < high").select("token", F.ceil(F.col("rows") / LIST_ROWS).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("doc", F.lit(5)), F.col("chunks")).cast("int")
    cut_up = labelled.join(mixed, "token").withColumn("chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # two chunks of a list meet in a list of their own; of a chunk with itself all pairs count
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    token = F.when(F.col("chunks") == 1, F.col("token")).otherwise(F.xxhash64("token", low, high))
    ready = cut_up.select(token.alias("token"), "n", "comp", "pos", "doc", "extra", F.when(low == high, -1).otherwise(F.col("chunk")).alias("side"), "bits")
    with batch_rows(spark, 1000):
        rest = ready.repartition("token").sortWithinPartitions("token", "n", "comp", "pos", "doc").mapInArrow(trimmed(_across(percent)), "u long, v long, cu long, cv long, least long")
        rest = cut(rest.distinct().join(tried, ["u", "v"], "left_anti"))
    # the answers of two components' members follow from their representatives' overlap, where it is low or they link
    leaders = overlaps(rest.select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct())
    pair = leaders.select(F.col("u").alias("x"), F.col("v").alias("y"), "shared", "linked")
    open_ = rest.join(pair, (F.least("cu", "cv") == F.col("x")) & (F.greatest("cu", "cv") == F.col("y"))).where("not linked and shared >= least and not (least(u, v) = x and greatest(u, v) = y)")
    more = overlaps(cut(open_.select("u", "v"))).where("linked").select("u", "v")
    final = components(edges.union(leaders.where("linked").select("u", "v")).union(more))
    named = classes.join(final, classes.doc == final.node, "left").select("f1", "f2", "n", F.coalesce("component", "doc").alias("component"))
    out = profiles.join(named, ["f1", "f2", "n"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """All columns of the documents that stand for their group: those whose id is their component's."""
    found = jaccard_components(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
