"""Approximate nearest neighbours by inner product with an adaptive dimension scan.

Vectors are turned by a fixed random rotation and dealt into inverted lists around centroids, which are fitted on a
bounded sample; every vector is indexed. A query scans the lists whose centroids it is nearest to; how many is
measured: the exact neighbours of a held sample of the queries tell from which rank of lists on too few are left.
Within the probed lists, rotated vectors lie in column blocks: after each block a hypothesis test on the partial distance drops candidates
that will not reach the query's current k-th best, and only survivors go on to further columns. A product below the
k-th best is a squared distance above |q|^2 + |x|^2 - 2 best. After a random rotation, d of D columns hold d / D of
a squared distance, to within a factor of about (1 + epsilon / sqrt(d))^2, so a candidate whose scaled partial
distance exceeds even that goes. Survivors are scored in double precision on the original vectors.

Lists are gathered into blocks of bounded size and large ones split, so a list with a third of all vectors is many
tasks; a block meets a query once, for all lists of it that are probed, and 50,000 queries at a time. Rows: vectors that are null, zero, of another length than most, or that hold null
or non-finite values take no part, nor do null ids. Rows that share an id are never each other's neighbours; as
queries they count once. Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexarium.llm import textkernel as tk
from lexarium.session import cut

#: Vectors the centroids are fitted on, at most; by hash of the id.
SAMPLE = 20_000
#: Queries whose exact neighbours are found to choose the number of lists, at most; by hash of the id.
HELD = 400
#: Vectors a list holds on average, and most lists: centroids need some of the sample each.
PER_LIST, MOST_LISTS = 100, 1024
BLOCK, QUERY_BLOCK = 20_000, 50_000
_COLUMNS = 16


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means on the sample, from distinct starting vectors."""
    rng = np.random.default_rng(11)
    start = np.unique(sample, axis=0)
    c = start[rng.permutation(len(start))[:lists]]
    for _ in range(rounds):
        own = np.argmin((c * c).sum(1) - 2 * sample @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(c))[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


def scan(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, epsilon: float = 2.5, probed: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(query id, vector id, score) of each query's k best of a block found by the adaptive scan.

    ``probed`` (queries x vectors) tells which vectors a query's lists hold; all without it.
    """
    dim = vectors.shape[1]
    turn = rotation(dim)
    x, q = (vectors @ turn).astype(np.float32), (queries @ turn).astype(np.float32)
    steps = [*range(0, dim, _COLUMNS), dim]
    ends = steps[1:]
    norm_x = np.stack([(x[:, :e].astype(np.float64) ** 2).sum(1) for e in ends])  # of the columns so far
    norm_q = np.stack([(q[:, :e].astype(np.float64) ** 2).sum(1) for e in ends])
    slack = 1e-5 * np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0))
    blocks = [np.ascontiguousarray(x[:, a:b]) for a, b in zip(steps[:-1], steps[1:], strict=True)]
    out = []
    for i in range(0, len(q), 64):
        group = q[i : i + 64]
        first = group[:, :_COLUMNS] @ blocks[0].T
        size = np.sqrt((group.astype(np.float64) ** 2).sum(1))
        for r in range(len(group)):
            own = query_ids[i + r]
            live = np.flatnonzero(ids != own if probed is None else probed(i + r) & (ids != own))
            if not len(live):
                continue
            seed = live[:: max(1, len(live) // (16 * k))]  # a first guess of the k-th best
            known = x[seed] @ group[r]
            floor = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else -np.inf
            floor -= slack * size[r]
            partial = first[r][live]
            for s in range(len(blocks)):
                if s:
                    partial = partial + blocks[s][live] @ group[r, steps[s] : steps[s + 1]]
                d = ends[s]
                distance = norm_q[s, i + r] + norm_x[s][live] - 2.0 * partial
                allowed = norm_q[-1, i + r] + norm_x[-1][live] - 2.0 * floor
                good = np.flatnonzero(distance * (dim / d) <= allowed * (1 + epsilon / np.sqrt(d)) ** 2 if d < dim else partial >= floor)
                live, partial = live[good], partial[good]
                if s == 0 and len(live) > 4 * k:  # tighten with the most promising
                    top = live[np.argpartition(partial, len(partial) - 2 * k)[len(partial) - 2 * k :]]
                    full = x[top] @ group[r]
                    floor = max(floor, np.partition(full, len(full) - k)[len(full) - k] - slack * size[r])
            scores = np.sum(vectors[live].astype(np.float64) * queries[i + r].astype(np.float64), axis=1)
            best = np.lexsort((ids[live], -scores))[:k]
            out += zip([int(own)] * len(best), ids[live[best]].tolist(), scores[best].tolist(), strict=True)
    return out


def exact(queries: np.ndarray, query_ids: np.ndarray, k: int):
    """For each query the k best rows (id, v, list) of all batches: query's place, list, id and score."""

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        for b in batches:
            ids, lists, x = b.column(0).to_numpy(), b.column(2).to_numpy().astype(np.int64), _matrix(b.column(1))
            for i, s in enumerate(queries @ x.T if len(b) else ()):
                held = [np.concatenate(y) for y in zip(best[i], (ids, lists, s), strict=True)]
                other = held[0] != query_ids[i]
                held = [y[other] for y in held]
                order = np.lexsort((held[0], -held[2]))[:k]
                best[i] = tuple(y[order] for y in held)
        n = [len(b[0]) for b in best]
        ids, lists, scores = (np.concatenate(y) for y in zip(*best, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), n).astype(np.int32)), pa.array(lists.astype(np.int32)), pa.array(ids), pa.array(scores)], ["place", "list", "id", "score"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def list_ranks(queries: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Each query's rank of every list, by the product with its centroid."""
    order = np.argsort(-(queries @ c.T), axis=1, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(len(c))[None], axis=1)
    return ranks


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, lists: int | None = None, probes: int | None = None, recall: float = 0.95, epsilon: float = 2.5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each query (id and vector columns as in vectors).

    Without ``lists``, one for each PER_LIST vectors, up to MOST_LISTS; without ``probes``, as many lists as the held
    queries need to have ``recall`` of their exact neighbours in them.
    """
    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    rows, asked = valid(vectors), valid(queries).dropDuplicates(["id"])
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes.d
    rows, asked = rows.where(F.size("v") == dim), cut(asked.where(F.size("v") == dim))
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    c = centroids(sample, max(1, min(lists or max(1, sizes["count"] // PER_LIST), MOST_LISTS, len(sample) // 8 or 1)))
    held = spark.sparkContext.broadcast(c)  # MOST_LISTS x dim

    def deal(batches):
        for b in batches:
            x = _matrix(b.column(1))
            own = np.argmin((held.value**2).sum(1) - 2 * x @ held.value.T, 1) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32))], ["id", "v", "list"])

    dealt = cut(rows.mapInArrow(deal, "id long, v array<double>, list int"))
    counts = {r.list: r.n for r in dealt.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    full = np.array([counts.get(i, 0) for i in range(len(c))])
    tried = asked.orderBy(F.xxhash64("id"), "id").limit(HELD).collect()
    if not tried:
        return spark.createDataFrame([], schema)
    if probes is None:
        q, own = np.array([r.v for r in tried]), np.array([r.id for r in tried])
        near = dealt.mapInArrow(exact(q, own, k), "place int, list int, id long, score double")
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k).select("place", "list").collect()  # HELD x k
        ranks = list_ranks(q, c)
        needed = sorted(int(ranks[r.place, r.list]) for r in near)
        probes = 1 + needed[min(len(needed) - 1, int(recall * len(needed)))] if needed else len(c)
    total = asked.count()
    # list i goes to blocks start[i] to start[i] + parts[i] - 1: small neighbours share one, large ones have several
    parts = np.maximum(1, -(-full // BLOCK))
    start, block, load = np.zeros(len(c), np.int64), 0, 0
    for i, n in enumerate(full):
        if load and (load + n > BLOCK or parts[i] > 1):
            block, load = block + 1, 0
        start[i], load = block, load + n
        if parts[i] > 1:
            block, load = block + int(parts[i]), 0
    sides = max(1, -(-total // QUERY_BLOCK))

    def route(batches):
        for b in batches:
            if not len(b):
                continue
            q = _matrix(b.column(1))
            ranks = list_ranks(q, held.value)
            order = np.argsort(ranks, axis=1)
            enough = np.cumsum(full[order], axis=1) - full[order] < 4 * (k + 1)  # go on where lists are short
            use = np.take_along_axis(enough, ranks, axis=1) | (ranks < probes)
            out: list[list] = [[], [], []]
            for r in range(len(q)):
                chosen = np.flatnonzero(use[r])
                of, first = np.unique(start[chosen], return_index=True)
                for s, own in zip(of, np.split(chosen, first[1:]), strict=True):
                    for sub in range(int(parts[own[0]])):
                        for column, value in zip(out, (r, int(s) + sub, own.tolist()), strict=True):
                            column.append(value)
            row = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int32()))], ["id", "v", "block", "lists"])

    def place(batches):
        for b in batches:
            own = b.column("list").to_numpy()
            spread = (tk.mix(b.column("id").to_numpy().astype(np.uint64)) % parts[own].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((start[own] + spread).astype(np.int32))], ["id", "v", "list", "block"])

    to_blocks = dealt.mapInArrow(place, "id long, v array<double>, list int, block int").withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    from_queries = asked.mapInArrow(route, "id long, v array<double>, block int, lists array<int>").withColumn("side", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(sides)).cast("int"))

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            a, b = left.combine_chunks(), right.combine_chunks()
            own, asked_for = a["list"].to_numpy(), b["lists"].to_pylist()

            def probed(i: int) -> np.ndarray:
                wanted = np.zeros(len(full), bool)
                wanted[asked_for[i]] = True
                return wanted[own]

            found = scan(_matrix(b["v"].combine_chunks()), b["id"].to_numpy(), _matrix(a["v"].combine_chunks()), a["id"].to_numpy(), k, epsilon, probed)
        q, v, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    keys = ["block", "side"]
    near = to_blocks.groupBy(*keys).cogroup(from_queries.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
