"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.session import cut

#: Up to so many edges (16 bytes each) one task joins them by union-find; more go through star contraction.
ONE_TASK_EDGES = 500_000


def _union_find(batches):
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))
    for a, b in zip(both[: len(u)].tolist(), both[len(u) :].tolist(), strict=True):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
    for i in range(len(parent)):  # parents are smaller, so one pass upwards settles all
        parent[i] = parent[parent[i]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[parent], pa.int64())], ["node", "component"])


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) for every node of ``edges`` (u long, v long); the component is its smallest node.

    Nulls and loops are ignored; repeated edges count once; no edges give no rows. Small edge tables, counted
    first, are joined in one task; larger ones by alternating large-star and small-star rounds, whose rows never
    exceed the edges and whose hot nodes only take part through a pre-aggregated minimum and a splittable join.
    """
    edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct())
    if edges.count() <= one_task_edges:
        return cut(edges.coalesce(1).mapInArrow(_union_find, "node long, component long"))
    before = None
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        edges = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return cut(pairs.union(pairs.select("component", "component")).groupBy("node").agg(F.min("component").alias("component")))
