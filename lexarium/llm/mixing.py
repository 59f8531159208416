"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is cut into blocks of documents. Block j of a source with weight w is released at slot floor(j / w)
and due by slot ceil((j + 1) / w); earliest-deadline-first gives every slot to one released block, and as the
weights sum to one, no deadline is missed: while all sources last, each has been given its share of any prefix of
the slots to within less than one block. Weights are exact rationals, so the schedule repeats after the least common
multiple of their denominators, and that table is worked out on the driver; where it would be longer than MOST_SLOTS,
the blocks that are there (rows / ``block``) are scheduled instead. Sources of weight 0 follow behind all others.

All rows stay: a source that ends early leaves its later slots empty. Null sources are the source "". Within a source,
documents are ranked by a hash of the id (of the text where the id is null), then by id and text hash, so ids of any
pattern spread over all tasks and any prefix is a fair draw. Repeated rows each take a place. Columns named like those
that ``mix`` adds are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Longest period that is worked out whole.
MOST_SLOTS = 100_000


def exact_shares(sources: list[str], weights: dict[str, float]) -> dict[str, int]:
    """The true weights as whole shares of their sum, without the sources of weight 0; those without a weight share the rest alike."""
    want = {s: Fraction(str(weights[s])).limit_denominator(10**9) for s in sources if s in weights}
    rest = Fraction(max(0, 1 - sum(want.values()))) / max(1, len(sources) - len(want))
    want = {s: want.get(s, rest) for s in sources}
    if not any(want.values()):
        want = dict.fromkeys(sources, Fraction(1))
    total = sum(want.values())
    part = {s: x / total for s, x in want.items() if x}
    period = math.lcm(*(x.denominator for x in part.values()))
    return {s: int(x * period) for s, x in part.items()}


def block_slots(shares: dict[str, int], blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) of so many blocks of each source, earliest deadline first (ties by source name), idle slots jumped over."""
    period, slot, out, ready = sum(shares.values()), 0, [], []
    waiting = [(0, s, 0) for s in shares if blocks[s]]
    heapq.heapify(waiting)
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // shares[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        slot += 1
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * period // shares[s], s, j + 1))
    return out


def slot_table(counts: dict[str, int], weights: dict[str, float], block: int) -> list[dict]:
    """A row for each source and block of a period: place _s, shares _a of the period _p, first slot _f."""
    sources = sorted(counts)
    if not sources:
        return []
    shares = exact_shares(sources, weights)
    period = sum(shares.values())
    blocks = {s: -(-counts[s] // block) for s in sources}
    found = block_slots(shares, shares if period <= MOST_SLOTS else blocks)
    ends = {s: -(-blocks[s] // a) * period for s, a in shares.items()}
    rows = [{"_source": s, "_k": k, "_s": t, "_a": shares[s], "_p": period, "_f": 0} for s, k, t in found]
    behind = [s for s in sources if s not in shares]
    return rows + [{"_source": s, "_k": 0, "_s": i, "_a": 1, "_p": len(behind), "_f": max(ends.values())} for i, s in enumerate(behind)]


def mix(docs: DataFrame, weights: dict[str, float], block: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` beside _source, _rank, _block, _release, _deadline and _slot."""
    spark = docs.sparkSession
    # rows are counted within 4096 buckets a source, so that a hot source spreads over many tasks
    rows = docs.withColumns({"_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "_bucket": F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(""))), 1, 3), 16, 10).cast("int"), "_tie": F.xxhash64(text_col)})
    counts = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    slots = slot_table(dict(counts.groupBy("_source").agg(F.sum("_n")).collect()), weights, block)  # a row a source
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_source", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(slots)), "array<struct<_source:string,_k:bigint,_s:bigint,_a:bigint,_p:bigint,_f:bigint>>")).alias("x")).select("x.*")
    share = table.select("_source", "_a", "_p", "_f").distinct()
    small = F.broadcast if len(slots) <= MOST_SLOTS else lambda x: x
    ranked = rows.withColumn("_row", F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy(F.col(id_col).asc_nulls_first(), "_tie")))
    ranked = ranked.join(counts, ["_source", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    ranked = ranked.join(small(share), "_source").withColumn("_block", F.expr(f"_rank div {block}")).withColumn("_k", F.expr("_block % _a"))
    out = ranked.join(small(table.drop("_a", "_p", "_f")), ["_source", "_k"])
    return out.withColumns({
        "_release": F.expr("_f + _block * _p div _a"),
        "_deadline": F.expr("_f + ((_block + 1) * _p + _a - 1) div _a"),
        "_slot": F.expr("_f + (_block div _a) * _p + _s"),
    }).select(*docs.columns, "_source", "_rank", "_block", "_release", "_deadline", "_slot")


def mixed_order(docs: DataFrame, weights: dict[str, float], block: int = 64) -> DataFrame:
    """doc_id, source and the place of every document in the mixture."""
    slim = docs.select("doc_id", "source", F.xxhash64("text").cast("string").alias("text"))
    rows = mix(slim, weights, block)
    return rows.select("doc_id", F.col("_source").alias("source"), F.col("_rank").alias("source_rank"), F.col("_block").alias("block"), F.col("_release").alias("release_slot"), F.col("_deadline").alias("deadline_slot"), F.col("_slot").alias("slot"))


def mixed(docs: DataFrame, weights: dict[str, float], block: int = 64) -> DataFrame:
    """All rows and columns, range-partitioned and sorted by slot, so that files written from it are in mixed order."""
    slim = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.xxhash64("text").cast("string").alias("text"))
    ordered = mix(slim, weights, block).select("row", "_slot", "_rank")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ordered.repartitionByRange(parts, "_slot", "_rank").sortWithinPartitions("_slot", "_rank").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def oracle(weights: dict[str, float], block: int) -> str:
    """DuckDB SQL of ``mixed_order``; the schedule comes from a recursive query over one period of the exact weights."""
    parts = {s: Fraction(str(w)) for s, w in weights.items()}
    whole = math.lcm(*(x.denominator for x in parts.values()))
    values = ", ".join(f"('{s}', {int(x * whole)}::BIGINT)" for s, x in parts.items())
    digit = "strpos('0123456789abcdef', substr(h, {}, 1)) - 1".format
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(doc_id::VARCHAR, text, '')) AS h FROM documents),
given(source, w) AS (VALUES {values}),
s1 AS (SELECT source, w FROM (SELECT DISTINCT source FROM d) LEFT JOIN given USING (source)),
s2 AS (SELECT source, CASE WHEN w IS NULL THEN {whole} - coalesce(sum(w) OVER (), 0) ELSE w * greatest(1, count(*) FILTER (w IS NULL) OVER ()) END::BIGINT AS w FROM s1),
g AS (SELECT list_reduce(list(w), lambda x, y: gcd(x, y)) AS g, (sum(w) // list_reduce(list(w), lambda x, y: gcd(x, y)))::BIGINT AS p FROM s2),
sh AS (SELECT source, w // g AS a, p FROM s2, g),
l AS (SELECT list(source ORDER BY source) AS ss, list(a ORDER BY source) AS aa, any_value(p) AS p FROM sh),
e(t, n, pick, k) AS (
  SELECT -1::BIGINT, list_transform(aa, lambda x: 0::BIGINT), 0::BIGINT, -1::BIGINT FROM l
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(n) + 1), lambda i: n[i] + (i = j)::BIGINT), j, n[j]
  FROM (SELECT t, n, list_sort(list_transform(list_filter(range(1, len(n) + 1), lambda i: n[i] < aa[i] AND n[i] * p // aa[i] <= t + 1),
               lambda i: {{'d': ((n[i] + 1) * p + aa[i] - 1) // aa[i], 'i': i}}))[1].i AS j FROM e, l WHERE t < p - 1)),
tab AS (SELECT ss[pick] AS source, k, t AS s FROM e, l WHERE t >= 0),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY 256 * ({digit(1)}) + 16 * ({digit(2)}) + {digit(3)}, doc_id) - 1 AS source_rank FROM d)
SELECT doc_id, r.source, source_rank, source_rank // {block} AS block, (source_rank // {block}) * p // a AS release_slot,
       ((source_rank // {block} + 1) * p + a - 1) // a AS deadline_slot, ((source_rank // {block}) // a) * p + s AS slot
FROM r JOIN sh ON r.source = sh.source JOIN tab ON tab.source = r.source AND tab.k = (source_rank // {block}) % a
"""
