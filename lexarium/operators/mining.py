"""Abbreviations, sequential patterns, prefix trees, clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.session import cut

_PAREN = re.compile(r"\(([^()]{1,60})\)")


def valid_short_form(short: str) -> bool:
    """Two to ten characters, at most two words, a letter somewhere, a letter or digit first."""
    return 2 <= len(short) <= 10 and len(short.split()) <= 2 and any(c.isalpha() for c in short) and short[0].isalnum()


def best_long_form(short: str, before: str) -> str | None:
    """The shortest tail of ``before`` that holds the short form's letters in order, the first one at a word's start."""
    at = len(before)
    letters = [c.lower() for c in short if c.isalnum()]
    for k in range(len(letters) - 1, -1, -1):
        at -= 1
        while at >= 0 and (before[at].lower() != letters[k] or k == 0 and at > 0 and before[at - 1].isalnum()):
            at -= 1
        if at < 0:
            return None
    return before[before.rfind(" ", 0, at + 1) + 1 :]


def abbreviation_pairs(text: str) -> Iterator[tuple[str, str]]:
    """(short, long) pairs of 'long form (SF)' in a text."""
    for m in _PAREN.finditer(text):
        short = re.split(r"[,;]", m[1])[0].strip()
        if not short or not valid_short_form(short):
            continue
        words = text[: m.start()].rstrip().split(" ")
        window = " ".join(words[-min(len(short) + 5, 2 * len(short)) :])
        window = re.split(r"[.;()\n]", window)[-1].strip()
        long = best_long_form(short, window)
        if long and len(long) > len(short) and short.lower() not in long.lower().split():
            yield short, long


def abbreviations(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, short, long) of every definition found; batches of texts in pandas, since matching runs backwards."""

    def run(parts):
        for p in parts:
            rows = [(d, s, n) for d, t in zip(p[doc], p[text], strict=True) if t for s, n in abbreviation_pairs(t)]
            yield pd.DataFrame(rows, columns=["doc", "short", "long"])

    kind = dict(docs.dtypes)[doc]
    return docs.select(doc, text).mapInPandas(run, f"doc {kind}, short string, long string")


def abbreviation_groups(pairs: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Counts of (short, capitalised long); longs whose words' first letters match the short too little are dropped."""
    letters = F.split(F.lower("short"), "")
    first = F.transform(F.split(F.lower("long"), " "), lambda w: F.substring(w, 1, 1))
    share = F.size(F.array_intersect(first, letters)) / F.size(F.array_distinct(first))
    return pairs.where(share >= ratio).groupBy("short", F.initcap("long").alias("long")).agg(F.count("*").alias("n"))


def frequent_sequences(rows: DataFrame, support: int, longest: int = 3, sid: str = "sid", items: str = "items") -> DataFrame:
    """(pattern, n) of item sequences that at least ``support`` rows hold in order, gaps allowed.

    Level by level: a frequent pattern is extended by every item behind its first occurrence; each level is one
    explode and one aggregation with map-side combining, and infrequent patterns go before the next.
    """
    level, out = rows.select(sid, F.array().cast("array<string>").alias("pattern"), F.lit(0).alias("at")), None
    for k in range(longest):
        rest = F.slice(F.col(items), F.col("at") + 1, F.greatest(F.size(items) - F.col("at"), F.lit(0)))
        nxt = level.join(rows.select(sid, items), sid).select(sid, "pattern", "at", F.explode(F.array_distinct(rest)).alias("item"), rest.alias("rest"))
        nxt = nxt.select(sid, F.concat("pattern", F.array("item")).alias("pattern"), (F.col("at") + F.array_position("rest", F.col("item"))).cast("int").alias("at"))
        nxt = cut(nxt) if k < longest - 1 else nxt  # the last level is only counted
        good = cut(nxt.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support))
        out = good if out is None else out.unionByName(good)
        level = nxt.join(good.select("pattern"), "pattern", "left_semi")
    return out


def closed_sequences(frequent: DataFrame) -> DataFrame:
    """The patterns of (pattern, n) that no pattern of one more item holds with the same count."""
    less = F.transform(F.sequence(F.lit(1), F.size("pattern")), lambda i: F.concat(F.slice("pattern", F.lit(1), i - 1), F.slice("pattern", i + 1, F.greatest(F.size("pattern") - i, F.lit(0)))))
    shorter = frequent.where(F.size("pattern") > 1).select(F.explode(less).alias("pattern"), "n").distinct()
    return frequent.join(shorter, ["pattern", "n"], "left_anti")


def trie(rows: DataFrame, items: str = "items", deepest: int | None = None) -> DataFrame:
    """Counted prefixes: (prefix, depth, cnt, is_leaf)."""
    n = F.size(items) if deepest is None else F.least(F.size(items), F.lit(deepest))
    prefixes = rows.where(F.size(items) > 0).select(F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(F.col(items), F.lit(1), i))).alias("prefix"))
    nodes = prefixes.groupBy("prefix").agg(F.count("*").alias("cnt")).withColumn("depth", F.size("prefix"))
    parents = nodes.where("depth > 1").select(F.slice("prefix", F.lit(1), F.col("depth") - 1).alias("prefix")).distinct().withColumn("_inner", F.lit(True))
    return nodes.join(parents, "prefix", "left").select("prefix", "depth", "cnt", F.col("_inner").isNull().alias("is_leaf"))


def common_ancestor(a: Column, b: Column) -> Column:
    """Longest common prefix of two key paths."""
    same = F.transform(F.sequence(F.lit(0), F.least(F.size(a), F.size(b)) - 1), lambda i: F.get(a, i) == F.get(b, i))
    n = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct((s["n"] + F.when(s["go"] & x, 1).otherwise(0)).alias("n"), (s["go"] & x).alias("go")), lambda s: s["n"])
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.slice(a, F.lit(1), F.lit(0))).otherwise(F.slice(a, F.lit(1), n))


def centroid_clusters(vectors: DataFrame, threshold: float, vid: str = "id", vec: str = "v", most: int = 20_000_000) -> DataFrame:
    """Agglomerative clustering of unit vectors by mutual best pairs of centroids at or above a cosine.

    Equal vectors are one weighted item from the start. Each round merges every pair of clusters that are each other's
    most similar, until no pair is left; clusters, not vectors, meet, in blocks of BLOCK centroids. Returns (id,
    cluster), a cluster being its smallest id. Vectors that are null, without length or hold null or non-finite numbers
    are like no other.

    A cluster takes in one other a round, so there can be as many rounds as it has members. Centroids of at most
    ``most`` numbers in all meet in Spark once, and their rounds then run on the driver, where only a merged cluster
    meets the others again; larger tables go through rounds in Spark until they are so small.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.select(F.col(vid).alias("id"), F.col(vec).alias("v"), F.min(vid).over(Window.partitionBy(F.xxhash64(vec), vec)).alias("cluster")))
    own = cut(rows.groupBy("cluster").agg(F.first("v").alias("v"), F.count("*").alias("n")).withColumn("item", F.col("cluster")))
    whole = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall("v", lambda x: x == 0)
    while True:
        clean = own.where(F.col("v").isNotNull() & ~whole)
        sums = clean.select("cluster", "n", F.posexplode("v").alias("k", "x")).groupBy("cluster", "k").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("n")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("c"), F.first("n").alias("n"))
        norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
        unit = cut(sums.select("cluster", "n", norm.alias("l"), "c").where("l > 0").select("cluster", F.transform("c", lambda x: x / F.col("l")).alias("c"), (F.col("l") * F.col("n")).alias("w")))
        if unit.agg(F.coalesce(F.sum(F.size("c")), F.lit(0)).alias("n")).first().n <= most:
            merge = _merge_all(unit, _best_partners(unit.drop("w"), threshold, PARTNERS), threshold)
            own = own.join(spark.createDataFrame(merge, "cluster long, into long"), "cluster", "left").select("item", F.coalesce("into", "cluster").alias("cluster"))
            break
        best = cut(_best_partners(unit.drop("w"), threshold, 1))
        merge = cut(best.alias("x").join(best.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a")) & (F.col("x.a") > F.col("x.b"))).select(F.col("x.a").alias("cluster"), F.col("x.b").alias("into")))
        if not merge.limit(1).count():
            break
        own = cut(own.join(merge, "cluster", "left").select("item", "v", "n", F.coalesce("into", "cluster").alias("cluster")))
    return rows.select("id", F.col("cluster").alias("item")).join(own.select("item", "cluster"), "item").select("id", "cluster")


#: Centroids of a block, and the partners of each that the driver keeps at hand.
BLOCK, PARTNERS = 4_000, 8


def _partners(s: np.ndarray, threshold: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) of each row's k best at the threshold or above, ties to the smaller column; by rows, best first."""
    i, j = np.nonzero(s >= threshold - 1e-8)
    x = np.round(s[i, j], 9)
    i, j, x = i[x >= threshold], j[x >= threshold], x[x >= threshold]
    o = np.lexsort((j, -x, i))
    i, j, x = i[o], j[o], x[o]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], x[first]


def _best_partners(unit: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, place, b, sim): each cluster's k most similar other ones, ties to the smaller, by products of blocks of centroids."""
    blocks = max(1, -(-unit.count() // BLOCK))
    dealt = unit.withColumn("block", F.pmod(F.xxhash64("cluster"), F.lit(blocks)).cast("int"))
    left = dealt.withColumn("other", F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))))
    right = dealt.withColumnRenamed("block", "other").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("other"))))

    def meet(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        a, b = a.sort_values("cluster"), b.sort_values("cluster")
        s, x, y = np.stack(a["c"]) @ np.stack(b["c"]).T, a["cluster"].to_numpy(), b["cluster"].to_numpy()
        if key[0] == key[1]:
            np.fill_diagonal(s, -np.inf)
        i, j, sim = _partners(s, threshold, k)
        out = [pd.DataFrame({"a": x[i], "b": y[j], "sim": sim})]
        if key[0] != key[1]:
            i, j, sim = _partners(s.T, threshold, k)
            out.append(pd.DataFrame({"a": y[i], "b": x[j], "sim": sim}))
        return pd.concat(out)

    near = left.groupBy("block", "other").cogroup(right.groupBy("block", "other")).applyInPandas(meet, "a long, b long, sim double")
    best = near.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), F.col("b").alias("b")))), 1, k).alias("p"))
    return best.select("a", F.posexplode("p").alias("place", "p")).select("a", "place", "p.b", (-F.col("p.s")).alias("sim"))


def _merge_all(unit: DataFrame, best: DataFrame, threshold: float) -> pd.DataFrame:
    """(cluster, into) of clusters that end in another, on the driver; best has each one's first PARTNERS partners."""
    t, near = unit.select("cluster", "c", "w").orderBy("cluster").toArrow(), best.toArrow()
    ids = t.column("cluster").to_numpy()
    if not len(ids):
        return pd.DataFrame({"cluster": np.zeros(0, np.int64), "into": np.zeros(0, np.int64)})
    u = t.column("c").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).copy()
    a, b = (np.searchsorted(ids, near.column(c).to_numpy()) for c in ("a", "b"))
    into = merge_rounds(u, t.column("w").to_numpy(), (a, near.column("place").to_numpy(), b, near.column("sim").to_numpy()), threshold)
    gone = into != np.arange(len(ids))
    return pd.DataFrame({"cluster": ids[gone], "into": ids[into[gone]]})


def merge_rounds(u: np.ndarray, w: np.ndarray, near: tuple[np.ndarray, ...], threshold: float, k: int = PARTNERS) -> np.ndarray:
    """The row that each row of unit vectors ends in; w: lengths of the rows' sums, near: (row, place, partner, cosine).

    Each row has a list of its best partners, and a floor that all partners off the list stand behind: its last entry,
    or the threshold if the list holds all. A merged row leaves all lists, meets all rows anew, and enters the lists
    where it is before the floor. A list that runs empty above its floor is made anew.
    """
    n = len(u)
    total, end, alive = u * w[:, None], np.arange(n), np.ones(n, bool)
    who, sim = np.full((n, k), -1), np.full((n, k), -np.inf)
    floor, floor_id = np.full(n, threshold), np.full(n, n)
    who[near[0], near[1]], sim[near[0], near[1]] = near[2], near[3]
    chunk = max(1, 4_000_000 // n)

    def lower(rows):
        """Full lists hold what is before their last entry, and maybe not all behind it."""
        full = rows[who[rows, -1] >= 0]
        floor[full], floor_id[full] = sim[full, -1], who[full, -1]

    def anew(rows):
        """Their lists by all rows; yields their cosines in pieces."""
        for at in range(0, len(rows), chunk):
            part = rows[at : at + chunk]
            s = u[part] @ u.T
            s[:, ~alive] = -np.inf
            s[np.arange(len(part)), part] = -np.inf
            who[part], sim[part], floor[part], floor_id[part] = -1, -np.inf, threshold, n
            i, j, x = _partners(s, threshold, k)
            place = np.arange(len(i)) - np.searchsorted(i, i)
            who[part[i], place], sim[part[i], place] = j, x
            lower(part)
            yield part, s

    lower(np.arange(n))
    while True:
        empty = np.nonzero(alive & (who[:, 0] < 0) & (floor_id < n))[0]
        for _ in anew(empty):
            pass
        best = who[:, 0]
        x = np.nonzero((best >= 0) & (best < np.arange(n)))[0]
        x = x[best[best[x]] == x]
        if not len(x):
            break
        y = best[x]
        total[y] += total[x]
        end[x], alive[x], who[x], sim[x] = y, False, -1, -np.inf
        u[y] = total[y] / np.maximum(np.sqrt((total[y] ** 2).sum(1)), 1e-300)[:, None]
        changed = np.zeros(n + 1, bool)
        changed[x] = changed[y] = True
        out = changed[who]
        rows = np.nonzero(out.any(1))[0]
        who[out], sim[out] = -1, -np.inf
        o = np.lexsort((who[rows], -sim[rows]), axis=1)
        who[rows], sim[rows] = np.take_along_axis(who[rows], o, 1), np.take_along_axis(sim[rows], o, 1)
        old = alive.copy()
        old[y] = False
        for part, s in anew(y):
            i, j = np.nonzero(s >= np.where(old, floor, np.inf) - 1e-8)
            z = np.round(s[i, j], 9)
            for r in np.unique(i):
                js, zs = j[i == r], z[i == r]
                before = (zs > floor[js]) | (zs == floor[js]) & (part[r] < floor_id[js])
                js, zs = js[before], zs[before]
                p, q = np.c_[who[js], np.full(len(js), part[r])], np.c_[sim[js], zs]
                o = np.lexsort((p, -q), axis=1)
                p, q = np.take_along_axis(p, o, 1), np.take_along_axis(q, o, 1)
                who[js], sim[js] = p[:, :k], q[:, :k]
                lower(js[p[:, k] >= 0])
    while (end != end[end]).any():
        end = end[end]
    return end


def rank_within(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
