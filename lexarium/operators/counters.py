"""Weighted counters over one, two or three keys, as DataFrames with a ``cnt`` column.

A missing key counts 0 wherever two counters meet. Ties are broken by key, smallest first. Aggregations combine on
the map side; per-row totals are windows over the row's key, and grand totals are one-row aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.operators import tokens as T


def count(df: DataFrame, *keys: str, weight: str | Column | None = None) -> DataFrame:
    """Counts, or sums of a weight, by key."""
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    return df.groupBy(*keys).agg(F.sum(w).cast("double").alias("cnt"))


def merge(counters: list[tuple[DataFrame, float]], *keys: str) -> DataFrame:
    """Sum of counters, each times its scale."""
    parts = [c.select(*keys, (F.col("cnt") * s).alias("cnt")) for c, s in counters]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def difference(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """a - b over the keys of either."""
    return merge([(a, 1.0), (b, -1.0)], *keys)


def equal(a: DataFrame, b: DataFrame, *keys: str, tolerance: float = 0.0) -> DataFrame:
    """One row: whether all counts are within the tolerance."""
    return difference(a, b, *keys).agg(F.coalesce(F.bool_and(F.abs("cnt") <= tolerance), F.lit(True)).alias("equal"))


def lookup(keys: DataFrame, counter: DataFrame, *on: str, default: float = 0.0) -> DataFrame:
    return keys.join(counter, list(on), "left").withColumn("cnt", F.coalesce("cnt", F.lit(default)))


def normalize(counter: DataFrame, *within: str) -> DataFrame:
    """Shares of the total, or of the total of each row of a counter map; 0 where a total is 0."""
    if within:
        total = F.sum("cnt").over(Window.partitionBy(*within))
        return counter.withColumn("cnt", F.when(total == 0, 0.0).otherwise(F.col("cnt") / total))
    total = counter.agg(F.sum("cnt").alias("_t"))  # one row, so the join needs no shuffle
    return counter.crossJoin(F.broadcast(total)).withColumn("cnt", F.when(F.col("_t") == 0, 0.0).otherwise(F.col("cnt") / F.col("_t"))).drop("_t")


def discount(counter: DataFrame, d: float, *within: str) -> DataFrame:
    """Absolute discounting: (cnt - d) / total."""
    return counter.withColumn("cnt", (F.col("cnt") - d) / F.sum("cnt").over(Window.partitionBy(*within)))


def summary(counter: DataFrame, key: str) -> DataFrame:
    """Total, average, size, extremes and their keys."""
    return counter.agg(
        F.sum("cnt").alias("total"), F.avg("cnt").alias("average"), F.count("*").alias("size"), F.max("cnt").alias("max_cnt"), F.min("cnt").alias("min_cnt"),
        F.min(F.struct((-F.col("cnt")).alias("c"), F.col(key).alias("k")))["k"].alias("arg_max"), F.min(F.struct(F.col("cnt").alias("c"), F.col(key).alias("k")))["k"].alias("arg_min"),
    )


def top(counter: DataFrame, n: int, *keys: str, within: tuple[str, ...] = ()) -> DataFrame:
    """The n largest, of all or of each group; Spark takes these partially before it shuffles."""
    order = [F.desc("cnt"), *keys]
    if not within:
        return counter.orderBy(*order).limit(n)
    return counter.withColumn("_r", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def ranked(counter: DataFrame, *keys: str, within: tuple[str, ...] = ()) -> DataFrame:
    """1-based ranks by falling count within groups."""
    return counter.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("cnt"), *keys)))


def clamp(counter: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    c = F.col("cnt")
    c = c if low is None else F.greatest(c, F.lit(low))
    return counter.withColumn("cnt", c if high is None else F.least(c, F.lit(high)))


def totals(counter: DataFrame, *keys: str) -> DataFrame:
    """Totals of every prefix of the keys at once; missing keys are null, ``depth`` tells how many are set."""
    gid = F.grouping_id()
    return counter.rollup(*keys).agg(F.sum("cnt").alias("cnt"), (F.lit(len(keys)) - F.bit_count(gid.cast("long"))).cast("int").alias("depth"))


def group_list(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Each key's values as a list in order."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("items"))


def group_set(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("items"))


#: Ranges that keys are dealt to where ranks or running sums span all of them.
RANGES = 256


def _ranges(df: DataFrame, key: str) -> DataFrame:
    """_b: the range of each row's key among RANGES of about equal numbers of rows, by approximate quantiles."""
    edges = df.agg(F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 10_000).alias("_e"))
    return df.crossJoin(F.broadcast(edges)).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col(key)))).drop("_e")


def encode(df: DataFrame, key: str, order: str) -> DataFrame:
    """Dense ids from 0 by first use (least ``order``): bucket counts give offsets, so no task ranks all keys.

    Keys are dealt to ranges of first use of about equal size; ids are the rank in the range plus the sizes of those
    before.
    """
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    dealt = _ranges(first, "_first")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_o", before).drop("_n")  # RANGES rows
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_first", key)) - 1
    return dealt.withColumn("_r", rank).join(F.broadcast(sizes), "_b").select(key, (F.col("_r") + F.col("_o")).alias("id"))


def frequency_of_frequencies(counter: DataFrame) -> DataFrame:
    return counter.groupBy(F.col("cnt").alias("freq")).agg(F.count("*").alias("n"))


def sample(counter: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n draws with probability cnt / total: cumulative shares met by n seeded uniform numbers (n is small).

    Shares are summed within buckets of keys, whose sums give offsets, so no task holds all keys.
    """
    dealt = normalize(counter).withColumn("_b", F.pmod(F.xxhash64(key), F.lit(RANGES)))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sizes = dealt.groupBy("_b").agg(F.sum("cnt").alias("_s")).withColumn("_o", before).drop("_s")  # RANGES rows
    edges = Window.partitionBy("_b").orderBy(key)
    cdf = dealt.withColumn("_hi", F.sum("cnt").over(edges)).join(F.broadcast(sizes), "_b")
    cdf = cdf.withColumn("_hi", F.col("_hi") + F.col("_o")).withColumn("_lo", F.col("_hi") - F.col("cnt"))
    draws = counter.sparkSession.range(n).select(F.col("id").alias("draw"), F.rand(seed).alias("_u"))
    return cdf.join(F.broadcast(draws), (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).select("draw", key)


def bigrams(tokens: DataFrame, doc: str = "doc_id", pos: str = "pos", term: str = "term") -> DataFrame:
    """Counts of adjacent pairs."""
    nxt = F.lead(term).over(Window.partitionBy(doc).orderBy(pos))
    return tokens.select(F.col(term).alias("first"), nxt.alias("second")).where("second is not null").groupBy("first", "second").agg(F.count("*").cast("double").alias("cnt"))


def text_bigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of adjacent words of texts; pairs are made inside each row, so no token is dealt."""
    w = T.words(F.col(text))
    pairs = docs.select(w.alias("w")).select(F.explode(F.arrays_zip(F.col("w").alias("first"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("second"))).alias("p"))
    return pairs.where("p.second is not null").groupBy("p.first", "p.second").agg(F.count("*").cast("double").alias("cnt"))


def cooccurrences(tokens: DataFrame, window: int, weighted: bool = False, doc: str = "doc_id", pos: str = "pos", term: str = "term") -> DataFrame:
    """Ordered pairs at distance 1 to window - 1; weighted ones count window - distance + 1 each (window included).

    ``window`` lead expressions over one sort of each document, instead of a self-join.
    """
    w = Window.partitionBy(doc).orderBy(pos)
    far = window + 1 if weighted else window
    pairs = F.array(*[F.struct(F.lead(term, d).over(w).alias("second"), F.lit(float(window - d + 1 if weighted else 1)).alias("v")) for d in range(1, far)])
    return tokens.select(F.col(term).alias("first"), pairs.alias("ps")).select("first", F.explode("ps").alias("p")).where("p.second is not null").groupBy("first", F.col("p.second").alias("second")).agg(F.sum("p.v").alias("cnt"))


def folds(df: DataFrame, key: str, shares: list[float], seed: int = 11) -> DataFrame:
    """A fold number for each row by hash of its key: repeatable, and each fold's size is its share on average."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    edges, fold = 0.0, F.lit(len(shares) - 1)
    for i, s in enumerate(shares[:-1]):
        edges += s
        fold = F.when((u < edges) & (u >= edges - s), F.lit(i)).otherwise(fold)
    return df.withColumn("fold", fold)


def transpose(counter: DataFrame, outer: str, inner: str) -> DataFrame:
    """A counter map with its keys' places changed."""
    return counter.select(F.col(inner).alias(outer), F.col(outer).alias(inner), "cnt")


def inner_keys(counter: DataFrame, inner: str) -> DataFrame:
    return counter.select(inner).distinct()


def scale_row(counter: DataFrame, outer: str, key, factor: float) -> DataFrame:
    return counter.withColumn("cnt", F.when(F.col(outer) == key, F.col("cnt") * factor).otherwise(F.col("cnt")))


def text_form(counter: DataFrame, key: str, n: int, by_value: bool = True) -> DataFrame:
    """One row: the first n entries as 'key:count, ...', by falling count or by key."""
    order = [F.desc("cnt"), F.col(key)] if by_value else [F.col(key)]
    first = counter.orderBy(*order).limit(n)
    place = F.struct((-F.col("cnt")).alias("c"), F.col(key).alias("k")) if by_value else F.struct(F.col(key).alias("k"), (-F.col("cnt")).alias("c"))
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: F.concat_ws(":", x["k"].cast("string"), F.format_string("%.2f", -x["c"]))), ", ").alias("text"))


def translate(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``key`` replaced by its id in ``ids`` (key, id)."""
    return df.join(ids, key).drop(key)


def zipf(freqs: DataFrame) -> DataFrame:
    """One row: slope of ln frequency over ln rank, from a table of frequencies and how many words have each (freq, n)."""
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a frequency
    points = freqs.withColumn("rank", before + (F.col("n") + 1) / 2)
    return points.agg(F.regr_slope(F.ln("freq"), F.ln("rank")).alias("slope"))


def ngram_postings(tokens: DataFrame, n: int = 2, doc: str = "doc_id") -> DataFrame:
    """(gram, block, postings): 'doc:count' lists, documents in order; blocks are ranges of the sorted grams' heads."""
    w = Window.partitionBy(doc).orderBy("pos")
    grams = tokens.select(doc, F.concat_ws("_", "term", *[F.lead("term", k).over(w) for k in range(1, n)]).alias("gram"), F.lead("term", n - 1).over(w).alias("last")).where("last is not null")
    counts = grams.groupBy("gram", doc).agg(F.count("*").alias("c"))
    return counts.groupBy("gram").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(doc, "c"))), lambda x: F.concat_ws(":", x[doc].cast("string"), x["c"].cast("string"))), " ").alias("postings")).withColumn("block", F.substring("gram", 1, 1))
