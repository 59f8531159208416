"""String similarity search with pivotal prefixes.

A string's q-grams are ordered by document frequency, rarest first. Of strings within edit distance tau, with
q * tau + 1 grams each, both hold a common gram among these first q * tau + 1 (the prefix), and tau edits cannot
touch all of tau + 1 disjoint ones (the pivots), so a pivot of one meets the prefix of the other at a place that
differs by at most tau. Candidates come from an equi-join on the gram with these bands as residual predicates; the
verdict is Spark's thresholded Levenshtein. Strings with fewer grams meet by length instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexarium.functions.strings import qgrams


def grams(strings: DataFrame, q: int, sid: str = "sid", s: str = "s") -> DataFrame:
    """(sid, len, gram, start)."""
    return strings.select(sid, F.length(s).alias("len"), F.explode(qgrams(F.lower(F.col(s)), q)).alias("g")).select(sid, "len", "g.gram", "g.start")


def gram_weights(gram_table: DataFrame, kind: str = "idf", sid: str = "sid") -> DataFrame:
    """Weight of each gram: count with first place behind it, or ln((N + 1) / df)."""
    per = gram_table.groupBy("gram")
    if kind == "count":
        return per.agg((F.count("*") + F.min("start") / (F.max("start") + 1000.0)).alias("weight"))
    n = gram_table.select(sid).distinct().agg((F.count("*") + 1.0).alias("_n"))
    return per.agg(F.count_distinct(sid).alias("df")).crossJoin(F.broadcast(n)).select("gram", F.ln(F.col("_n") / F.col("df")).alias("weight"))


def prefixes(gram_table: DataFrame, order: DataFrame, q: int, tau: int, sid: str = "sid") -> DataFrame:
    """The first q * tau + 1 grams of each string, rarest first, with whether each is a pivot.

    Pivots are chosen greedily: a gram joins when it overlaps none chosen before it.
    """
    ranked = gram_table.join(order, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(sid).orderBy("df", "gram", "start"))
    first = ranked.withColumn("r", rank).where(F.col("r") <= q * tau + 1)
    lists = first.groupBy(sid, "len").agg(F.array_sort(F.collect_list(F.struct("r", "gram", "start"))).alias("prefix"))
    free = lambda acc, x: ~F.exists(acc, lambda y: F.abs(y - x["start"]) < q)
    pivots = F.aggregate("prefix", F.array().cast("array<int>"), lambda acc, x: F.when(free(acc, x) & (F.size(acc) <= tau), F.concat(acc, F.array(x["start"]))).otherwise(acc))
    return lists.withColumn("pivots", pivots).select(sid, "len", F.explode("prefix").alias("p"), "pivots").select(sid, "len", "p.gram", "p.start", F.array_contains("pivots", F.col("p.start")).alias("pivot"))


def search(queries: DataFrame, strings: DataFrame, q: int = 2, tau: int = 2) -> DataFrame:
    """(qid, sid, distance) of all pairs within edit distance tau; inputs are (qid, q) and (sid, s), compared lower-cased."""
    queries, strings = queries.select("qid", F.lower("q").alias("q")), strings.select("sid", F.lower("s").alias("s"))
    left, right = grams(queries, q, "qid", "q"), grams(strings, q)
    order = right.groupBy("gram").agg(F.count_distinct("sid").alias("df"))
    a = prefixes(left, order, q, tau, "qid").withColumnsRenamed({"len": "qlen", "start": "qstart", "pivot": "qpivot"})
    b = prefixes(right, order, q, tau)
    near = (F.abs(F.col("start") - F.col("qstart")) <= tau) & (F.abs(F.col("len") - F.col("qlen")) <= tau) & (F.col("pivot") | F.col("qpivot"))
    found = a.join(b, "gram").where(near).select("qid", "sid")
    short = q * tau + q - 1  # so long, a string has at most q * tau grams
    few = queries.where(F.length("q") <= short + tau).select("qid", F.explode(F.sequence(F.greatest(F.length("q") - tau, F.lit(0)), F.length("q") + tau)).alias("len"), F.length("q").alias("qlen"))
    small = few.join(strings.where(F.length("s") <= short + tau).select("sid", F.length("s").alias("len")), "len").where((F.col("qlen") <= short) | (F.col("len") <= short)).select("qid", "sid")
    pairs = found.union(small).distinct().join(queries, "qid").join(strings, "sid")
    return pairs.select("qid", "sid", F.levenshtein("q", "s", tau).alias("distance")).where("distance >= 0")


def identify(queries: DataFrame, names: DataFrame, q: int = 2, tau: int = 2) -> DataFrame:
    """Best entity of each query: names are (entity, sid, s) with several variants; similarity is 1 - distance / longer.

    Each entity counts by its best variant; ties go to the smaller entity.
    """
    hits = search(queries, names.select("sid", "s"), q, tau).join(names, "sid").join(queries, "qid")
    score = 1 - F.col("distance") / F.greatest(F.length("q"), F.length("s"), F.lit(1))
    best = hits.groupBy("qid", "entity").agg(F.max(score).alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "entity")))


def merge_entities(base: DataFrame, extra: DataFrame, key: str = "name") -> DataFrame:
    """Entities (name, variants) of two sources, met on the name without parenthesised parts; variants are united."""
    from lexarium.functions.strings import strip_parens

    a = base.select(strip_parens(F.col(key)).alias("name"), F.col("variants").alias("va"))
    b = extra.select(strip_parens(F.col(key)).alias("name"), F.col("variants").alias("vb"))
    empty = F.array().cast("array<string>")
    return a.join(b, "name", "full_outer").select("name", F.array_sort(F.array_union(F.coalesce("va", empty), F.coalesce("vb", empty))).alias("variants"))


def identification_scores(found: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Precision, recall and F1 at each k of ranked entities (qid, entity, rank) against (qid, entity)."""
    hits = found.join(truth.withColumn("_t", F.lit(1)), ["qid", "entity"], "left")
    n = truth.agg(F.count("*").alias("n"))
    k = found.sparkSession.createDataFrame([(x,) for x in ks], "k int")
    sums = k.crossJoin(hits).where("rank <= k").groupBy("k").agg(F.count("*").alias("given"), F.sum(F.coalesce("_t", F.lit(0))).alias("good")).crossJoin(n)
    p, r = F.col("good") / F.col("given"), F.col("good") / F.col("n")
    return sums.select("k", p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))
