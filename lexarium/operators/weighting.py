"""Term weights over posting tables (doc, term, tf)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarium.operators import tokens as T


def with_stats(post: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Postings with dl, dvl, cf, df, n_docs and n_tokens.

    Document statistics are windows over the document's own partition; the one-row collection statistics are
    broadcast, term statistics join on the term.
    """
    w = Window.partitionBy(doc)
    own = post.withColumns({"dl": F.sum("tf").over(w), "dvl": F.count("*").over(w)})
    one = T.collection_stats(post, doc)
    return own.join(T.term_stats(post), "term").crossJoin(F.broadcast(one))


def unit(df: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Weights divided by each document's Euclidean norm."""
    norm = F.sqrt(F.sum(F.col("weight") ** 2).over(Window.partitionBy(doc)))
    return df.withColumn("weight", F.when(norm == 0, 0.0).otherwise(F.col("weight") / norm))


def tfidf(stats: DataFrame, doc: str = "doc_id") -> DataFrame:
    return unit(stats.withColumn("weight", (F.ln("tf") + 1) * F.ln((F.col("n_docs") + 1) / F.col("df"))), doc)


def bm25(stats: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.col("dl") / (F.col("n_tokens") / F.col("n_docs"))
    return stats.withColumn("weight", idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length)))


def dfree(stats: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Divergence from randomness without parameters, then unit length."""
    tf, dl, prior, post = F.col("tf"), F.col("dl"), F.col("tf") / F.col("dl"), (F.col("tf") + 1) / (F.col("dl") + 1)
    inv = F.col("n_tokens") / F.col("cf")
    norm = tf * F.log2(post / prior)
    w = norm * (tf * (-F.log2(prior * inv)) + (tf + 1) * F.log2(post * inv) + 0.5 * F.log2(post / prior))
    return unit(stats.withColumn("weight", F.when(dl > 0, w)), doc)


def tf_rf(post: DataFrame, labels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """log2(2 + documents of the label with the term / max(1, others with it)) per label and term."""
    own = post.join(labels, doc).groupBy("label", "term").agg(F.count("*").alias("a"))
    total = F.sum("a").over(Window.partitionBy("term"))
    return own.withColumn("weight", F.log2(2 + F.col("a") / F.greatest(F.lit(1), total - F.col("a")))).drop("a")


def chi_square(a: Column, b: Column, c: Column, d: Column) -> Column:
    """n (ad - bc)^2 over the product of the margins of a 2 x 2 table; 0 where that is 0."""
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(margins == 0, 0.0).otherwise((a + b + c + d) * (a * d - b * c) ** 2 / margins)


def pmi(pxy: Column, px: Column, py: Column, normalized: bool = False) -> Column:
    value = F.log2(pxy / (px * py))
    return F.when((pxy <= 0) | (px <= 0) | (py <= 0), 0.0).otherwise(value / -F.log2(pxy) if normalized else value)


def min_max(df: DataFrame, feature: str, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    w = Window.partitionBy(feature)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(value, F.when(hi == lo, low).otherwise(low + (high - low) * (F.col(value) - lo) / (hi - lo)))
