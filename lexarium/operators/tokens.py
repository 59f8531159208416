"""Token, posting and statistics tables of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.functions.stemming import stems, strip_possessive
from lexarium.functions.strings import mask_numbers

#: Stop words of the default analyzer (fixed values).
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def analyze(text: Column, low: int = 2, high: int = 29, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Words of low to high characters that are no stop words."""
    return F.filter(words(text), lambda w: F.length(w).between(low, high) & ~w.isin(*stop))


def analyzed(docs: DataFrame, doc: str = "doc_id", text: str = "text", low: int = 2, high: int = 29, stop: tuple[str, ...] = STOPWORDS, stem: bool = True) -> DataFrame:
    """(doc, pos, term) after the whole analyzer: runs of letters, digits and inner apostrophes; possessive ends go;
    low to high characters; lower case; no stop words; Porter stems; digits masked. Positions count all tokens."""
    raw = docs.select(doc, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[\p{L}\p{N}]+(?:['\u2019\uff07][\p{L}\p{N}]+)*"), F.lit(0))).alias("pos", "term"))
    kept = raw.withColumn("term", strip_possessive(F.col("term"))).where(F.length("term").between(low, high)).withColumn("term", F.lower("term")).where(~F.col("term").isin(*stop))
    if stem:
        kept = kept.join(stems(kept), "term").select(doc, "pos", F.col("stem").alias("term"))
    return kept.withColumn("term", F.when(F.col("term").rlike("[0-9]"), mask_numbers(F.col("term"))).otherwise(F.col("term")))


def without_numbers(tokens: DataFrame, term: str = "term") -> DataFrame:
    """Tokens that hold no masked number."""
    return tokens.where(~F.contains(term, F.lit("<N")))


def sentences(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, sentence, text): split behind . ! or ? and white space before a capital, a digit or a quote."""
    marked = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"([.!?])\s+([\p{Lu}0-9\"'])", "$1\x01$2")
    parts = F.split(marked, r"\x01|\n+")
    return docs.select(doc, F.posexplode(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")).alias("sentence", "text"))


def treebank(text: Column) -> Column:
    """Tokens with punctuation, brackets, clitics and n't apart, after the treebank's conventions."""
    c = F.regexp_replace(text, r"([,;:@#$%&?!\[\](){}<>\"]|--|\.\.\.)", " $1 ")
    c = F.regexp_replace(c, r"\.(\s*)$", " .$1")
    c = F.regexp_replace(c, r"(?i)([\p{L}])(n't)\b", "$1 $2")
    c = F.regexp_replace(c, r"(?i)(\p{L})('(?:s|m|d|ll|re|ve))\b", "$1 $2")
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def tokens(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos, term), positions from 0."""
    return docs.select(doc, F.posexplode(words(F.col(text))).alias("pos", "term"))


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, term, tf); counted inside each document's partition before the shuffle."""
    return tokens(docs, doc, text).groupBy(doc, "term").agg(F.count("*").alias("tf"))


def doc_stats(post: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Length and vocabulary of each document."""
    return post.groupBy(doc).agg(F.sum("tf").alias("dl"), F.count("*").alias("dvl"))


def term_stats(post: DataFrame) -> DataFrame:
    """Collection and document frequency of each term."""
    return post.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def collection_stats(post: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row: documents, tokens, postings."""
    return doc_stats(post, doc).agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_tokens"), F.sum("dvl").alias("n_postings"))
