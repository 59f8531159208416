"""Ranked retrieval over posting tables.

Query models are (qid, term, p). Only matching postings meet a query: the part of a smoothed score that terms
outside a document add depends on the document's length alone, so it is worked out per query and added back
instead of crossing queries with documents.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexarium.functions.arrays import digamma
from lexarium.operators import tokens as T
from lexarium.session import cut, shared_dir, small, stored


class Index:
    """Postings with term and document statistics of a collection, written once and read by every query.

    Postings lie in ranges of terms and carry their document's length (dl) and vocabulary (dvl), so a query scans its
    terms' postings and joins nothing else. Without a path the tables go to the shared folder.
    """

    def __init__(self, docs: DataFrame, doc: str = "doc_id", text: str = "text", path: str | None = None):
        path = path or f"{shared_dir(docs.sparkSession)}/index-{uuid.uuid4().hex}"
        post = T.postings(docs.select(doc, text).repartition(doc), doc, text)  # dealt once, as texts, which are smaller than postings
        own = Window.partitionBy(doc)
        full = post.withColumns({"dl": F.sum("tf").over(own), "dvl": F.count("*").over(own)})
        full.repartitionByRange(F.col("term")).sortWithinPartitions("term", doc).write.parquet(f"{path}/postings")
        self._open(docs.sparkSession, path, doc)
        T.term_stats(self.post).write.parquet(f"{path}/terms")
        self.post.select(doc, "dl", "dvl").distinct().write.parquet(f"{path}/docs")
        self._open(docs.sparkSession, path, doc, whole=True)

    @classmethod
    def load(cls, spark: SparkSession, path: str, doc: str = "doc_id") -> Index:
        """An index written earlier."""
        index = cls.__new__(cls)
        index._open(spark, path, doc, whole=True)
        return index

    def _open(self, spark: SparkSession, path: str, doc: str, whole: bool = False) -> None:
        self.path, self.doc, self.post = path, doc, spark.read.parquet(f"{path}/postings")
        if whole:
            self.terms, self.docs = spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/docs")
            self.total = cut(self.docs.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_tokens"), F.sum("dvl").alias("n_postings")))  # one row

    def known(self, model: DataFrame) -> DataFrame:
        """Query terms with their statistics; a small table is broadcast to the postings."""
        return small(model.join(self.terms, "term").crossJoin(F.broadcast(self.total)))

    def matches(self, model: DataFrame) -> DataFrame:
        """Query terms with their postings and all statistics."""
        return self.post.join(self.known(model), "term")


def query_model(queries: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
    """Each query's relative term frequencies."""
    tf = T.tokens(queries, qid, text).groupBy(F.col(qid).alias("qid"), "term").agg(F.count("*").alias("tf"))
    return tf.select("qid", "term", (F.col("tf") / F.sum("tf").over(Window.partitionBy("qid"))).alias("p"))


def level(score: Column | str) -> Column:
    """A positive score's logarithm to 11 places: sums of the same parts in another order are the same level."""
    return F.round(F.ln(score), 11)


def exact(part: Column | str) -> Column:
    """A sum to 2^-50 that no order of its rows changes, as of integers; above 8,000 or so it raises."""
    return F.sum(F.rint((F.col(part) if isinstance(part, str) else part) * 2.0**50).cast("long")) / F.lit(2.0**50)


def best(scores: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    """The k best documents of each query, ranked; ties go to the smaller document."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), doc))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def likelihood(index: Index, model: DataFrame, mu: float = 2000.0) -> DataFrame:
    """Dirichlet query likelihood, a term's part never below 0."""
    pc = (F.col("cf") + 1) / (F.col("n_tokens") + 1)
    part = F.greatest(F.lit(0.0), F.ln(1 + F.col("tf") / (mu * pc)) + F.ln(mu / (F.col("dl") + mu)))
    return index.matches(model).groupBy("qid", index.doc).agg(F.sum(F.col("p") * part).alias("score"))


def divergence(index: Index, model: DataFrame, mu: float = 2000.0) -> DataFrame:
    """exp of minus the divergence of the query model from each matching document's smoothed model. Copies score exactly alike."""
    pc = F.col("cf") / F.col("n_tokens")
    model = cut(model)
    base = index.known(model).groupBy("qid").agg(exact(F.col("p") * F.ln(F.col("p") / (mu * pc))).alias("base"), exact("p").alias("mass"))
    own = index.matches(model).groupBy("qid", index.doc, "dl").agg(exact(F.col("p") * F.ln(1 + F.col("tf") / (mu * pc))).alias("m"))
    return own.join(base, "qid").select("qid", index.doc, F.exp(F.col("m") - F.col("base") - F.col("mass") * F.ln(F.col("dl") + mu)).alias("score"))


def bm25(index: Index, model: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") * F.col("n_docs") / F.col("n_tokens")))
    return index.matches(model).groupBy("qid", index.doc).agg(F.sum(F.col("p") * idf * tf).alias("score"))


def spud(index: Index, model: DataFrame, omega: float = 0.8, b0: float = 500.0) -> DataFrame:
    """Polya (Dirichlet compound) model: background by document frequency, document mass by its vocabulary."""
    mu = b0 / (1 / omega - 1)
    pc = (F.col("df") + 1) / (F.col("n_postings") + 1)
    part = F.ln(1 + F.col("tf") * F.col("dvl") / (F.col("dl") * mu * pc))
    length = F.ln(mu / (F.first("dvl") + mu))
    return index.matches(model).groupBy("qid", index.doc).agg((F.sum(F.col("p") * part) + length).alias("score"))


def relevance_model(index: Index, ranked: DataFrame, docs: int = 5, words: int = 20, mu: float = 2000.0) -> DataFrame:
    """RM1: score-weighted smoothed word probabilities of the best documents; the best words, normalized, ties by term."""
    feed = index.post.join(small(ranked.where(F.col("rank") <= docs).select("qid", index.doc, "score")), index.doc).join(index.terms, "term").crossJoin(F.broadcast(index.total))
    p = (F.col("tf") + mu * F.col("cf") / F.col("n_tokens")) / (F.col("dl") + mu)
    model = feed.groupBy("qid", "term").agg(F.sum(F.col("score") * p).alias("w"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(level("w").desc(), "term"))
    top = model.withColumn("r", rank).where(F.col("r") <= words)
    return top.select("qid", "term", (F.col("w") / F.sum("w").over(Window.partitionBy("qid"))).alias("p"))


def mixture(models: list[tuple[DataFrame, float]]) -> DataFrame:
    """Sum of coefficient times model."""
    parts = [m.select("qid", "term", (F.col("p") * c).alias("p")) for m, c in models]
    return reduce(DataFrame.unionByName, parts).groupBy("qid", "term").agg(F.sum("p").alias("p"))


def feedback(index: Index, model: DataFrame, first: int = 1000, docs: int = 5, words: int = 20, mix: float = 0.5, mu: float = 2000.0) -> DataFrame:
    """RM3: rank, mix the relevance model into the query, rank again."""
    ranked = best(divergence(index, model, mu), first, index.doc)
    return divergence(index, mixture([(model, mix), (relevance_model(index, ranked, docs, words, mu), 1 - mix)]), mu)


def expand(model: DataFrame, translations: DataFrame) -> DataFrame:
    """Half of a term's mass goes to its translations (term, other, weight summing to 1); others keep all."""
    hit = model.join(translations, "term", "left")
    own = model.join(translations.select("term").distinct().withColumn("h", F.lit(0.5)), "term", "left").select("qid", "term", (F.col("p") * F.coalesce("h", F.lit(1.0))).alias("p"))
    new = hit.where("other is not null").select("qid", F.col("other").alias("term"), (F.col("p") * 0.5 * F.col("weight")).alias("p"))
    return own.unionByName(new).groupBy("qid", "term").agg(F.sum("p").alias("p"))


def parsimonious(post: DataFrame, terms: DataFrame, total: DataFrame, rounds: int = 5, lam: float = 0.1, doc: str = "doc_id") -> DataFrame:
    """Document models with what the collection explains taken out, by expectation-maximisation."""
    w = Window.partitionBy(doc)
    df = post.join(terms, "term").crossJoin(F.broadcast(total)).select(doc, "term", "tf", (F.col("cf") / F.col("n_tokens")).alias("pc"))
    df = df.withColumn("p", F.col("tf") / F.sum("tf").over(w))
    for _ in range(rounds):
        df = df.withColumn("e", F.col("tf") * lam * F.col("p") / (lam * F.col("p") + (1 - lam) * F.col("pc"))).withColumn("p", F.col("e") / F.sum("e").over(w))
    return df.select(doc, "term", "p")


def priors(post: DataFrame, terms: DataFrame, total: DataFrame, mu: float = 2000.0, doc: str = "doc_id") -> DataFrame:
    """Document priors from the mean log probability of their words, normalized over all documents."""
    w = Window.partitionBy(doc)
    p = (F.col("tf") + mu * F.col("cf") / F.col("n_tokens")) / (F.col("dl") + mu)
    logs = post.withColumn("dl", F.sum("tf").over(w)).join(terms, "term").crossJoin(F.broadcast(total)).groupBy(doc).agg(F.avg(F.ln(p)).alias("l"))
    top = logs.agg(F.max("l").alias("m"), F.expr("max(l) + ln(sum(exp(l)))").alias("unused")).select("m")
    shifted = logs.crossJoin(F.broadcast(top)).withColumn("e", F.exp(F.col("l") - F.col("m"))).drop("m")
    return shifted.crossJoin(F.broadcast(shifted.agg(F.sum("e").alias("s")))).select(doc, (F.col("e") / F.col("s")).alias("prior"))


def random_walk(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """Centrality on (src, dst, w): damped power iteration from uniform scores; dangling mass is spread evenly.

    The edges are dealt by source once and kept in that many files, so no round deals them again.
    """
    spark = edges.sparkSession
    name = f"walk_{uuid.uuid4().hex}"
    out = edges.select("src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("w"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out.repartition(parts, "src").write.bucketBy(parts, "src").sortBy("src").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    flow = spark.table(name)
    nodes = flow.select(F.col("src").alias("node")).distinct().withColumn("out", F.lit(True))
    base = stored(flow.select(F.col("dst").alias("node")).distinct().join(nodes, "node", "full"))
    n = base.count()
    rank = base.withColumn("score", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("score"))), F.lit(0.0)).alias("lost"))
        got = flow.join(rank.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("score")).alias("got"))
        new = base.join(got, "node", "left").crossJoin(F.broadcast(lost)).select("node", "out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("score"))
        rank = cut(new)  # used twice in the next round
    spark.sql(f"DROP TABLE {name}")  # its files stay with the other tables of the shared folder
    return rank.select("node", "score")


def concept_vectors(model: DataFrame, weights: DataFrame, top: int = 200) -> DataFrame:
    """Semantic analysis: sum of p(w) times weight(w, concept), the best concepts of each query."""
    sums = model.join(weights, "term").groupBy("qid", "concept").agg(F.round(F.sum(F.col("p") * F.col("weight")), 9).alias("weight"))  # rounded, so that ties are ties
    return sums.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("weight"), "concept"))).where(F.col("r") <= top).drop("r")


def passages(tokens: DataFrame, model: DataFrame, length: int = 50, doc: str = "doc_id", mu: float = 50.0) -> DataFrame:
    """The best fixed passage of each document: query mass of its tokens, smoothed by its length."""
    t = tokens.withColumn("passage", F.floor(F.col("pos") / length))
    scored = t.join(model, "term").groupBy("qid", doc, "passage").agg(F.round(F.sum("p") / (F.lit(length) + mu), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid", doc).orderBy(F.desc("score"), "passage"))
    return scored.withColumn("r", rank).where("r = 1").drop("r")


def proximity(tokens: DataFrame, model: DataFrame, doc: str = "doc_id") -> DataFrame:
    """1 / (1 + mean distance of neighbouring occurrences of different query terms) for each query and document."""
    w = Window.partitionBy("qid", doc).orderBy("pos")
    near = tokens.join(model, "term").withColumns({"t2": F.lead("term").over(w), "d": F.lead("pos").over(w) - F.col("pos")})
    return near.where("t2 is not null and t2 <> term").groupBy("qid", doc).agg((1 / (1 + F.avg("d"))).alias("score"))


def collections_model(indexes: list[Index], model: DataFrame, docs: int = 5, words: int = 25, mu: float = 2000.0) -> DataFrame:
    """Expansion model from several collections: their relevance models, weighted by the mean score of their best documents."""
    parts = None
    for i, index in enumerate(indexes):
        ranked = cut(best(divergence(index, model, mu), docs, index.doc))
        weight = ranked.groupBy("qid").agg(F.avg("score").alias("w"))
        part = relevance_model(index, ranked, docs, words, mu).join(weight, "qid").withColumn("coll", F.lit(i))
        parts = part if parts is None else parts.unionByName(part)
    parts = cut(parts)
    total = parts.select("qid", "coll", "w").distinct().groupBy("qid").agg(F.sum("w").alias("t"))
    return parts.join(total, "qid").groupBy("qid", "term").agg(F.sum(F.col("p") * F.col("w") / F.col("t")).alias("p"))


def cluster_likelihood(index: Index, model: DataFrame, clusters: DataFrame, lam: float = 0.7, mu: float = 2000.0) -> DataFrame:
    """Query likelihood of documents smoothed by their cluster (doc, cluster), and that by the collection."""
    member = index.post.join(clusters, index.doc)
    size = member.groupBy("cluster").agg(F.sum("tf").alias("cl"))
    own = member.groupBy("cluster", "term").agg(F.sum("tf").alias("ctf")).join(size, "cluster")
    base = model.join(index.terms, "term").crossJoin(F.broadcast(index.total)).withColumn("pc", F.col("cf") / F.col("n_tokens"))
    grounds = base.join(own, "term", "left").withColumn("pg", lam * F.coalesce(F.col("ctf") / F.col("cl"), F.lit(0.0)) + (1 - lam) * F.col("pc"))
    hits = member.join(grounds.select("qid", "term", "cluster", "p", "pg"), ["term", "cluster"])
    return hits.groupBy("qid", index.doc).agg(F.sum(F.col("p") * F.ln(1 + F.col("tf") / (mu * F.col("pg")))).alias("score"))


def background_mass(docs: DataFrame, rounds: int = 20) -> float:
    """Concentration of a Dirichlet compound model from document lengths and vocabularies (dl, dvl).

    The expected vocabulary of a length-n document under concentration b is b (digamma(b + n) - digamma(b)); the fixed
    point that gives the observed total is found on one-row aggregates by length, so a round is a small job.
    """
    lengths = cut(docs.groupBy("dl").agg(F.count("*").alias("n"), F.sum("dvl").alias("v")))
    b = 100.0
    for _ in range(rounds):
        gain = digamma(F.lit(b) + F.col("dl")) - digamma(F.lit(b))
        s = lengths.agg(F.sum("v").alias("v"), F.sum(F.col("n") * gain).alias("g")).first()
        if not s.g:
            return b
        b = max(1.0, s.v / s.g)
    return b
