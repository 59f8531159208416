"""Passages, positions and the feedback models built on them.

Everything starts from positional tokens (doc, pos, term) cut down to query terms or to feedback documents before any
pair of positions is made, so pairs grow with the matches of one document, not with the collection.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexarium.operators import learning as L
from lexarium.operators import retrieval as R
from lexarium.session import cut, small


def spread(sigma: float, kind: str) -> list[float]:
    """A propagation kernel's values at distances 0, 1, ... up to where they vanish."""
    reach = int(6 * sigma) if kind == "gaussian" else int(sigma)
    out = []
    for d in range(reach + 1):
        x = d / sigma
        out.append({"gaussian": math.exp(-x * x / 2), "triangle": 1 - x, "cosine": (1 + math.cos(math.pi * x)) / 2, "circle": math.sqrt(max(0.0, 1 - x * x)), "arc": 1 - math.sqrt(max(0.0, 1 - (1 - x) ** 2)), "passage": 1.0}[kind])
    return out


def locations(tokens: DataFrame, model: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(qid, doc, pos, term, p): where query terms stand in documents; the small model is broadcast."""
    return tokens.join(small(model.select("qid", "term", "p")), "term").select("qid", doc, "pos", "term", "p")


def passage_divergence(index: R.Index, tokens: DataFrame, model: DataFrame, length: int = 50, mu: float = 50.0) -> DataFrame:
    """Each document's best fixed passage by exp of minus the divergence of the query from the smoothed passage."""
    own = tokens.withColumn("passage", F.floor(F.col("pos") / length).cast("int"))
    size = own.groupBy(index.doc, "passage").agg(F.count("*").alias("pl"))
    known = index.known(model)
    base = known.groupBy("qid").agg(F.sum(F.col("p") * F.ln(F.col("p") * F.col("n_tokens") / (mu * F.col("cf")))).alias("base"), F.sum("p").alias("mass"))
    tf = own.join(known, "term").groupBy("qid", index.doc, "passage", "term").agg(F.count("*").alias("ptf"), F.first("p").alias("p"), F.first(F.col("cf") / F.col("n_tokens")).alias("pc"))
    m = tf.groupBy("qid", index.doc, "passage").agg(F.sum(F.col("p") * F.ln(1 + F.col("ptf") / (mu * F.col("pc")))).alias("m"))
    score = F.exp(F.col("m") - F.col("base") - F.col("mass") * F.ln(F.col("pl") + mu))
    scored = m.join(size, [index.doc, "passage"]).join(base, "qid").select("qid", index.doc, "passage", F.round(score, 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid", index.doc).orderBy(F.desc("score"), "passage"))
    return scored.withColumn("r", rank).where("r = 1").drop("r")


def positional_divergence(index: R.Index, tokens: DataFrame, model: DataFrame, sigma: float = 25.0, kind: str = "triangle", mu: float = 200.0) -> DataFrame:
    """Best positional language model of each document: counts propagated to each query-term occurrence by a kernel.

    A centre's propagated counts are sums of kernel values over the query terms around it, and its length is the sum
    over all positions of the document, which a table of running kernel sums gives without visiting them.
    """
    k = spread(sigma, kind)
    values, sums = F.array(*[F.lit(x) for x in k]), F.array(*[F.lit(math.fsum(k[: i + 1])) for i in range(len(k))])
    reach = len(k) - 1
    known = index.known(model)
    base = known.groupBy("qid").agg(F.sum(F.col("p") * F.ln(F.col("p") * F.col("n_tokens") / (mu * F.col("cf")))).alias("base"), F.sum("p").alias("mass"))
    hits = cut(tokens.join(known, "term").select("qid", index.doc, "pos", "term", "p", (F.col("cf") / F.col("n_tokens")).alias("pc")))
    centres = hits.select("qid", index.doc, F.col("pos").alias("centre"), (F.col("pos") / (reach + 1)).cast("int").alias("cell")).withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    near = centres.join(hits.withColumn("cell", (F.col("pos") / (reach + 1)).cast("int")), ["qid", index.doc, "cell"]).where(F.abs(F.col("pos") - F.col("centre")) <= reach)
    c = near.groupBy("qid", index.doc, "centre", "term").agg(F.sum(F.get(values, F.abs(F.col("pos") - F.col("centre")))).alias("c"), F.first("p").alias("p"), F.first("pc").alias("pc"))
    m = c.groupBy("qid", index.doc, "centre").agg(F.sum(F.col("p") * F.ln(1 + F.col("c") / (mu * F.col("pc")))).alias("m"))
    side = lambda n: F.get(sums, F.least(n, F.lit(reach)).cast("int"))
    z = side(F.col("centre")) + side(F.col("dl") - 1 - F.col("centre")) - 1.0
    scored = m.join(index.docs.select(index.doc, "dl"), index.doc).join(base, "qid").select("qid", index.doc, "centre", F.round(F.exp(F.col("m") - F.col("base") - F.col("mass") * F.ln(z + mu)), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid", index.doc).orderBy(F.desc("score"), "centre"))
    return scored.withColumn("r", rank).where("r = 1").drop("r")


def runs(locations: DataFrame, gap: int = 10, doc: str = "doc_id") -> DataFrame:
    """(qid, doc, first, last, hits): maximal passages whose query terms stand at most ``gap`` apart."""
    w = Window.partitionBy("qid", doc).orderBy("pos")
    new = F.when(F.col("pos") - F.lag("pos").over(w) <= gap, 0).otherwise(1)
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = locations.withColumn("new", new).withColumn("island", island)
    return marked.groupBy("qid", doc, "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("hits")).drop("island")


def passage_relevance_model(index: R.Index, ranked: DataFrame, passages: DataFrame, docs: int = 5, words: int = 20, mu: float = 2000.0, mix: float | None = None) -> DataFrame:
    """RM1 whose document weights come from passage scores (qid, doc, score): exp of the score, or mixed with the rank's.

    With ``mix``, the weight is (1 - mix) of the document's score and mix of it times exp(passage score).
    """
    psg = passages.select("qid", index.doc, F.exp("score").alias("w"))
    top = ranked.where(F.col("rank") <= docs).join(psg, ["qid", index.doc])
    weight = F.col("w") if mix is None else F.col("score") * ((1 - mix) + mix * F.col("w"))
    return R.relevance_model(index, top.select("qid", index.doc, "rank", weight.alias("score")), docs, words, mu)


def top_words(weights: DataFrame, words: int) -> DataFrame:
    """The best ``words`` of (qid, term, w), normalized; weights are rounded, so that ties are ties and go by term."""
    rounded = weights.withColumn("w", F.round("w", 12))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("w"), "term"))
    top = rounded.withColumn("r", rank).where(F.col("r") <= words)
    return top.select("qid", "term", (F.col("w") / F.sum("w").over(Window.partitionBy("qid"))).alias("p"))


def _around(index: R.Index, ranked: DataFrame, tokens: DataFrame, model: DataFrame, docs: int, reach: int) -> DataFrame:
    """Tokens of the best documents within ``reach`` of a query term: qid, doc, score, term, pos, query term, distance."""
    feed = tokens.join(small(ranked.where(F.col("rank") <= docs).select("qid", index.doc, "score")), index.doc)
    hits = feed.join(small(model.select("qid", F.col("term").alias("q"))), "qid").where("term = q").select("qid", index.doc, F.col("pos").alias("at"), "q")
    cells = hits.withColumn("cell", F.explode(F.array(*[(F.col("at") / (reach + 1)).cast("int") + d for d in (-1, 0, 1)])))
    near = feed.withColumn("cell", (F.col("pos") / (reach + 1)).cast("int")).join(cells, ["qid", index.doc, "cell"])
    return near.withColumn("d", F.abs(F.col("pos") - F.col("at"))).where(F.col("d") <= reach)


def positional_relevance_model(index: R.Index, ranked: DataFrame, tokens: DataFrame, model: DataFrame, docs: int = 5, words: int = 20, sigma: float = 5.0, lam: float = 0.5) -> DataFrame:
    """Words of the best documents weighted by Gaussian closeness to query terms, mixed with the collection model."""
    k = spread(sigma, "gaussian")
    values = F.array(*[F.lit(x) for x in k])
    near = _around(index, ranked, tokens, model, docs, len(k) - 1)
    own = near.groupBy("qid", index.doc, "term").agg(F.sum(F.get(values, F.col("d").cast("int"))).alias("c"), F.first("score").alias("score"))
    total = F.sum("c").over(Window.partitionBy("qid", index.doc))
    p = own.withColumn("t", total).join(index.terms, "term").crossJoin(F.broadcast(index.total))
    weight = F.col("score") * ((1 - lam) * F.col("c") / F.col("t") + lam * F.col("cf") / F.col("n_tokens"))
    return top_words(p.groupBy("qid", "term").agg(F.sum(weight).alias("w")), words)


def proximity_relevance_model(index: R.Index, ranked: DataFrame, tokens: DataFrame, model: DataFrame, docs: int = 5, words: int = 20, window: int = 2) -> DataFrame:
    """Words near query terms: (window - distance + 1) times both idfs, times the document's score."""
    near = _around(index, ranked, tokens, model, docs, window).where("term <> q and d > 0")
    idf = index.terms.crossJoin(F.broadcast(index.total)).select("term", F.ln((F.col("n_docs") + 1) / F.col("df")).alias("idf"))
    both = near.join(idf, "term").join(idf.select(F.col("term").alias("q"), F.col("idf").alias("qidf")), "q")
    return top_words(both.groupBy("qid", "term").agg(F.sum(F.col("score") * (window - F.col("d") + 1) * F.col("idf") * F.col("qidf")).alias("w")), words)


def multi_field_model(fields: list[tuple[R.Index, float]], model: DataFrame, docs: int = 15, words: int = 10, mu: float = 2000.0) -> DataFrame:
    """Relevance models of several fields' indexes, mixed by the fields' weights (normalized)."""
    total = sum(w for _, w in fields)
    parts = []
    for index, weight in fields:
        ranked = cut(R.best(R.divergence(index, model, mu).withColumn("score", F.round("score", 12)), docs, index.doc))
        parts.append((R.relevance_model(index, ranked, docs, words, mu), weight / total))
    return R.mixture(parts)


def document_graph(index: R.Index, ranked: DataFrame, docs: int = 20, top: int = 10, mu: float = 2000.0) -> DataFrame:
    """(qid, src, dst, w): each ranked document's most similar others of its ranking by exp of minus the divergence.

    The divergence needs only the source's own words: for each, the target's smoothed probability is looked up. Pairs
    are those of one query's best documents.
    """
    d = index.doc
    feed = cut(index.post.join(small(ranked.where(F.col("rank") <= docs).select("qid", d)), d).join(index.terms, "term").crossJoin(F.broadcast(index.total)).select("qid", d, "term", "tf", "dl", (F.col("cf") / F.col("n_tokens")).alias("pc")))
    src = feed.select("qid", F.col(d).alias("src"), "term", (F.col("tf") / F.col("dl")).alias("ps"), "pc")
    dst = feed.select("qid", F.col(d).alias("dst"), "term", F.col("tf").alias("td"))
    lengths = feed.select("qid", F.col(d).alias("dst"), F.col("dl").alias("dd")).distinct()
    # sum of ps ln(ps (dd + mu) / (td + mu pc)): the part without td, and what matching words add
    alone = src.groupBy("qid", "src").agg(R.exact(F.col("ps") * F.ln(F.col("ps") / (mu * F.col("pc")))).alias("a"))
    match = src.join(dst, ["qid", "term"]).where("src <> dst").groupBy("qid", "src", "dst").agg(R.exact(F.col("ps") * F.ln(1 + F.col("td") / (mu * F.col("pc")))).alias("m"))
    w = match.join(alone, ["qid", "src"]).join(lengths, ["qid", "dst"]).select("qid", "src", "dst", F.round(F.exp(F.col("m") - F.col("a") - F.ln(F.col("dd") + mu)), 12).alias("w"))
    rank = F.row_number().over(Window.partitionBy("qid", "src").orderBy(F.desc("w"), "dst"))
    return w.withColumn("r", rank).where(F.col("r") <= top).drop("r")


def centrality(graph: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(qid, node, score): damped walks over every query's graph at once, from uniform scores."""
    nodes = graph.select("qid", F.col("src").alias("node")).union(graph.select("qid", "dst")).distinct()
    base = cut(nodes.withColumn("n", F.count("*").over(Window.partitionBy("qid"))))
    flow = cut(graph.select("qid", "src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("qid", "src"))).alias("w")))
    rank = base.select("qid", "node", (F.lit(1.0) / F.col("n")).alias("score"))
    for _ in range(rounds):
        got = flow.join(rank.withColumnRenamed("node", "src"), ["qid", "src"]).groupBy("qid", F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("score")).alias("got"))
        rank = cut(base.join(got, ["qid", "node"], "left").select("qid", "node", ((1 - damping) / F.col("n") + damping * F.coalesce("got", F.lit(0.0))).alias("score")))
    return rank


def vector_expansion(model: DataFrame, weights: DataFrame, vectors: DataFrame, words: int = 5, least: float = 0.5) -> DataFrame:
    """Query models with up to ``words`` unseen words whose unit vector has a product of ``least`` with the query's.

    ``weights`` are (term, idf), ``vectors`` (term, v) of unit length. New words get the mean weight of the query's.
    """
    cells = model.join(weights, "term").join(vectors, "term").select("qid", F.posexplode("v").alias("k", "x"), (F.col("p") * F.col("idf")).alias("w"))
    sums = cells.groupBy("qid", "k").agg(F.sum(F.col("x") * F.col("w")).alias("x")).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda c: c["x"]).alias("q"))
    seen = model.groupBy("qid").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    near = L.products(vectors.where(~F.col("term").rlike("[0-9]")), sums, ["qid"], "term", "v", words + seen, least, scaled=False).withColumnRenamed("found", "term")
    new = near.join(model.select("qid", "term"), ["qid", "term"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "term"))
    mean = model.groupBy("qid").agg(F.avg("p").alias("p"))
    added = new.withColumn("r", rank).where(F.col("r") <= words).join(mean, "qid").select("qid", "term", "p")
    both = model.select("qid", "term", "p").unionByName(added)
    return both.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("qid")))


def concept_rerank(ranked: DataFrame, query_concepts: DataFrame, doc_concepts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Scores times the cosine of the query's and the document's concept vectors (…, concept, weight)."""
    norm = lambda df, key: df.groupBy(*key).agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n"))
    a, b = query_concepts.select("qid", "concept", F.col("weight").alias("x")), doc_concepts.select(doc, "concept", F.col("weight").alias("y"))
    dots = ranked.select("qid", doc, "score").join(a, "qid").join(b, [doc, "concept"]).groupBy("qid", doc, "score").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    both = dots.join(norm(query_concepts, ["qid"]), "qid").join(norm(doc_concepts, [doc]).withColumnRenamed("n", "m"), doc)
    return both.select("qid", doc, (F.col("score") * F.col("dot") / (F.col("n") * F.col("m"))).alias("score"))


def cross_collection_model(indexes: list[R.Index], model: DataFrame, docs: int = 5, words: int = 25, mu: float = 2000.0, lam: float = 0.5) -> DataFrame:
    """CBEEM: each collection's relevance model with two-level smoothing, weighted by its best documents' mean score.

    A document's words are smoothed by ``lam`` of its own collection and 1 - lam of all collections together.
    """
    cf = reduce(DataFrame.unionByName, [i.terms.select("term", "cf") for i in indexes]).groupBy("term").agg(F.sum("cf").alias("all_cf"))
    n = sum(i.total.first().n_tokens or 0 for i in indexes)  # one row each
    parts = []
    for c, i in enumerate(indexes):
        ranked = cut(R.best(R.divergence(i, model, mu).withColumn("score", F.round("score", 12)), docs, i.doc))
        feed = i.post.join(small(ranked.select("qid", i.doc, "score")), i.doc).join(i.terms, "term").join(cf, "term").crossJoin(F.broadcast(i.total))
        pc = lam * F.col("cf") / F.col("n_tokens") + (1 - lam) * F.col("all_cf") / n
        own = feed.groupBy("qid", "term").agg(F.sum(F.col("score") * (F.col("tf") + mu * pc) / (F.col("dl") + mu)).alias("w"))
        weight = ranked.groupBy("qid").agg(F.avg("score").alias("c"))
        parts.append(top_words(own, words).join(weight, "qid").withColumn("coll", F.lit(c)))
    both = cut(reduce(DataFrame.unionByName, parts))
    total = both.select("qid", "coll", "c").distinct().groupBy("qid").agg(F.sum("c").alias("t"))
    return top_words(both.join(total, "qid").groupBy("qid", "term").agg(F.sum(F.col("p") * F.col("c") / F.col("t")).alias("w")), words)
