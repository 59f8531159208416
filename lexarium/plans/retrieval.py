"""Term weighting and ranked retrieval; benchmark texts are the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexarium.operators import blocks as B
from lexarium.operators import retrieval as R
from lexarium.operators import tokens as T
from lexarium.operators import weighting as W
from lexarium.plans.counters import TOK, WORDS
from lexarium.plans.registry import query
from lexarium.session import cut

POST = f"""{TOK}, post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), ds AS (SELECT doc_id, sum(tf) AS dl, count(*) AS dvl FROM post GROUP BY 1),
ts AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM post GROUP BY 1), tot AS (SELECT count(*) AS n_docs, sum(dl) AS n_tokens, sum(dvl) AS n_postings FROM ds),
st AS (SELECT * FROM post JOIN ds USING (doc_id) JOIN ts USING (term), tot)"""
QM = f"""qt AS (SELECT item_id AS qid, term, count(*) AS tf FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY ALL),
qm AS (SELECT qid, term, tf / sum(tf) OVER (PARTITION BY qid) AS p FROM qt), ma AS (SELECT qm.qid, qm.p, st.* FROM qm JOIN st USING (term))"""
TOP = "SELECT qid, doc_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10"
KLD = """kb AS (SELECT qid, sum(p * ln(p / (2000 * cf / n_tokens))) AS base, sum(p) AS mass FROM {qm} JOIN ts USING (term), tot GROUP BY 1),
km AS (SELECT qid, doc_id, dl, sum(p * ln(1 + tf / (2000 * cf / n_tokens))) AS m FROM {ma} GROUP BY ALL),
{s} AS (SELECT qid, doc_id, exp(m - base - mass * ln(dl + 2000)) AS score FROM km JOIN kb USING (qid))"""


_indexes: dict[tuple[str, str], R.Index] = {}


def _index(t):
    """The index of a folder's documents, built once a session."""
    key = (t.spark.sparkContext.applicationId, t.path)
    if key not in _indexes:
        _indexes[key] = R.Index(t.documents)
    return _indexes[key]


def _stats(t):
    i = _index(t)
    return i.post.join(i.terms, "term").crossJoin(F.broadcast(i.total))


def _model(t):
    return R.query_model(t.benchmark.withColumnRenamed("item_id", "qid"))


def _top(scores, k=10):
    return R.best(scores.withColumn("score", F.round("score", 9)), k).select("qid", "doc_id", "score")


def _sums(df, key="term"):
    return df.groupBy(key).agg(F.round(F.sum("weight"), 4).alias("weight"))


@query(f"WITH {POST} SELECT doc_id, term, tf FROM post")
def inverted_index(t):
    return T.postings(t.documents)


@query(f"WITH {POST} SELECT term, cf::BIGINT AS cf, df FROM ts")
def term_statistics(t):
    return T.term_stats(T.postings(t.documents))


@query(f"WITH {POST} SELECT n_docs, n_tokens::BIGINT AS n_tokens, n_postings::BIGINT AS n_postings FROM tot")
def collection_totals(t):
    return T.collection_stats(T.postings(t.documents))


@query(f"WITH {POST}, w AS (SELECT doc_id, term, (ln(tf) + 1) * ln((n_docs + 1) / df) AS w FROM st), n AS (SELECT doc_id, term, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0) AS w FROM w) SELECT term, round(sum(coalesce(w, 0)), 4) AS weight FROM n GROUP BY 1")
def weight_tfidf(t):
    return _sums(W.tfidf(_stats(t)))


@query(f"WITH {POST} SELECT term, round(sum(ln((n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (n_tokens / n_docs)))), 4) AS weight FROM st GROUP BY 1")
def weight_bm25(t):
    return _sums(W.bm25(_stats(t)))


@query(f"""WITH {POST}, x AS (SELECT *, tf / dl AS prior, (tf + 1) / (dl + 1) AS po, n_tokens / cf AS inv FROM st),
w AS (SELECT doc_id, term, tf * log2(po / prior) * (tf * (-log2(prior * inv)) + (tf + 1) * log2(po * inv) + 0.5 * log2(po / prior)) AS w FROM x),
n AS (SELECT term, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0) AS w FROM w) SELECT term, round(sum(coalesce(w, 0)), 4) AS weight FROM n GROUP BY 1""")
def weight_dfree(t):
    return _sums(W.dfree(_stats(t)))


@query(f"WITH {POST}, a AS (SELECT lang AS label, term, count(DISTINCT doc_id) AS a FROM tok GROUP BY ALL) SELECT label, term, round(log2(2 + a / greatest(1, sum(a) OVER (PARTITION BY term) - a)), 6) AS weight FROM a")
def weight_tf_rf(t):
    return W.tf_rf(T.postings(t.documents), t.documents.select("doc_id", F.col("lang").alias("label"))).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {POST}, d AS (SELECT lang = 'en' AS en, count(*) AS n FROM documents GROUP BY 1), x AS (SELECT term, count(DISTINCT CASE WHEN lang = 'en' THEN doc_id END)::DOUBLE AS a, count(DISTINCT CASE WHEN lang <> 'en' THEN doc_id END)::DOUBLE AS b FROM tok GROUP BY 1),
y AS (SELECT term, a, b, (SELECT n FROM d WHERE en) - a AS c, (SELECT n FROM d WHERE NOT en) - b AS e FROM x)
SELECT term, round(CASE WHEN (a + b) * (c + e) * (a + c) * (b + e) = 0 THEN 0 ELSE (a + b + c + e) * (a * e - b * c) ** 2 / ((a + b) * (c + e) * (a + c) * (b + e)) END, 6) AS chi FROM y""")
def chi_square(t):
    en = F.col("lang") == "en"
    one = t.documents.agg(F.count_if(en).cast("double").alias("n_en"), F.count_if(~en).cast("double").alias("n_other"))
    own = T.postings(t.documents).join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("term").agg(F.count_if(en).cast("double").alias("a"), F.count_if(~en).cast("double").alias("b")).crossJoin(F.broadcast(one))
    return own.select("term", F.round(W.chi_square(F.col("a"), F.col("b"), F.col("n_en") - F.col("a"), F.col("n_other") - F.col("b")), 6).alias("chi"))


@query(f"""WITH {TOK}, b AS (SELECT term AS x, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS y FROM tok), c AS (SELECT x, y, count(*) AS n FROM b WHERE y IS NOT NULL GROUP BY ALL), e AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM c)
SELECT x, y, round(log2((n / t) / ((nx / t) * (ny / t))), 6) AS pmi, round(log2((n / t) / ((nx / t) * (ny / t))) / -log2(n / t), 6) AS npmi FROM e""")
def bigram_pmi(t):
    from pyspark.sql import Window

    from lexarium.operators import counters as C

    c = C.bigrams(T.tokens(t.documents)).toDF("x", "y", "n")
    e = c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).withColumns({"nx": F.sum("n").over(Window.partitionBy("x")), "ny": F.sum("n").over(Window.partitionBy("y"))})
    p = [F.col(x) / F.col("t") for x in ("n", "nx", "ny")]
    return e.select("x", "y", F.round(W.pmi(*p), 6).alias("pmi"), F.round(W.pmi(*p, normalized=True), 6).alias("npmi"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - min(l_quantity) OVER w) / nullif(max(l_quantity) OVER w - min(l_quantity) OVER w, 0), 6) AS v FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def min_max_scaling(t):
    return W.min_max(t.lineitem, "l_suppkey", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_quantity", 6).alias("v"))


@query(f"WITH {POST}, {QM} SELECT qid, term, round(p, 6) AS p FROM qm")
def query_language_model(t):
    return _model(t).withColumn("p", F.round("p", 6))


@query(f"WITH {POST}, {QM}, s AS (SELECT qid, doc_id, sum(p * greatest(0.0, ln(1 + tf / (2000 * ((cf + 1) / (n_tokens + 1)))) + ln(2000 / (dl + 2000)))) AS score FROM ma GROUP BY ALL) {TOP}")
def retrieval_likelihood(t):
    return _top(R.likelihood(_index(t), _model(t)))


@query(f"WITH {POST}, {QM}, {KLD.format(qm='qm', ma='ma', s='s')} {TOP}")
def retrieval_kld(t):
    return _top(R.divergence(_index(t), _model(t)))


@query(f"WITH {POST}, {QM}, s AS (SELECT qid, doc_id, sum(p * ln((n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl * n_docs / n_tokens))) AS score FROM ma GROUP BY ALL) {TOP}")
def retrieval_bm25(t):
    return _top(R.bm25(_index(t), _model(t)))


@query(f"WITH {POST}, {QM}, s AS (SELECT qid, doc_id, sum(p * ln(1 + tf * dvl / (dl * 2000.0 * ((df + 1) / (n_postings + 1))))) + ln(2000.0 / (any_value(dvl) + 2000.0)) AS score FROM ma GROUP BY ALL) {TOP}")
def retrieval_spud(t):
    return _top(R.spud(_index(t), _model(t)))


RM = f"""WITH {POST}, {QM}, {KLD.format(qm='qm', ma='ma', s='s1')}, rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s1) WHERE rank <= 5),
rw AS (SELECT qid, term, sum(score * (tf + 2000 * cf / n_tokens) / (dl + 2000)) AS w FROM rk JOIN st USING (doc_id) GROUP BY ALL),
rt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY w DESC, term) AS r FROM rw) WHERE r <= 20), rm AS (SELECT qid, term, w / sum(w) OVER (PARTITION BY qid) AS p FROM rt)"""


@query(f"{RM} SELECT qid, term, round(p, 6) AS p FROM rm")
def relevance_model(t):
    index, model = _index(t), _model(t)
    return R.relevance_model(index, R.best(R.divergence(index, model), 1000)).withColumn("p", F.round("p", 6))


@query(f"""{RM}, q2 AS (SELECT qid, term, sum(p) AS p FROM (SELECT qid, term, 0.5 * p AS p FROM qm UNION ALL SELECT qid, term, 0.5 * p FROM rm) GROUP BY ALL), m2 AS (SELECT q2.qid, q2.p, st.* FROM q2 JOIN st USING (term)),
{KLD.format(qm='q2', ma='m2', s='s').replace('kb AS', 'kb2 AS').replace('km AS', 'km2 AS').replace('FROM km JOIN kb', 'FROM km2 JOIN kb2')} {TOP}""")
def retrieval_feedback(t):
    return _top(R.feedback(_index(t), _model(t)))


EM = ", ".join(f"e{i} AS (SELECT doc_id, term, tf, pc, tf * 0.1 * p / (0.1 * p + 0.9 * pc) AS e FROM p{i}), p{i + 1} AS (SELECT doc_id, term, tf, pc, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM e{i})" for i in range(5))


@query(f"WITH {POST}, p0 AS (SELECT doc_id, term, tf, cf / n_tokens AS pc, tf / dl AS p FROM st), {EM} SELECT doc_id, term, round(p, 6) AS p FROM p5")
def parsimonious_model(t):
    i = _index(t)
    return R.parsimonious(i.post, i.terms, i.total).withColumn("p", F.round("p", 6))


@query(f"WITH {POST}, l AS (SELECT doc_id, avg(ln((tf + 2000 * cf / n_tokens) / (dl + 2000))) AS l FROM st GROUP BY 1) SELECT doc_id, round(exp(l - (SELECT max(l) FROM l)) / (SELECT sum(exp(l - (SELECT max(l) FROM l))) FROM l), 8) AS prior FROM l")
def document_prior(t):
    i = _index(t)
    return R.priors(i.post, i.terms, i.total).withColumn("prior", F.round("prior", 8))


WALK = ", ".join(f"r{i + 1} AS MATERIALIZED (SELECT no.node, 0.15 / nn.n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(score), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM fl)) / nn.n) AS score FROM no LEFT JOIN (SELECT dst AS node, sum(w * score) AS got FROM fl JOIN r{i} ON src = r{i}.node GROUP BY 1) g USING (node), nn)" for i in range(10))


@query(f"""WITH {TOK}, b AS (SELECT term AS src, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS dst FROM tok), ed AS (SELECT src, dst, count(*)::DOUBLE AS w FROM b WHERE dst IS NOT NULL GROUP BY ALL),
fl AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM ed), no AS MATERIALIZED (SELECT src AS node FROM ed UNION SELECT dst FROM ed), nn AS (SELECT count(*) AS n FROM no),
r0 AS (SELECT node, 1.0::DOUBLE / n AS score FROM no, nn), {WALK} SELECT node, round(score, 9) AS score FROM r10""")
def word_centrality(t):
    from lexarium.operators import counters as C

    edges = C.text_bigrams(t.documents).toDF("src", "dst", "w")
    return R.random_walk(edges).withColumn("score", F.round("score", 9))


@query(f"""WITH {POST}, {QM}, w AS (SELECT doc_id, term, (ln(tf) + 1) * ln((n_docs + 1) / df) AS w FROM st), n AS (SELECT doc_id AS concept, term, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0) AS w FROM w),
c AS (SELECT qid, concept, round(sum(p * coalesce(w, 0)), 9) AS weight FROM qm JOIN n USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, concept) AS r FROM c) SELECT qid, concept, round(weight, 6) AS weight FROM r WHERE r <= 10""")
def concept_vectors(t):
    weights = W.tfidf(_stats(t)).select(F.col("doc_id").alias("concept"), "term", "weight")
    return R.concept_vectors(_model(t), weights, 10).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {TOK}, {QM.split(', ma AS')[0]}, x AS (SELECT qid, doc_id, pos // 50 AS passage, round(sum(p) / 100.0, 9) AS score FROM tok JOIN qm USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, passage) AS r FROM x) SELECT qid, doc_id, round(score, 6) AS score FROM r WHERE r = 1""")
def best_passages(t):
    return R.passages(T.tokens(t.documents), _model(t)).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {TOK}, {QM.split(', ma AS')[0]}, x AS (SELECT qid, doc_id, term, lead(term) OVER w AS t2, lead(pos) OVER w - pos AS d FROM tok JOIN qm USING (term) WINDOW w AS (PARTITION BY qid, doc_id ORDER BY pos)) SELECT qid, doc_id, round(1 / (1 + avg(d)), 6) AS score FROM x WHERE t2 <> term GROUP BY ALL""")
def proximity_score(t):
    d = B.neighbour_distances(B.rows_of(t.documents, "doc_id"), cut(_model(t)))
    return d.select("qid", "doc_id", F.round(1 / (1 + F.col("total") / F.col("n")), 6).alias("score"))


@query(f"""WITH {POST}, {QM.split(', ma AS')[0]}, tr(term, other, weight) AS (VALUES ('the', 'a', 0.5), ('the', 'an', 0.5), ('of', 'from', 1.0)) SELECT qid, term, round(sum(p), 6) AS p FROM (SELECT qid, qm.term, p * CASE WHEN term IN ('the', 'of') THEN 0.5 ELSE 1 END AS p FROM qm UNION ALL SELECT qid, other, p * 0.5 * weight FROM qm JOIN tr USING (term)) GROUP BY ALL""")
def query_expansion(t):
    tr = t.spark.createDataFrame([("the", "a", 0.5), ("the", "an", 0.5), ("of", "from", 1.0)], "term string, other string, weight double")
    return R.expand(_model(t), tr).withColumn("p", F.round("p", 6))


@query()
def multi_collection_feedback(t):
    indexes = [R.Index(t.documents.where(F.col("lang") == c)) for c in ("en", "fr", "de", "es")]
    return R.collections_model(indexes, _model(t)).withColumn("p", F.round("p", 6))


@query(f"""WITH {POST}, {QM.split(', ma AS')[0]}, cl AS (SELECT doc_id, lang AS cluster FROM documents), me AS (SELECT post.*, cluster FROM post JOIN cl USING (doc_id)), cs AS (SELECT cluster, sum(tf) AS cl FROM me GROUP BY 1),
ow AS (SELECT cluster, term, sum(tf) AS ctf FROM me GROUP BY ALL), gr AS (SELECT qid, qm.term, ow.cluster, p, 0.7 * ctf / cl + 0.3 * cf / n_tokens AS pg FROM qm JOIN ts USING (term) JOIN ow USING (term) JOIN cs USING (cluster), tot),
s AS (SELECT qid, me.doc_id, sum(p * ln(1 + tf / (2000 * pg))) AS score FROM me JOIN gr USING (term, cluster) GROUP BY ALL) {TOP}""")
def retrieval_cluster_smoothing(t):
    return _top(R.cluster_likelihood(_index(t), _model(t), t.documents.select("doc_id", F.col("lang").alias("cluster"))))


@query(f"""WITH RECURSIVE {POST}, le AS (SELECT dl::BIGINT AS dl, count(*) AS n, sum(dvl) AS v FROM ds GROUP BY 1),
it AS (SELECT 0 AS k, 100.0::DOUBLE AS b UNION ALL SELECT k + 1, (SELECT greatest(1, sum(v) / sum(n * list_sum(list_transform(range(dl), lambda i: 1 / (b + i))))) FROM le) FROM it WHERE k < 20)
SELECT round(b, 4) AS b0 FROM it WHERE k = 20""")
def dirichlet_background_mass(t):
    b = R.background_mass(_index(t).docs)
    return t.spark.range(1).select(F.round(F.lit(b), 4).alias("b0"))
