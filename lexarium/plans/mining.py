"""Text mining, evaluation and learning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexarium.operators import evaluation as E
from lexarium.operators import learning as L
from lexarium.operators import mining as M
from lexarium.plans.registry import query

SEQ = "sq AS (SELECT user_id AS sid, list(event_type ORDER BY event_id) AS items FROM events GROUP BY 1)"


def _sequences(t):
    return t.events.groupBy(F.col("user_id").alias("sid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("items"))


@query("SELECT p_partkey AS doc, upper(s[1]) || upper(split_part(s, ' ', 2)[1]) || 'U' AS short, array_to_string(list_transform(string_split(s, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' Unit' AS long FROM (SELECT p_partkey, p_name AS s FROM part)")
def abbreviation_pairs(t):
    text = F.concat(F.lit("The "), F.initcap("p_name"), F.lit(" Unit ("), F.concat(F.upper(F.substring("p_name", 1, 1)), F.upper(F.substring(F.substring_index("p_name", " ", -1), 1, 1)), F.lit("U")), F.lit(") works."))
    return M.abbreviations(t.part.select("p_partkey", text.alias("t")), "p_partkey", "t")


@query("SELECT upper(s[1]) || upper(split_part(s, ' ', 2)[1]) || 'U' AS short, array_to_string(list_transform(string_split(s, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' Unit' AS long, count(*) AS n FROM (SELECT p_name AS s FROM part) GROUP BY ALL")
def abbreviation_groups(t):
    return M.abbreviation_groups(abbreviation_pairs(t))


LEVELS = f"{SEQ}, e AS (SELECT sid, items[i] AS item, i FROM (SELECT sid, items, unnest(range(1, len(items) + 1)) AS i FROM sq)), l0 AS (SELECT sid, []::VARCHAR[] AS pattern, 0 AS p FROM sq), " + ", ".join(
    f"m{k} AS MATERIALIZED (SELECT l.sid, list_append(pattern, item) AS pattern, min(i) AS p FROM l{k - 1} l JOIN e ON e.sid = l.sid AND e.i > l.p GROUP BY l.sid, pattern, item), f{k} AS (SELECT pattern, count(*) AS n FROM m{k} GROUP BY 1 HAVING count(*) >= 5), l{k} AS (SELECT * FROM m{k} SEMI JOIN f{k} USING (pattern))" for k in range(1, 5)
)
ALL = "fq AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4)"


@query(f"WITH {LEVELS}, {ALL} SELECT pattern, n FROM fq")
def frequent_sequences(t):
    return M.frequent_sequences(_sequences(t), 5, 4)


@query(f"WITH {LEVELS}, {ALL}, s AS (SELECT DISTINCT list_concat(pattern[1:i - 1], pattern[i + 1:]) AS pattern, n FROM (SELECT pattern, n, unnest(range(1, len(pattern) + 1)) AS i FROM fq WHERE len(pattern) > 1)) SELECT pattern, n FROM fq ANTI JOIN s USING (pattern, n)")
def closed_sequences(t):
    return M.closed_sequences(M.frequent_sequences(_sequences(t), 5, 4))


@query(f"WITH {SEQ}, p AS (SELECT items[1:i] AS prefix, i AS depth FROM (SELECT items, unnest(range(1, len(items) + 1)) AS i FROM sq)), c AS (SELECT prefix, any_value(depth)::INT AS depth, count(*) AS cnt FROM p GROUP BY 1) SELECT prefix, depth, cnt, prefix NOT IN (SELECT prefix[1:depth - 1] FROM c WHERE depth > 1) AS is_leaf FROM c")
def prefix_tree(t):
    return M.trie(_sequences(t))


@query(f"WITH {SEQ} SELECT a.sid AS a, b.sid AS b, (SELECT count(*) FROM range(1, least(len(a.items), len(b.items)) + 1) r(i) WHERE a.items[1:i] = b.items[1:i])::INT AS depth FROM sq a JOIN sq b ON b.sid = a.sid + 1")
def common_ancestors(t):
    s = _sequences(t)
    n = s.select((F.col("sid") - 1).alias("sid"), F.col("items").alias("other"))
    return s.join(n, "sid").select(F.col("sid").alias("a"), (F.col("sid") + 1).alias("b"), F.size(M.common_ancestor(F.col("items"), F.col("other"))).alias("depth"))


@query()
def hierarchical_clusters(t):
    return M.centroid_clusters(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), 0.5)


RUN = """r AS (SELECT l_suppkey AS qid, l_partkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY s DESC, l_partkey) AS rank FROM (SELECT l_suppkey, l_partkey, round(sum(l_quantity), 6) AS s FROM lineitem GROUP BY ALL)),
g AS (SELECT l_suppkey AS qid, l_partkey AS doc, (l_partkey % 4)::INT AS rel FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)), j AS (SELECT r.*, coalesce(g.rel, 0) AS rel FROM r LEFT JOIN g USING (qid, doc))"""


def _run(t, column="l_quantity"):
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("doc")).agg(F.round(F.sum(column), 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc"))).select("qid", "doc", "rank")


def _qrels(t):
    return t.lineitem.select(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("doc"), (F.col("l_partkey") % 4).cast("int").alias("rel")).distinct()


@query(f"""WITH {RUN}, h AS (SELECT *, (rel > 0)::INT AS h, sum((rel > 0)::INT) OVER (PARTITION BY qid ORDER BY rank) AS hits, row_number() OVER (PARTITION BY qid, rank <= 10 ORDER BY rel DESC, rank) AS ir FROM j),
t AS (SELECT qid, count(*) FILTER (rel > 0) AS relevant FROM g GROUP BY 1), s AS (SELECT qid, count(*) AS retrieved, sum(h) AS found, sum(h) FILTER (rank <= 10) AS hn, sum(h * hits / rank) FILTER (rank <= 10) AS s, sum(h * hits / rank) AS sa,
sum((2 ** rel - 1) / log2(1 + rank)) FILTER (rank <= 10) AS dcg, sum((2 ** rel - 1) / log2(1 + ir)) FILTER (rank <= 10) AS idcg, 0.2 * sum(least(rel, 1) * 0.8 ** (rank - 1)) AS rbp, min(rank) FILTER (h = 1) AS f FROM h GROUP BY 1)
SELECT qid, retrieved, relevant, found::BIGINT AS found, round(hn / 10, 6) AS precision, round(coalesce(hn / nullif(relevant, 0), 0), 6) AS recall, round(coalesce(s / nullif(hn, 0), 0), 6) AS ap, round(coalesce(sa / nullif(relevant, 0), 0), 6) AS ap_all, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg, round(rbp, 6) AS rbp, round(coalesce(1.0 / f, 0), 6) AS rr FROM s JOIN t USING (qid)""")
def evaluation_per_query(t):
    m = E.per_query(_run(t), _qrels(t))
    return m.select("qid", "retrieved", "relevant", "found", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ap", "ap_all", "ndcg", "rbp", "rr")])


@query(f"WITH {RUN}, a AS (SELECT qid, sum((rel > 0)::INT) / 10 AS p FROM j WHERE rank <= 10 GROUP BY 1) SELECT round(avg(p), 6) AS precision FROM a")
def evaluation_macro(t):
    return E.macro(E.per_query(_run(t), _qrels(t))).select(F.round("precision", 6).alias("precision"))


CMP = f"""{RUN}, r2 AS (SELECT l_suppkey AS qid, l_partkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY s DESC, l_partkey) AS rank FROM (SELECT l_suppkey, l_partkey, round(sum(l_discount), 6) AS s FROM lineitem GROUP BY ALL)), j2 AS (SELECT r2.*, coalesce(g.rel, 0) AS rel FROM r2 LEFT JOIN g USING (qid, doc)),
x AS (SELECT qid, a.p AS a, b.p AS b FROM (SELECT qid, sum((rel > 0)::INT) / 10 AS p FROM j WHERE rank <= 10 GROUP BY 1) a JOIN (SELECT qid, sum((rel > 0)::INT) / 10 AS p FROM j2 WHERE rank <= 10 GROUP BY 1) b USING (qid))"""


@query(f"WITH {CMP} SELECT round(avg(greatest(0, b - a)), 6) AS risk, round(avg(greatest(0, a - b)), 6) AS reward, round(avg(greatest(0, a - b)) - 2 * avg(greatest(0, b - a)), 6) AS tradeoff, round(avg(sign(round(a - b, 9))), 6) AS robustness FROM x")
def risk_reward(t):
    m = [E.per_query(_run(t, c), _qrels(t)).withColumn("precision", F.round("precision", 9)) for c in ("l_quantity", "l_discount")]
    out = E.risk_reward(*m, "precision")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"WITH {CMP} SELECT round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 5) AS t, count(*) - 1 AS df FROM x")
def paired_t_test(t):
    m = [E.per_query(_run(t, c), _qrels(t)) for c in ("l_quantity", "l_discount")]
    return E.paired_t(*m, "precision").withColumn("t", F.round("t", 5))


@query(f"WITH {CMP} SELECT qid, doc, (r.rank - r2.rank)::INT AS move, CASE WHEN r.rank > r2.rank THEN 'POS' WHEN r.rank < r2.rank THEN 'NEG' ELSE 'SAME' END AS kind FROM r JOIN r2 USING (qid, doc) JOIN g USING (qid, doc) WHERE rel > 0")
def rank_changes(t):
    return E.rank_changes(_run(t), _run(t, "l_discount"), _qrels(t))


@query("WITH x AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_extendedprice) AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_quantity) AS b FROM lineitem) SELECT k, round(1 - 6 * sum((a - b) ** 2) / (count(*) * (count(*) ** 2 - 1)), 6) AS rho FROM x GROUP BY 1")
def spearman_correlation(t):
    return E.spearman(t.lineitem.withColumnRenamed("l_suppkey", "k"), "k", "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 6))


@query("WITH x AS (SELECT quality AS t, toxic AS p FROM labels), l AS (SELECT DISTINCT t AS label FROM x UNION SELECT DISTINCT p FROM x), c AS (SELECT label, (SELECT count(*) FROM x WHERE t = label) AS support, (SELECT count(*) FROM x WHERE p = label) AS pn, (SELECT count(*) FROM x WHERE t = label AND p = label) AS tp FROM l) SELECT label, support, round(coalesce(tp / nullif(pn, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(pn + support, 0), 0), 6) AS f1 FROM c")
def confusion_scores(t):
    return E.confusion(t.labels, "quality", "toxic").select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("WITH x AS (SELECT avg((quality = toxic)::INT) AS s, (avg(quality) + avg(toxic)) / 2 AS p FROM labels) SELECT round((s - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 6) AS kappa, round(s, 6) AS agreement FROM x")
def judge_kappa(t):
    k, a = E.kappa(F.col("quality") == 1, F.col("toxic") == 1)
    return t.labels.agg(F.round(k, 6).alias("kappa"), F.round(a, 6).alias("agreement"))


@query("WITH x AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL) SELECT label, round(sqrt(sum(x * x)), 6) AS norm FROM x GROUP BY 1")
def centroid_training(t):
    c = L.centroids(t.embeddings.select("label", F.col("embedding").alias("v")))
    return c.select("label", F.round(F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM e) GROUP BY ALL) GROUP BY 1),
s AS (SELECT vec_id, c.label, list_dot_product(v, c) / sqrt(list_dot_product(c, c)) AS s FROM e, c) SELECT vec_id, arg_max(label, s) AS predicted FROM s GROUP BY 1""")
def centroid_classification(t):
    v = t.embeddings.select("vec_id", "label", F.col("embedding").alias("v"))
    return L.classify(v, L.centroids(v), "vec_id").select("vec_id", "predicted")


@query()
def linear_svm(t):
    return L.svm(t.embeddings.select("vec_id", "label", F.col("embedding").alias("v")), "vec_id")


@query()
def neural_network(t):
    return L.network(t.embeddings.select("vec_id", "label", F.col("embedding").alias("v")), "vec_id")


@query()
def word_vectors(t):
    return L.word2vec(t.documents).select("word", "vector")


@query()
def word_vectors_cbow(t):
    """Over the questions: training is sequential in each partition, so it takes the smaller table of texts."""
    return L.cbow(t.benchmark.withColumnRenamed("item_id", "doc_id"), size=20, rounds=2, least=2)


@query("SELECT a.vec_id AS a, b.vec_id AS b, rank::INT AS rank FROM (SELECT a.vec_id AS x, b.vec_id AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.vec_id % 20 = 0) JOIN embeddings a ON a.vec_id = x JOIN embeddings b ON b.vec_id = y WHERE rank <= 5")
def nearest_vectors(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return L.nearest(e.where("vec_id % 20 = 0"), e, 5).select("a", "b", "rank")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT a.vec_id AS a, b.vec_id AS b, c.vec_id AS c, list_transform(range(1, 65), lambda i: c.v[i] + b.v[i] - a.v[i]) AS q FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2 WHERE a.vec_id % 20 = 0),
s AS (SELECT a, b, c, vec_id AS found, round(list_dot_product(q, v) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(v, v)), 9) AS sim FROM q JOIN e ON vec_id NOT IN (a, b, c))
SELECT a, b, c, found, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, found) AS r FROM s) WHERE r <= 5""")
def analogy(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    triples = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), (F.col("vec_id") + 2).alias("c"))
    return L.analogies(e, triples, 5).select("a", "b", "c", "found", F.round("sim", 6).alias("sim"))
