"""Array statistics, special functions and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexarium.functions import arrays as A
from lexarium.operators import matrix as M
from lexarium.plans.registry import query

V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_transform(embedding::DOUBLE[], lambda x: x * x) AS sq FROM embeddings), p AS (SELECT vec_id, a, list_transform(sq, lambda x: x / list_sum(sq)) AS p, list_transform(range(64), lambda i: 1 / 64) AS u FROM v)"


def _v(t):
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    e = e.withColumn("sq", F.transform("a", lambda x: x * x)).withColumn("_t", A.total("sq"))
    return e.select("vec_id", "a", F.transform("sq", lambda x: x / F.col("_t")).alias("p"), F.array_repeat(F.lit(1 / 64), 64).alias("u"))


def _r(df, digits=6):
    return df.select("vec_id", *[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes if c != "vec_id"])


@query(f"WITH {V} SELECT vec_id, round(list_sum(a), 6) AS total, round(list_avg(a), 6) AS mean, round(list_var_samp(a), 6) AS var_s, round(list_var_pop(a), 6) AS var_p, list_position(a, list_max(a)) - 1 AS arg_max, list_position(a, list_min(a)) - 1 AS arg_min FROM v")
def array_statistics(t):
    return _r(_v(t).select("vec_id", A.total("a").alias("total"), A.mean("a").alias("mean"), A.variance("a").alias("var_s"), A.variance("a", False).alias("var_p"), A.arg("a").cast("int").alias("arg_max"), A.arg("a", False).cast("int").alias("arg_min")))


@query(f"WITH {V} SELECT vec_id, round(list_dot_product(a, p), 6) AS dot, round(greatest(0, least(1, list_cosine_similarity(a, p))), 6) AS cosine, round(list_distance(a, p), 6) AS euclid, round(sqrt(list_dot_product(p, p)), 6) AS norm FROM p")
def vector_products(t):
    return _r(_v(t).select("vec_id", A.dot("a", "p").alias("dot"), A.cosine("a", "p").alias("cosine"), A.euclidean("a", "p").alias("euclid"), A.norm("p").alias("norm")))


@query(f"WITH {V}, x AS (SELECT vec_id, unnest(a) AS a, unnest(p) AS b FROM p) SELECT vec_id, round(covar_samp(a, b), 6) AS cov, round(corr(a, b), 6) AS pearson, round(regr_slope(b, a), 6) AS slope, round(regr_intercept(b, a), 6) AS intercept FROM x GROUP BY 1")
def array_correlation(t):
    d = _v(t).select("vec_id", A.covariance("a", "p").alias("cov"), A.pearson("a", "p").alias("pearson"), A.regression("a", "p").alias("r"))
    return _r(d.select("vec_id", "cov", "pearson", "r.slope", "r.intercept"))


@query(f"WITH {V}, x AS (SELECT vec_id, unnest(p) AS p, unnest(u) AS u FROM p) SELECT vec_id, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS entropy, round(-sum(p * ln(u)), 6) AS cross_entropy, round(sum(CASE WHEN p > 0 THEN p * log2(p / u) ELSE 0 END), 6) AS kl, round((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + u) / 2)) ELSE 0 END) + sum(u * log2(u / ((p + u) / 2)))) / 2, 6) AS js FROM x GROUP BY 1")
def divergences(t):
    return _r(_v(t).select("vec_id", A.entropy("p").alias("entropy"), A.cross_entropy("p", "u").alias("cross_entropy"), A.kl("p", "u").alias("kl"), A.jensen_shannon("p", "u").alias("js")))


@query(f"WITH {V}, x AS (SELECT vec_id, unnest(a) AS a FROM p) SELECT vec_id, round(exp(avg(ln(a * a + 1))), 6) AS geometric, round(count(*) / sum(1 / (a * a + 1)), 6) AS harmonic, round(ln(sum(exp(a))), 6) AS lse FROM x GROUP BY 1")
def array_means(t):
    d = _v(t).select("vec_id", "a", F.transform("a", lambda x: x * x + 1).alias("b"))
    return _r(d.select("vec_id", A.geometric_mean("b").alias("geometric"), A.harmonic_mean("b").alias("harmonic"), A.log_sum_exp("a").alias("lse")))


@query(f"WITH {V}, x AS (SELECT vec_id, a, list_transform(a, lambda x: exp(x)) AS e FROM p) SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS top_softmax, round(a[1] / sqrt(list_dot_product(a, a)), 6) AS first_unit, round((a[1] - list_min(a)) / (list_max(a) - list_min(a)), 6) AS first_scaled FROM x")
def array_normalization(t):
    d = _v(t).select("vec_id", "a", A.log_sum_exp("a").alias("l"), A.norm("a").alias("n"), F.array_min("a").alias("lo"), F.array_max("a").alias("hi"))
    one = F.get("a", 0)
    return _r(d.select("vec_id", F.exp(F.col("hi") - F.col("l")).alias("top_softmax"), (one / F.col("n")).alias("first_unit"), ((one - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("first_scaled")))


@query(f"WITH {V}, x AS (SELECT vec_id, unnest(a) AS a, generate_subscripts(a, 1) AS i FROM p), y AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY a DESC, i)::INT AS r FROM x) SELECT vec_id, list(r ORDER BY i) AS ranks FROM y GROUP BY 1")
def array_ranks(t):
    return _v(t).select("vec_id", A.ranks("a").alias("ranks"))


@query("SELECT n, k, round(lgamma(n + 0.5), 6) AS lg, round(gamma(n + 1) / (gamma(k + 1) * gamma(n - k + 1))) AS comb, round(gamma(n + 1) / gamma(n - k + 1)) AS perm, round(exp(lgamma(n + 1) + lgamma(k + 1) - lgamma(n + k + 2)), 8) AS beta FROM (SELECT a::DOUBLE AS n, b::DOUBLE AS k FROM range(1, 15) x(a), range(1, 15) y(b)) WHERE k <= n")
def special_functions(t):
    n = t.spark.range(1, 15).select(F.col("id").cast("double").alias("n"))
    d = n.crossJoin(F.broadcast(n.withColumnRenamed("n", "k"))).where("k <= n")
    return d.select("n", "k", F.round(A.log_gamma(F.col("n") + 0.5), 6).alias("lg"), A.combinations("n", "k").alias("comb"), A.permutations("n", "k").alias("perm"), F.round(A.beta(F.col("n") + 1, F.col("k") + 1), 8).alias("beta"))


@query("SELECT event_id, round(exp(-value * value / 20000) / (100 * sqrt(2 * pi())), 9) AS gauss, round(1 / (1 + exp(-value / 100)), 6) AS sigmoid, round(CASE WHEN abs(value) > 50 THEN 0 ELSE 1 - abs(value) / 50 END, 6) AS triangle, round(CASE WHEN abs(value) > 50 THEN 0 ELSE (1 + cos(pi() * abs(value) / 50)) / 2 END, 6) AS cosine FROM events")
def kernels_and_sigmoids(t):
    v = "value"
    return t.events.select("event_id", F.round(A.gaussian(v, 0.0, 100.0), 9).alias("gauss"), F.round(A.sigmoid(v, 0.01), 6).alias("sigmoid"), F.round(A.kernel(v, 50.0, "triangle"), 6).alias("triangle"), F.round(A.kernel(v, 50.0, "cosine"), 6).alias("cosine"))


MX = "m AS (SELECT (l_suppkey % 20)::BIGINT AS i, (l_partkey % 20)::BIGINT AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


def _m(t):
    return t.lineitem.groupBy((F.col("l_suppkey") % 20).alias("i"), (F.col("l_partkey") % 20).alias("j")).agg(F.sum("l_quantity").alias("v"))


@query(f"WITH {MX} SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.j = b.j GROUP BY ALL")
def matrix_product(t):
    return M.product(_m(t), M.transpose(_m(t)))


@query(f"WITH {MX} SELECT i, j, round(v / sum(v) OVER (PARTITION BY j), 8) AS v FROM m")
def matrix_normalize_columns(t):
    return M.normalize(_m(t), "j").withColumn("v", F.round("v", 8))


@query(f"WITH {MX} SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, coalesce(2 * a.v, 0) - coalesce(b.v, 0) AS v FROM m a FULL JOIN m b ON a.i = b.j AND a.j = b.i")
def matrix_add_scaled(t):
    return M.add(_m(t), M.transpose(_m(t)), 2.0, -1.0)


@query(f"WITH {MX} SELECT round((SELECT sum(v) FROM m WHERE i = j), 4) AS trace, round(sqrt(sum(v * v)), 4) AS norm FROM m")
def matrix_trace_and_norm(t):
    return M.trace(_m(t)).crossJoin(M.frobenius(_m(t))).select(F.round("trace", 4).alias("trace"), F.round("norm", 4).alias("norm"))


@query("SELECT 1.0::DOUBLE AS identity_error, 7::BIGINT AS rank")
def matrix_dense_algebra(t):
    m = t.lineitem.groupBy((F.col("l_orderkey") % 7).alias("i"), (F.col("l_partkey") % 7).alias("j")).agg(F.sum("l_quantity").alias("v"))
    n = m.agg(F.count_distinct("i").alias("n"))
    back = M.product(m, M.inverse(m)).agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(F.abs("v"))).alias("s")).crossJoin(n).select(F.round(F.col("s") / F.col("n"), 4).alias("identity_error"))
    return back.withColumn("rank", F.lit(M.rank(m)).cast("long"))
