"""Counters, grouped collections, windows, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexarium.operators import counters as C
from lexarium.operators import tokens as T
from lexarium.plans.registry import query

WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
TOK = f"tok AS (SELECT doc_id, source, lang, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, source, lang, {WORDS} AS w FROM documents))"
EV = "ev AS (SELECT event_type, sum(value) AS cnt FROM events GROUP BY 1)"
EV2 = "ev AS (SELECT user_id, event_type, count(*)::DOUBLE AS cnt FROM events GROUP BY 1, 2)"


def _ev(t):
    return C.count(t.events, "event_type", weight="value")


def _ev2(t):
    return C.count(t.events, "user_id", "event_type")


def _r(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns or ["cnt"]})


@query(f"WITH {TOK} SELECT term, count(*)::DOUBLE AS cnt FROM tok GROUP BY 1")
def term_counts(t):
    return C.count(T.tokens(t.documents), "term")


@query("SELECT event_type, round(sum(value), 4) AS cnt FROM events GROUP BY 1")
def counter_weighted(t):
    return _r(_ev(t), digits=4)


@query("""WITH a AS (SELECT l_suppkey, sum(l_quantity) AS cnt FROM lineitem GROUP BY 1), b AS (SELECT s_suppkey AS l_suppkey, s_acctbal AS cnt FROM supplier)
SELECT l_suppkey, round(sum(cnt), 4) AS cnt FROM (SELECT l_suppkey, 2.0 * cnt AS cnt FROM a UNION ALL SELECT l_suppkey, 0.5 * cnt FROM b) GROUP BY 1""")
def counter_merge_scaled(t):
    a = C.count(t.lineitem, "l_suppkey", weight="l_quantity")
    return _r(C.merge([(a, 2.0), (t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("cnt")), 0.5)], "l_suppkey"), digits=4)


@query(f"WITH {EV} SELECT event_type, round(cnt / (SELECT sum(cnt) FROM ev), 6) AS cnt FROM ev")
def counter_normalize(t):
    return _r(C.normalize(_ev(t)))


@query(f"WITH {EV} SELECT round(sum(cnt), 3) AS total, round(avg(cnt), 3) AS average, count(*) AS size, round(max(cnt), 3) AS max_cnt, round(min(cnt), 3) AS min_cnt, arg_max(event_type, cnt) AS arg_max, arg_min(event_type, cnt) AS arg_min FROM ev")
def counter_summary(t):
    return _r(C.summary(_ev(t), "event_type"), "total", "average", "max_cnt", "min_cnt", digits=3)


@query(f"WITH {TOK} SELECT term, count(*)::DOUBLE AS cnt FROM tok GROUP BY 1 ORDER BY cnt DESC, term LIMIT 50")
def counter_top(t):
    return C.top(C.count(T.tokens(t.documents), "term"), 50, "term")


@query(f"WITH {EV2}, r AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, event_type))::INT AS rank FROM ev) SELECT * FROM r")
def counter_rank(t):
    return C.ranked(_ev2(t), "event_type", within=("user_id",))


@query(f"WITH {EV2}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, event_type) AS rk FROM ev) SELECT user_id, event_type, cnt FROM r WHERE rk <= 2")
def vector_top_n(t):
    return C.top(_ev2(t), 2, "event_type", within=("user_id",))


@query("""WITH a AS (SELECT o_custkey AS k, count(*)::DOUBLE AS c FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, c_nationkey::DOUBLE AS c FROM customer)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.c, 0) - coalesce(b.c, 0) AS cnt FROM a FULL JOIN b ON a.k = b.k""")
def counter_difference(t):
    a = C.count(t.orders.withColumnRenamed("o_custkey", "k"), "k")
    return C.difference(a, t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("double").alias("cnt")), "k")


@query("SELECT true AS equal, false AS shifted")
def counter_equality(t):
    a = _ev(t)
    same = C.equal(a, _ev(t), "event_type", tolerance=1e-6)
    other = C.equal(a, a.withColumn("cnt", F.col("cnt") + 1), "event_type", tolerance=1e-6)
    return same.crossJoin(other.withColumnRenamed("equal", "shifted"))


@query("SELECT c_custkey, coalesce(n, 0)::DOUBLE AS cnt FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def counter_lookup_default(t):
    return C.lookup(t.customer.select("c_custkey"), C.count(t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey"), "c_custkey")


@query(f"WITH {EV2} SELECT user_id, event_type, least(greatest(cnt, 2.0), 4.0) AS cnt FROM ev")
def counter_clamp(t):
    return C.clamp(_ev2(t), 2.0, 4.0)


@query(f"WITH {EV} SELECT event_type, round(abs(cnt) * 0.5, 4) AS scaled, round(ln(1 + abs(cnt)), 6) AS logged, round(cnt + 3, 4) AS shifted FROM ev")
def counter_elementwise(t):
    c = F.col("cnt")
    return _ev(t).select("event_type", F.round(F.abs(c) * 0.5, 4).alias("scaled"), F.round(F.ln(1 + F.abs(c)), 6).alias("logged"), F.round(c + 3, 4).alias("shifted"))


@query("SELECT draw FROM range(20) r(draw)")
def counter_sample(t):
    return C.sample(_ev(t).withColumn("cnt", F.abs("cnt")), "event_type", 20).select("draw")


@query(f"WITH {EV2} SELECT user_id, event_type, round(cnt / sum(cnt) OVER (PARTITION BY user_id), 6) AS cnt FROM ev")
def countermap_conditional(t):
    return _r(C.normalize(_ev2(t), "user_id"))


@query(f"WITH {EV2} SELECT user_id, event_type, round((cnt - 0.5) / sum(cnt) OVER (PARTITION BY user_id), 6) AS cnt FROM ev")
def countermap_discount(t):
    return _r(C.discount(_ev2(t), 0.5, "user_id"))


@query(f"WITH {EV2} SELECT user_id, event_type, sum(cnt) AS cnt, (2 - (grouping(user_id) + grouping(event_type)))::INT AS depth FROM ev GROUP BY ROLLUP(user_id, event_type)")
def countermap_totals(t):
    return C.totals(_ev2(t), "user_id", "event_type")


@query("WITH d AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*)::DOUBLE AS cnt FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, l_linenumber, sum(cnt) AS cnt, (3 - (grouping(l_returnflag) + grouping(l_linestatus) + grouping(l_linenumber)))::INT AS depth FROM d GROUP BY ROLLUP(l_returnflag, l_linestatus, l_linenumber)")
def deep_counter_totals(t):
    return C.totals(C.count(t.lineitem, "l_returnflag", "l_linestatus", "l_linenumber"), "l_returnflag", "l_linestatus", "l_linenumber")


@query(f"WITH {EV2} SELECT user_id, event_type, cnt FROM ev ORDER BY cnt DESC, user_id, event_type LIMIT 1")
def countermap_argmax(t):
    return C.top(_ev2(t), 1, "user_id", "event_type")


@query("SELECT user_id, list(event_type ORDER BY event_id) AS items FROM events GROUP BY 1")
def group_to_list(t):
    return C.group_list(t.events, "user_id", "event_type", "event_id")


@query("SELECT event_type, list(u ORDER BY u) AS items FROM (SELECT DISTINCT event_type, user_id AS u FROM events) GROUP BY 1")
def group_to_set_inverted(t):
    sets = C.group_set(t.events, "user_id", "event_type")
    return C.group_set(sets.select("user_id", F.explode("items").alias("event_type")), "event_type", "user_id")


@query(f"WITH {TOK}, f AS (SELECT term, min(doc_id * 1000000 + pos) AS o FROM tok GROUP BY 1) SELECT term, row_number() OVER (ORDER BY o, term) - 1 AS id FROM f")
def dictionary_encode(t):
    tok = T.tokens(t.documents).withColumn("o", F.col("doc_id") * 1000000 + F.col("pos"))
    return C.encode(tok, "term", "o")


@query(f"WITH {TOK}, c AS (SELECT term, count(*)::DOUBLE AS n FROM tok GROUP BY 1) SELECT n AS freq, count(*) AS n FROM c GROUP BY 1")
def frequency_of_frequencies(t):
    return C.frequency_of_frequencies(C.count(T.tokens(t.documents), "term"))


@query(f"WITH {TOK}, d AS (SELECT source, doc_id, count(*) AS dl FROM tok GROUP BY ALL) SELECT source, count(*) AS n_docs, sum(dl)::BIGINT AS n_tokens, round(avg(dl), 6) AS avg_len, max(v) AS vocabulary FROM d JOIN (SELECT source, count(DISTINCT term) AS v FROM tok GROUP BY 1) USING (source) GROUP BY 1")
def collection_statistics(t):
    tok = T.tokens(t.documents.withColumn("doc_id", F.struct("source", "doc_id"))).withColumns({"source": F.col("doc_id.source")})
    post = tok.groupBy("source", "doc_id", "term").agg(F.count("*").alias("tf"))
    own = post.groupBy("source", "doc_id").agg(F.sum("tf").alias("dl")).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_tokens"), F.round(F.avg("dl"), 6).alias("avg_len"))
    vocabulary = post.groupBy("source", "term").count().groupBy("source").agg(F.count("*").alias("vocabulary"))
    return own.join(vocabulary, "source")


@query(rf"WITH {TOK} SELECT source, regexp_matches(term, '[0-9]') AS numeric, count(*) AS tokens, count(DISTINCT term) AS types FROM tok GROUP BY ALL")
def numeric_vocabulary(t):
    tok = t.documents.select("source", F.explode(T.words(F.col("text"))).alias("term"))
    types = tok.groupBy("source", "term").agg(F.count("*").alias("n"))
    return types.groupBy("source", F.col("term").rlike("[0-9]").alias("numeric")).agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


@query(f"WITH {TOK}, b AS (SELECT term AS first, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS second FROM tok) SELECT first, second, count(*)::DOUBLE AS cnt FROM b WHERE second IS NOT NULL GROUP BY ALL")
def bigram_counts(t):
    return C.bigrams(T.tokens(t.documents))


@query("WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT a.event_type AS first, b.event_type AS second, count(*)::DOUBLE AS cnt FROM s a JOIN s b ON a.user_id = b.user_id AND b.p - a.p BETWEEN 1 AND 3 GROUP BY ALL")
def cooccurrence_window(t):
    return C.cooccurrences(t.events, 4, doc="user_id", pos="event_id", term="event_type")


@query("WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT a.event_type AS first, b.event_type AS second, sum(3 - (b.p - a.p) + 1)::DOUBLE AS cnt FROM s a JOIN s b ON a.user_id = b.user_id AND b.p - a.p BETWEEN 1 AND 3 GROUP BY ALL")
def cooccurrence_hal(t):
    return C.cooccurrences(t.events, 3, weighted=True, doc="user_id", pos="event_id", term="event_type")


@query("SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS running, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_extendedprice))::INT AS rank FROM lineitem")
def cumulate_and_rank(t):
    w = Window.partitionBy("l_orderkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w.orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.row_number().over(w.orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_extendedprice")).alias("rank"))


@query("SELECT p_partkey, p_name, length(p_name)::INT AS n FROM part ORDER BY n, p_name, p_partkey")
def length_sort(t):
    return t.part.select("p_partkey", "p_name", F.length("p_name").alias("n")).orderBy("n", "p_name", "p_partkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def keep_key_set(t):
    return t.customer.select("c_custkey", "c_mktsegment").join(t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def prune_key_set(t):
    return t.customer.select("c_custkey", "c_mktsegment").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20 AND l_discount <> 0")
def threshold_and_interval(t):
    return t.lineitem.where("l_quantity > 10 and l_quantity < 20 and l_discount <> 0").select("l_orderkey", "l_linenumber")


@query("SELECT vec_id, list_filter(range(64), lambda i: embedding[i + 1] > 0.2) AS places FROM embeddings")
def indices_over_cutoff(t):
    return t.embeddings.select("vec_id", F.filter(F.transform("embedding", lambda x, i: F.when(x > F.lit(0.2).cast("double"), i.cast("long"))), lambda i: i.isNotNull()).alias("places"))


@query("SELECT o_orderkey, c_custkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def id_map_join(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("o_orderkey", "c_custkey", "n_name", "r_name")


@query("SELECT a.l_suppkey AS a, b.l_suppkey AS b, round(sum(a.q * b.q), 2) AS dot FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) a JOIN (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL")
def sparse_dot(t):
    v = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    a, b = v.select(F.col("l_suppkey").alias("a"), "l_partkey", F.col("q").alias("qa")), v.select(F.col("l_suppkey").alias("b"), "l_partkey", F.col("q").alias("qb"))
    return a.join(b, "l_partkey").where("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("qa") * F.col("qb")), 2).alias("dot"))


@query(f"WITH {TOK}, d AS (SELECT DISTINCT doc_id, term FROM tok), q AS (SELECT DISTINCT item_id, unnest({WORDS}) AS term FROM benchmark) SELECT item_id, doc_id, count(*) AS common FROM d JOIN q USING (term) GROUP BY ALL")
def key_set_intersection(t):
    """Sizes of all non-empty intersections of documents' and benchmark items' key sets."""
    keys = lambda df, key: df.select(key, F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))
    return keys(t.documents, "doc_id").join(keys(t.benchmark, "item_id"), "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("common"))


@query("SELECT r_name, n_name, r_regionkey = n_regionkey AS own FROM region, nation")
def cartesian_product(t):
    return t.region.crossJoin(F.broadcast(t.nation)).select("r_name", "n_name", (F.col("r_regionkey") == F.col("n_regionkey")).alias("own"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def drop_duplicates(t):
    return t.documents.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("SELECT count(*) AS n, 4 AS folds FROM orders")
def split_folds(t):
    f = C.folds(t.orders, "o_orderkey", [0.5, 0.2, 0.2, 0.1]).groupBy("fold").count()
    return f.agg(F.sum("count").alias("n"), F.count("*").cast("int").alias("folds"))


@query("SELECT lang, list(source ORDER BY source) AS sources, sum(n)::BIGINT AS docs FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1")
def category_map(t):
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n")).groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("sources"), F.sum("n").alias("docs"))
