"""Records and readers, counter maps, joins on order, models over characters, and shapes of arrays."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexarium.functions import arrays as A
from lexarium.functions import strings as S
from lexarium.operators import counters as C
from lexarium.operators import evaluation as E
from lexarium.operators import gram_models as G
from lexarium.operators import joins as J
from lexarium.operators import records as X
from lexarium.operators import string_search as P
from lexarium.operators import tokens as T
from lexarium.plans.counters import EV2, TOK, WORDS, _ev2
from lexarium.plans.registry import query
from lexarium.plans.text import STRINGS, _strings
from lexarium.session import shared_dir, small, stored
from lexarium.sources import binary, readers, sinks

V = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"


def _written(t, lines, compression="none"):
    """The folder of text files that the rows of ``value`` were written to."""
    path = f"{shared_dir(t.spark)}/{uuid.uuid4().hex}"
    sinks.text(lines, path, compression=compression)
    return path


def _xml(t, rows, root, key):
    """The folder of XML files, one a key, with the elements of ``value`` below a root."""
    path = f"{shared_dir(t.spark)}/{uuid.uuid4().hex}"
    files = rows.groupBy(key).agg(F.concat(F.lit(f"<{root}>\n"), F.array_join(F.collect_list("value"), "\n"), F.lit(f"\n</{root}>")).alias("value"))
    files.repartition(key).write.partitionBy(key).text(path)
    return path


def _vectors(t):
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


# Readers: each query writes a collection in the reader's format and reads it back.


@query("SELECT c_name AS value FROM customer")
def read_lines(t):
    return readers.lines(t.spark, _written(t, t.customer.select(F.col("c_name").alias("value")), "gzip"))


@query("SELECT count(*) AS n FROM customer")
def count_lines(t):
    return readers.count_lines(t.spark, _written(t, t.customer.select(F.col("c_name").alias("value")), "bzip2"))


@query("SELECT c_nationkey AS n, count(*) AS customers, sum(length(c_name))::BIGINT AS chars FROM customer GROUP BY 1")
def read_whole_texts(t):
    path = f"{shared_dir(t.spark)}/{uuid.uuid4().hex}"
    t.customer.select("c_nationkey", F.col("c_name").alias("value")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    files = readers.whole_texts(t.spark, path, recursive=True)
    parts = files.select(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int").alias("n"), F.filter(F.split("value", "\n"), lambda x: x != "").alias("l"))
    return parts.groupBy("n").agg(F.sum(F.size("l")).alias("customers"), F.sum(F.aggregate("l", F.lit(0), lambda s, x: s + F.length(x))).alias("chars"))


@query("SELECT [c_name, c_mktsegment] AS lines FROM customer")
def read_blocks(t):
    return readers.blocks(t.spark, _written(t, t.customer.select(F.concat("c_name", F.lit("\n"), "c_mktsegment", F.lit("\n")).alias("value"))))


@query("SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS name, 'a' || chr(10) || c_mktsegment AS note FROM customer")
def read_tsv(t):
    rows = t.customer.select(F.concat_ws("\t", F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 7 == 0, "null").otherwise(F.col("c_name")), F.concat(F.lit("a<NL>"), "c_mktsegment")).alias("value"))
    return readers.tsv(t.spark, _written(t, rows), "key", "name", "note")


@query("SELECT c_custkey::VARCHAR AS id, c_name AS title, [c_mktsegment, 'N' || c_nationkey] AS authors, 'about ' || c_name AS abs, CASE WHEN c_custkey % 3 = 0 THEN [] ELSE ['s1', 's2'] END AS subjects FROM customer")
def read_papers(t):
    line = lambda k, v: F.concat(F.lit(f"{k}:\t"), v, F.lit("\n"))
    rows = t.customer.select(F.concat(line("id", F.col("c_custkey").cast("string")), line("title", F.col("c_name")), line("authors", F.concat("c_mktsegment", F.lit("; N"), F.col("c_nationkey").cast("string"))), line("abs", F.concat(F.lit("about "), "c_name")), line("subjects", F.when(F.col("c_custkey") % 3 == 0, "").otherwise("s1;s2"))).alias("value"))
    return X.papers(X.attributes(readers.blocks(t.spark, _written(t, rows))))


@query("SELECT n_name AS name, list_sort(list(DISTINCT c_mktsegment)) AS variants FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def read_organizations(t):
    both = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"))
    return X.organizations(readers.blocks(t.spark, _written(t, both.select(F.concat("n_name", F.lit("\torg\n"), "c_mktsegment", F.lit("\n")).alias("value")))))


@query("WITH c AS (SELECT c_nationkey::VARCHAR AS short, c_mktsegment AS word, count(*) AS c FROM customer GROUP BY ALL) SELECT short, word, round(c / sum(c) OVER (PARTITION BY short), 6) AS p FROM c")
def read_short_forms(t):
    c = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("c"))
    rows = c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_mktsegment", "c"))), lambda x: F.concat(x["c_mktsegment"], F.lit("\t"), x["c"].cast("string"), F.lit("\n"))), "").alias("l"))
    blocks = readers.blocks(t.spark, _written(t, rows.select(F.concat(F.col("c_nationkey").cast("string"), F.lit("\n"), "l").alias("value"))))
    return X.short_forms(blocks).withColumn("p", F.round("p", 6))


@query("SELECT c_custkey::VARCHAR AS qid, c_mktsegment AS type, c_name AS description, 'sum ' || c_name AS summary, CASE WHEN c_custkey % 2 = 0 THEN 'd' END AS diagnosis FROM customer")
def read_topics(t):
    tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v, F.lit(f"</{n}>"))
    body = F.concat(tag("description", F.col("c_name")), tag("summary", F.concat(F.lit("sum "), "c_name")), F.when(F.col("c_custkey") % 2 == 0, "<diagnosis>d</diagnosis>").otherwise(""))
    rows = t.customer.select("c_nationkey", F.concat(F.lit('<topic number="'), F.col("c_custkey").cast("string"), F.lit('" type="'), "c_mktsegment", F.lit('">'), body, F.lit("</topic>")).alias("value"))
    return readers.topics(t.spark, _xml(t, rows, "topics", "c_nationkey"))


@query("SELECT c_custkey::VARCHAR AS id, c_name AS title, c_mktsegment AS body FROM customer")
def read_tagged_records(t):
    rows = t.customer.select(F.concat(F.lit(".I "), F.col("c_custkey").cast("string"), F.lit("\n.T\n"), "c_name", F.lit("\n.W\n"), "c_mktsegment").alias("value"))
    found = readers.tagged(t.spark, _written(t, rows))
    return found.select("id", F.col("fields")["T"].alias("title"), F.col("fields")["W"].alias("body"))


@query("SELECT (c_custkey % 1000)::VARCHAR AS qid, c_name AS text FROM customer")
def read_fixed_width_topics(t):
    return readers.fixed_width_topics(t.spark, _written(t, t.customer.select(F.concat(F.rpad((F.col("c_custkey") % 1000).cast("string"), 4, " "), "c_name").alias("value"))))


@query("SELECT DISTINCT l_suppkey::VARCHAR AS qid, l_partkey::VARCHAR AS doc, (l_partkey % 4)::DOUBLE AS rel FROM lineitem")
def read_judgments(t):
    g = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    return readers.judgments(t.spark, _written(t, g.select(F.concat_ws(" ", F.col("l_suppkey").cast("string"), F.lit("0"), F.col("l_partkey").cast("string"), (F.col("l_partkey") % 4).cast("string")).alias("value"))))


@query("SELECT c_name AS title, 'text of ' || c_name AS text, CASE WHEN c_custkey % 5 = 0 THEN 'Target ' || c_custkey END AS redirect FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT c_name, '#REDIRECT [[Target ' || c_custkey || ']]', 'Target ' || c_custkey FROM customer WHERE c_custkey % 5 = 0")
def read_wiki_pages(t):
    text = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("#REDIRECT [[Target "), F.col("c_custkey").cast("string"), F.lit("]]"))).otherwise(F.concat(F.lit("text of "), "c_name"))
    rows = t.customer.select("c_nationkey", F.concat(F.lit("<page><title>"), "c_name", F.lit("</title><revision><text>"), text, F.lit("</text></revision></page>")).alias("value"))
    return readers.wiki_pages(t.spark, _xml(t, rows, "mediawiki", "c_nationkey"))


@query("SELECT 'D' || c_custkey AS docno, c_name || ' ' || c_mktsegment AS text FROM customer")
def read_sgml_documents(t):
    rows = t.customer.select(F.concat(F.lit("<DOC>\n<DOCNO> D"), F.col("c_custkey").cast("string"), F.lit(" </DOCNO>\n<P>"), "c_name", F.lit("</P> <b>"), "c_mktsegment", F.lit("</b>\n</DOC>")).alias("value"))
    return readers.sgml_documents(t.spark, _written(t, rows))


@query("SELECT 'u' || c_custkey AS uid, '201' || (c_custkey % 10) AS date, 'http://x/' || c_custkey AS url, c_name AS content FROM customer")
def read_crawl_dump(t):
    rows = t.customer.select(F.concat(F.lit("#UID:u"), F.col("c_custkey").cast("string"), F.lit("\n#DATE:201"), (F.col("c_custkey") % 10).cast("string"), F.lit("\n#URL:http://x/"), F.col("c_custkey").cast("string"), F.lit("\n#CONTENT:<p>"), "c_name", F.lit("</p>\n#EOR")).alias("value"))
    return readers.crawl_dump(t.spark, _written(t, rows))


@query(f"WITH {V}, c AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x, vec_id FROM embeddings) SELECT label::VARCHAR AS label, count(*) AS n, sum(i)::BIGINT AS places FROM c WHERE x <> 0 GROUP BY 1")
def read_svm(t):
    rows = readers.svm(t.spark, _written(t, sinks.svm_lines(t.embeddings.select("label", F.col("embedding").cast("array<double>").alias("v")))))
    return rows.select("label", F.explode("cells").alias("c")).groupBy("label").agg(F.count("*").alias("n"), F.sum("c.i").alias("places"))


@query(f"WITH {V} SELECT v FROM e")
def read_binary_arrays(t):
    path = f"{shared_dir(t.spark)}/{uuid.uuid4().hex}"
    files = stored(binary.write_arrays(_vectors(t).select("v"), path))  # the files are written once, when this table is
    found = binary.arrays(t.spark, path)
    return found.join(F.broadcast(files.select(F.regexp_extract("uri", "[^/]+$", 0).alias("name")).distinct()), F.regexp_extract("file", "[^/]+$", 0) == F.col("name")).select("v")


# Counters and counter maps.


@query(f"WITH {EV2} SELECT event_type AS user_id, user_id AS event_type, cnt FROM ev")
def countermap_transpose(t):
    return C.transpose(_ev2(t), "user_id", "event_type")


@query("SELECT user_id, event_type, sum(c)::DOUBLE AS cnt FROM (SELECT user_id, event_type, 2.0 AS c FROM events UNION ALL SELECT user_id, event_type, 0.5 FROM events WHERE value > 10) GROUP BY ALL")
def countermap_merge(t):
    return C.merge([(_ev2(t), 2.0), (C.count(t.events.where("value > 10"), "user_id", "event_type"), 0.5)], "user_id", "event_type")


@query("SELECT DISTINCT event_type FROM events")
def countermap_inner_keys(t):
    return C.inner_keys(_ev2(t), "event_type")


@query(f"WITH {EV2} SELECT user_id, event_type, CASE WHEN user_id = 3 THEN cnt * 10 ELSE cnt END AS cnt FROM ev WHERE user_id <> 5")
def countermap_scale_and_remove_row(t):
    return C.scale_row(_ev2(t), "user_id", 3, 10.0).where("user_id <> 5")


@query("WITH c AS (SELECT event_type AS k, sum(value) AS v FROM events GROUP BY 1) SELECT string_agg(k || ':' || printf('%.2f', v), ', ' ORDER BY v DESC, k) AS text FROM (SELECT * FROM c ORDER BY v DESC, k LIMIT 3)")
def counter_text(t):
    return C.text_form(C.count(t.events, "event_type", weight="value"), "event_type", 3)


@query("SELECT n_regionkey, c_mktsegment, list_sort(list(DISTINCT n_name)) AS names FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def nested_lists(t):
    both = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    nested = both.groupBy("n_regionkey", "c_mktsegment").agg(F.array_sort(F.collect_set("n_name")).alias("names")).groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "names"))).alias("m"))
    return nested.select("n_regionkey", F.explode("m").alias("c_mktsegment", "names"))


@query(f"WITH {TOK}, f AS (SELECT term, count(*)::DOUBLE AS cnt FROM tok GROUP BY 1) SELECT term, cnt FROM f")
def key_translation(t):
    tok = T.tokens(t.documents)
    ids = stored(C.encode(tok.withColumn("o", F.col("doc_id") * 1000000 + F.col("pos")), "term", "o"))
    counts = C.translate(C.count(tok, "term"), "term", ids)
    return C.translate(counts, "id", ids)


@query(f"WITH {V}, c AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS key, unnest(v) AS cnt FROM e) SELECT vec_id, list(cnt ORDER BY key) AS v FROM c GROUP BY 1")
def vector_counter_conversion(t):
    cells = _vectors(t).select("vec_id", F.posexplode("v").alias("key", "cnt"))
    return cells.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "cnt"))), lambda x: x["cnt"]).alias("v"))


@query("SELECT label, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY 1")
def group_by_label(t):
    return t.embeddings.groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


@query(f"WITH {TOK}, b AS (SELECT term AS first, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS second FROM tok), c AS (SELECT first, second, count(*) AS n FROM b WHERE second IS NOT NULL GROUP BY ALL) SELECT first, second, round(n / sum(n) OVER (PARTITION BY first), 6) AS cnt FROM c")
def bigram_conditional(t):
    return C.normalize(C.bigrams(T.tokens(t.documents)), "first").withColumn("cnt", F.round("cnt", 6))


@query("""WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events), d AS (SELECT event_type, ln((SELECT count(DISTINCT user_id) FROM events) + 1) - ln(count(DISTINCT user_id)) AS idf FROM events GROUP BY 1),
c AS (SELECT a.event_type AS first, b.event_type AS second, sum(3 - (b.p - a.p) + 1)::DOUBLE AS cnt FROM s a JOIN s b ON a.user_id = b.user_id AND b.p - a.p BETWEEN 1 AND 3 GROUP BY ALL) SELECT first, second, round(cnt * x.idf * y.idf, 6) AS cnt FROM c JOIN d x ON x.event_type = first JOIN d y ON y.event_type = second""")
def cooccurrence_hal_idf(t):
    users = t.events.agg(F.count_distinct("user_id").alias("n"))
    idf = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("df")).crossJoin(F.broadcast(users)).select("event_type", (F.ln(F.col("n") + 1) - F.ln("df")).alias("idf"))
    c = C.cooccurrences(t.events, 3, weighted=True, doc="user_id", pos="event_id", term="event_type")
    both = c.join(idf.toDF("first", "x"), "first").join(idf.toDF("second", "y"), "second")
    return both.select("first", "second", F.round(F.col("cnt") * F.col("x") * F.col("y"), 6).alias("cnt"))


@query(f"WITH {TOK}, c AS (SELECT term, count(*) AS freq FROM tok GROUP BY 1), f AS (SELECT freq, count(*) AS n FROM c GROUP BY 1), r AS (SELECT freq, coalesce(sum(n) OVER (ORDER BY freq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM f) SELECT round(regr_slope(ln(freq), ln(rank)), 6) AS slope FROM r")
def zipf_slope(t):
    return C.zipf(C.frequency_of_frequencies(C.count(T.tokens(t.documents), "term"))).select(F.round("slope", 6).alias("slope"))


@query(f"WITH {TOK}, g AS (SELECT doc_id, term || '_' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS gram FROM tok), c AS (SELECT gram, doc_id, count(*) AS c FROM g WHERE gram IS NOT NULL GROUP BY ALL) SELECT gram, gram[1] AS block, string_agg(doc_id || ':' || c, ' ' ORDER BY doc_id) AS postings FROM c GROUP BY ALL")
def ngram_block_index(t):
    return C.ngram_postings(T.tokens(t.documents))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


# Order, permutation and shape.


@query("SELECT count(*) AS n, count(*) AS places FROM orders")
def shuffled(t):
    """A random order that every run repeats: rows by hash; ids become dense places by it."""
    order = t.orders.select(F.xxhash64("o_orderkey", F.lit(17)).alias("h"), F.col("o_orderkey").alias("k"))
    return C.encode(order, "k", "h").agg(F.count("*").alias("n"), F.count_distinct("id").alias("places"))


@query("SELECT vec_id, label * 64 + 5 AS linear, label, 5 AS feature FROM embeddings")
def index_linearize(t):
    linear = t.embeddings.select("vec_id", (F.col("label") * 64 + 5).alias("linear"))
    return linear.select("vec_id", "linear", F.expr("linear div 64").cast("int").alias("label"), (F.col("linear") % 64).cast("int").alias("feature"))


@query("SELECT true AS inside, count(*) AS n FROM orders")
def random_fill(t):
    filled = t.orders.select((F.rand(7) * 4 - 2).alias("x"))
    return filled.agg(F.bool_and(F.col("x").between(-2, 2)).alias("inside"), F.count("x").alias("n"))


@query("SELECT l_orderkey, list_transform(list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity), lambda q: round(100 * q / list_sum(list(l_quantity)), 6)) AS parts FROM lineitem GROUP BY 1".replace("list_transform(list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity), lambda q: round(100 * q / list_sum(list(l_quantity)), 6))", "list(round(100 * q, 6) ORDER BY l_linenumber, l_partkey, l_quantity)").replace("FROM lineitem", "FROM (SELECT *, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS q FROM lineitem)"))
def distribute_mass(t):
    lists = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))), lambda x: x["l_quantity"]).alias("q"))
    return lists.select("l_orderkey", F.transform(A.distribute(F.lit(100.0), F.col("q")), lambda x: F.round(x, 6)).alias("parts"))


@query(f"WITH {V} SELECT vec_id, list_transform(range(8), lambda i: v[i * 8 + 3]) AS col, list_transform(range(8), lambda i: v[i * 8 + i + 1]) AS diag, v AS flat, 8.0::DOUBLE AS ones FROM e")
def array_shapes(t):
    m = _vectors(t).select("vec_id", A.reshape(F.col("v"), 8).alias("m"))
    ones = F.aggregate(F.flatten(A.identity(8)), F.lit(0.0), lambda s, x: s + x)
    return m.select("vec_id", A.column_of(F.col("m"), 2).alias("col"), A.diagonal(F.col("m")).alias("diag"), F.flatten("m").alias("flat"), ones.alias("ones"))


@query(f"WITH {V} SELECT a.vec_id, round(list_sum(flatten(list_transform(range(2, 65), lambda i: list_transform(range(1, i), lambda j: sign(a.v[i] - a.v[j]) * sign(b.v[i] - b.v[j]))))) / (64 * 63 / 2), 6) AS tau FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 = 0")
def kendall_correlation(t):
    v = _vectors(t)
    pairs = v.where("vec_id % 20 = 0").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return pairs.select("vec_id", F.round(A.kendall(F.col("v"), F.col("w")), 6).alias("tau"))


@query("WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS w FROM part) SELECT p_partkey, array_to_string(w[2:3], ' ') AS middle, coalesce(w[9], 'none') AS ninth, array_to_string(w, '_') AS all_words FROM w")
def word_lists(t):
    w = t.part.select("p_partkey", F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("w"))
    return w.select("p_partkey", S.joined(F.col("w"), 1, 3).alias("middle"), S.item(F.col("w"), 8, "none").alias("ninth"), F.array_join("w", "_").alias("all_words"))


@query("SELECT n_name AS name FROM nation")
def chapter_prefix(t):
    return t.nation.select(S.strip_chapter(F.concat(F.lit("ICD-10 Chapter "), "n_name", F.lit(" "))).alias("name"))


# Joins.


@query("WITH p AS (SELECT user_id, ts, max(value) AS last_value FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT e.event_id, e.user_id, e.ts, p.last_value FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts")
def as_of_join(t):
    p = t.events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return J.as_of(t.events.select("event_id", "user_id", "ts"), p, "user_id", "ts", "last_value")


@query("SELECT a.event_id, b.event_id AS event_id_r FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def interval_join(t):
    e = t.events.select("event_id", "user_id", "ts", "event_type")
    return J.within(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "ts", 3600).select("event_id", "event_id_r")


@query("WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM n) SELECT user_id, min(ts) AS start, max(ts) AS end, count(*) AS n FROM i GROUP BY user_id, s".replace("AS end", 'AS "end"').replace("AS start", 'AS "start"'))
def session_windows(t):
    return J.sessions(t.events, "user_id", "ts", 1800)


@query("SELECT DISTINCT c_nationkey AS qid FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def judged_queries(t):
    return t.customer.select(F.col("c_nationkey").alias("qid")).distinct().join(t.supplier.select(F.col("s_nationkey").alias("qid")), "qid", "left_semi")


@query("SELECT DISTINCT l_suppkey AS qid, l_partkey AS doc, (l_partkey % 4)::INT AS rel FROM lineitem WHERE l_partkey % 4 <> 0 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def indexed_judgments(t):
    q = t.lineitem.select(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("doc"), (F.col("l_partkey") % 4).cast("int").alias("rel")).distinct().where("rel <> 0")
    return q.join(t.part.where("p_size > 10").select(F.col("p_partkey").alias("doc")), "doc", "left_semi")


@query("SELECT event_type, true AS close FROM events GROUP BY 1")
def distinct_sketch(t):
    """Approximate distinct counts beside exact ones: within a twentieth."""
    d = t.events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("n"))
    return d.select("event_type", (F.abs(F.col("a") - F.col("n")) <= F.greatest(F.lit(1), 0.1 * F.col("n"))).alias("close"))


@query(r"SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS name FROM part")
def sql_functions(t):
    """A function registered for SQL, which Catalyst inlines."""
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION first_upper(x STRING) RETURNS STRING RETURN concat(upper(substring(x, 1, 1)), substring(x, 2))")
    return t.part.select("p_partkey", F.expr("first_upper(p_name)").alias("name"))


# Words, characters and strings.


@query(rf"WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+(?:[''’＇][\p{{L}}\p{{N}}]+)*')) AS w FROM documents), s AS (SELECT doc_id, regexp_replace(w, '[''’＇][sS]$', '') AS w FROM r) SELECT doc_id, lower(w) AS term, count(*) AS n FROM s WHERE length(w) BETWEEN 2 AND 29 AND lower(w) NOT IN ({', '.join(repr(w) for w in T.STOPWORDS)}) AND NOT regexp_matches(w, '[0-9]') GROUP BY ALL")
def analyzer_without_stems(t):
    tok = T.analyzed(t.documents, stem=False)
    return T.without_numbers(tok).where(~F.col("term").rlike("[0-9]")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query()
def analyzer_with_stems(t):
    return T.analyzed(t.documents).groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, string_split(c_name || ' , is n''t', ' ') AS words FROM customer".replace("c_name || ' , is n''t'", "replace(c_name, '#', ' # ') || ' , is n''t .'"))
def treebank_tokens(t):
    return t.customer.select("c_custkey", T.treebank(F.concat("c_name", F.lit(", isn't."))).alias("words"))


@query(r"SELECT min(page_id) AS page_id, h FROM (SELECT page_id, md5(trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gsi'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&apos;', ''''), '&amp;', chr(1)), '&[A-Za-z#0-9]+;', '', 'g'), chr(1), '&'), '\s+', ' ', 'g'))) AS h FROM pages) GROUP BY h")
def collection_scrub(t):
    return t.pages.select("page_id", F.md5(S.strip_html(F.col("html"))).alias("h")).groupBy("h").agg(F.min("page_id").alias("page_id"))


GRAMS = f"{STRINGS}, g AS (SELECT id, s[i:i+1] AS gram, i - 1 AS start FROM (SELECT id, s, unnest(range(1, length(s))) AS i FROM s)), gw AS (SELECT gram, ln(((SELECT count(*) FROM s) + 1) / count(DISTINCT id)) AS w FROM g GROUP BY 1), w AS (SELECT id, start, w FROM g JOIN gw USING (gram))"


@query(f"WITH {GRAMS} SELECT a.id AS sid, round(min(a.w + b.w), 6) AS weight FROM w a JOIN w b ON a.id = b.id AND b.start >= a.start + 2 GROUP BY 1")
def optimal_pivots(t):
    g = P.grams(_strings(t), 2, "id", "s")
    weighted = g.join(P.gram_weights(g, "idf", "id"), "gram").select(F.col("id").alias("sid"), "start", "weight")
    return G.pivots(weighted, 2, 1).select("sid", F.round("weight", 6).alias("weight"))


@query(f"WITH {GRAMS} SELECT id, count(*) AS grams, count(DISTINCT gram) AS kinds FROM g GROUP BY 1")
def gram_postings_reload(t):
    """The posting table of grams, stored and opened again."""
    return stored(P.grams(_strings(t), 2, "id", "s")).groupBy("id").agg(F.count("*").alias("grams"), F.count_distinct("gram").alias("kinds"))


@query()
def candidate_scores(t):
    s = _strings(t)
    found = P.search(s.select(F.col("id").alias("qid"), F.col("s").alias("q")), s.select(F.col("id").alias("sid"), "s"), 2, 2)
    pairs = found.join(s.select(F.col("id").alias("qid"), F.lower("s").alias("q")), "qid").join(s.select(F.col("id").alias("sid"), F.lower("s").alias("s")), "sid")
    n = s.agg((F.count("*") + 1).alias("n"))
    idf = s.select(F.explode(F.array_distinct(F.split(F.lower("s"), ""))).alias("ch")).groupBy("ch").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("ch", F.ln(F.col("n") / F.col("df")).alias("weight"))
    return G.scored(pairs, idf).select("qid", "sid", F.round("score", 6).alias("score"))


@query("WITH n AS (SELECT p_name AS name FROM part GROUP BY 1 HAVING count(*) >= 2), c AS (SELECT a.name, b.name AS candidate, levenshtein(a.name, b.name) AS d FROM n a, (SELECT DISTINCT p_name AS name FROM part) b WHERE levenshtein(a.name, b.name) <= 3) SELECT name, candidate, d::INT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d, candidate) AS r FROM c) WHERE r <= 10")
def candidate_test_set(t):
    names = t.part.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    found = P.search(names.where("n >= 2").select(F.col("name").alias("qid"), F.col("name").alias("q")), names.select(F.col("name").alias("sid"), F.col("name").alias("s")), 2, 3)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "sid"))
    return found.withColumn("r", rank).where("r <= 10").select(F.col("qid").alias("name"), F.col("sid").alias("candidate"), "distance")


@query("SELECT o_custkey AS id, p AS name, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p) AS r FROM (SELECT o_custkey, o_orderpriority AS p, count(*)::DOUBLE AS n FROM orders GROUP BY ALL)) WHERE r = 1")
def most_frequent_names(t):
    c = t.orders.groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("cnt"))
    return C.top(c, 1, "name", within=("id",)).select("id", "name", F.col("cnt").alias("n"))


@query()
def space_correction(t):
    names = t.part.select(F.col("p_name").alias("text"))
    glued = names.distinct().select(F.translate("text", " ", "").alias("text"))
    return G.space_corrected(glued, G.character_model(names))


@query(r"WITH s AS (SELECT p_name AS t FROM part), c AS (SELECT t[i:i+k-1] AS context, t[i+k] AS ch FROM (SELECT t, unnest(range(1, length(t))) AS i FROM s), (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k <= length(t)), n AS (SELECT context, ch, count(*) AS n FROM c GROUP BY ALL) SELECT context, ch, round(n / sum(n) OVER (PARTITION BY context), 6) AS p FROM n")
def character_model(t):
    return G.character_model(t.part.select(F.col("p_name").alias("text"))).withColumn("p", F.round("p", 6))


@query()
def huffman_codes(t):
    return G.huffman_codes(C.count(T.tokens(t.documents), "term"), "term")


# Classifiers and evaluation.


@query("WITH x AS (SELECT quality AS t, toxic AS p FROM labels), l AS (SELECT DISTINCT t AS label FROM x UNION SELECT DISTINCT p FROM x), c AS (SELECT label, (SELECT count(*) FROM x WHERE t = label) AS s, (SELECT count(*) FROM x WHERE p = label) AS n, (SELECT count(*) FROM x WHERE t = label AND p = label) AS tp FROM l) SELECT (SELECT round(avg((t = p)::INT), 6) FROM x) AS micro_f1, round(avg(coalesce(tp / nullif(n, 0), 0)), 6) AS macro_precision, round(avg(coalesce(tp / nullif(s, 0), 0)), 6) AS macro_recall, round(avg(coalesce(2 * tp / nullif(n + s, 0), 0)), 6) AS macro_f1 FROM c")
def micro_macro_scores(t):
    m = E.micro_macro(t.labels, "quality", "toxic")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query()
def centroid_online_training(t):
    from lexarium.operators import learning as L

    v = t.embeddings.select("vec_id", "label", F.col("embedding").alias("v"))
    model = G.train_centroids(v, L.centroids(v))
    return L.classify(v, model, "vec_id").select("vec_id", "predicted")


TYPES = f"{TOK}, lt AS (SELECT term, lang, count(*) AS n FROM tok GROUP BY ALL), pt AS (SELECT term, lang AS type, n / sum(n) OVER (PARTITION BY term) AS p FROM lt), dt AS (SELECT doc_id, type, sum(p) AS p FROM tok JOIN pt USING (term) GROUP BY ALL), bt AS (SELECT item_id AS qid, unnest({WORDS}) AS term FROM benchmark), qt AS (SELECT qid, type, sum(p) AS p FROM bt JOIN pt USING (term) GROUP BY ALL)"


@query(f"WITH {TYPES} SELECT doc_id, type, round(p / sum(p) OVER (PARTITION BY doc_id), 6) AS p FROM dt")
def document_types(t):
    return _types(T.tokens(t.documents), t, "doc_id").withColumn("p", F.round("p", 6))


def _types(tok, t, key):
    """Type probabilities of texts: the mean over their words of each word's share in every type of document."""
    own = T.tokens(t.documents.withColumn("doc_id", F.struct("lang", "doc_id"))).groupBy("term", F.col("doc_id.lang").alias("type")).agg(F.count("*").alias("cnt"))
    p = C.normalize(own, "term").select("term", "type", F.col("cnt").alias("q"))
    sums = tok.join(p, "term").groupBy(key, "type").agg(F.sum("q").alias("cnt"))
    return C.normalize(sums, key).select(key, "type", F.col("cnt").alias("p"))


@query(f"WITH {TYPES}, sc AS (SELECT item_id AS qid, doc_id, (1 + (item_id + doc_id) % 7) / 7 AS score FROM benchmark JOIN documents ON doc_id % 40 = item_id % 40), n AS (SELECT qid, sqrt(sum(p * p)) AS n FROM qt GROUP BY 1), m AS (SELECT doc_id, sqrt(sum(p * p)) AS m FROM dt GROUP BY 1) SELECT qid, doc_id, round(any_value(score) * sum(qt.p * dt.p) / any_value(n) / any_value(m), 6) AS score FROM sc JOIN qt USING (qid) JOIN dt USING (doc_id, type) JOIN n USING (qid) JOIN m USING (doc_id) GROUP BY ALL")
def type_rerank(t):
    ranked = t.benchmark.select(F.col("item_id").alias("qid")).join(t.documents.select("doc_id"), F.col("doc_id") % 40 == F.col("qid") % 40).withColumn("score", (1 + (F.col("qid") + F.col("doc_id")) % 7) / 7)
    q = _types(T.tokens(t.benchmark.withColumnRenamed("item_id", "qid"), "qid"), t, "qid")
    return G.type_scores(ranked, q, _types(T.tokens(t.documents), t, "doc_id")).withColumn("score", F.round("score", 6))


TRI = "tx AS (SELECT doc_id, lang AS label, lower(text) AS s FROM documents), gr AS (SELECT doc_id, label, s[i:i+2] AS gram, count(*) AS tf FROM (SELECT doc_id, label, s, unnest(range(1, length(s) - 1)) AS i FROM tx) GROUP BY ALL), gi AS (SELECT gram, ln(((SELECT count(DISTINCT doc_id) FROM gr) + 1) / count(*)) AS idf FROM gr GROUP BY 1), gw AS (SELECT doc_id, label, gram, (ln(tf) + 1) * idf AS w FROM gr JOIN gi USING (gram)), gu AS (SELECT doc_id, label, gram, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 0) AS w FROM gw)"


@query(f"WITH {TRI}, ce AS (SELECT label, gram, sum(coalesce(w, 0)) / any_value(n) AS c FROM gu JOIN (SELECT label, count(DISTINCT doc_id) AS n FROM gr GROUP BY 1) USING (label) GROUP BY ALL), cn AS (SELECT label, sqrt(sum(c * c)) AS l FROM ce GROUP BY 1), sc AS (SELECT doc_id, ce.label, round(sum(coalesce(w, 0) * c) / any_value(l), 9) AS s FROM gu JOIN ce USING (gram) JOIN cn ON cn.label = ce.label GROUP BY ALL) SELECT doc_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, label) AS r FROM sc) WHERE r = 1".replace("gu JOIN ce USING (gram)", "gu JOIN ce ON ce.gram = gu.gram"))
def gram_centroid_classes(t):
    low = t.documents.select("doc_id", F.col("lang").alias("label"), F.lower("text").alias("text")).repartition("doc_id")  # a document's grams are counted and kept together
    tf = low.select("doc_id", "label", F.explode(S.qgrams(F.col("text"), 3)).alias("g")).groupBy("doc_id", "label", F.col("g.gram").alias("gram")).agg(F.count("*").alias("tf"))
    tf = stored(tf)
    n = tf.agg((F.count_distinct("doc_id") + 1).alias("n"))
    idf = tf.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("gram", F.ln(F.col("n") / F.col("df")).alias("idf"))
    weighted = tf.join(small(idf), "gram").withColumn("weight", (F.ln("tf") + 1) * F.col("idf"))
    length = small(weighted.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("length")))
    unit = weighted.join(length, "doc_id").withColumn("weight", F.when(F.col("length") == 0, 0.0).otherwise(F.col("weight") / F.col("length")))
    sizes = tf.groupBy("label").agg(F.count_distinct("doc_id").alias("n"))
    model = unit.groupBy("label", "gram").agg(F.sum("weight").alias("s")).join(F.broadcast(sizes), "label").select("label", "gram", (F.col("s") / F.col("n")).alias("c"))
    model = small(model)
    norm = model.groupBy("label").agg(F.sqrt(F.sum(F.col("c") ** 2)).alias("l"))
    s = unit.select("doc_id", "gram", "weight").join(model, "gram").groupBy("doc_id", "label").agg(F.sum(F.col("weight") * F.col("c")).alias("d")).join(F.broadcast(norm), "label").select("doc_id", "label", F.round(F.col("d") / F.col("l"), 9).alias("s"))
    return s.groupBy("doc_id").agg(F.min(F.struct((-F.col("s")).alias("s"), "label"))["label"].alias("predicted"))


@query("SELECT c_custkey, 100 + c_custkey AS top_k, 5 AS fb_docs, 25 AS fb_words, 2000.0::DOUBLE AS mu, c_custkey % 2 = 0 AS doc_prior FROM customer")
def run_settings(t):
    """Settings read from the names of runs."""
    name = F.concat(F.lit("cbeem_"), (F.col("c_custkey") + 100).cast("string"), F.lit("_10_5_25_2000.0_0.5_"), F.when(F.col("c_custkey") % 2 == 0, "true").otherwise("false"))

    @F.pandas_udf("top_k long, fb_docs int, fb_words int, mu double, doc_prior boolean")
    def parse(names):
        import pandas as pd

        rows = [X.Settings.parse(x) for x in names]
        return pd.DataFrame({k: [getattr(r, k) for r in rows] for k in ("top_k", "fb_docs", "fb_words", "mu", "doc_prior")})

    return t.customer.select("c_custkey", parse(name).alias("s")).select("c_custkey", "s.*")


@query("SELECT 'u' || user_id AS qid, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase FROM (SELECT user_id, event_type, round(value, 2) AS value FROM events) GROUP BY 1")
def search_log_statistics(t):
    lines = t.events.select(F.concat(F.lit("qid=u"), F.col("user_id").cast("string"), F.lit(" coll="), "event_type", F.lit(" mix="), F.round("value", 2).cast("string")).alias("value"))
    return X.run_statistics(lines).select("qid", F.round("click", 6).alias("click"), F.round("purchase", 6).alias("purchase"))
