"""String functions, distances, similarity search, entity names."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexarium.functions import distance as D
from lexarium.functions import strings as S
from lexarium.operators import string_search as P
from lexarium.operators import tokens as T
from lexarium.plans.counters import WORDS
from lexarium.plans.registry import query
from lexarium.session import small

PAIRS = "n AS (SELECT DISTINCT p_name AS s FROM part), pairs AS (SELECT a.s AS a, b.s AS b FROM n a, n b)"


def _pairs(t):
    """All pairs of the different names: a stated set of queries against all, broadcast behind a check of its size."""
    n = t.part.select(F.col("p_name").alias("s")).distinct()
    return n.select(F.col("s").alias("a")).crossJoin(small(n.select(F.col("s").alias("b"))))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
def normalize_spaces(t):
    return t.documents.select("doc_id", F.md5(S.normalize_spaces(F.col("text"))).alias("h"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[!-/:-@\[-`{-~]+', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM documents")
def normalize_punctuation(t):
    return t.documents.select("doc_id", F.md5(S.normalize_punctuation(F.col("text"))).alias("h"))


@query("SELECT event_id, '{\"k\": <N' || length(json_extract_string(props, '$.k')) || '>}' AS masked FROM events")
def mask_numbers(t):
    return t.events.select("event_id", S.mask_numbers(F.col("props")).alias("masked"))


@query(r"SELECT page_id, md5(trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gsi'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&apos;', ''''), '&amp;', chr(1)), '&[A-Za-z#0-9]+;', '', 'g'), chr(1), '&'), '\s+', ' ', 'g'))) AS h FROM pages")
def html_to_text(t):
    return t.pages.select("page_id", F.md5(S.strip_html(F.col("html"))).alias("h"))


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS left_part, split_part(c_name, '#', 2) AS right_part FROM customer")
def split_at_last(t):
    x = t.customer.select("c_custkey", S.split_at_last(F.col("c_name"), "#").alias("x"))
    return x.select("c_custkey", F.col("x.left").alias("left_part"), F.col("x.right").alias("right_part"))


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM pages")
def between_markers(t):
    return t.pages.select("page_id", S.between(F.col("html"), "<title>", "</title>").alias("title"))


@query(f"WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), g AS (SELECT array_to_string(w[i:i+2], '_') AS gram FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w)) SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) > 4")
def word_ngrams(t):
    return t.documents.select(T.words(F.col("text")).alias("w")).select(F.explode(S.word_ngrams(F.col("w"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 4")


@query("SELECT p_partkey, p_name[i:i+1] AS gram, (i - 1)::INT AS start FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name))) AS i FROM part)")
def character_qgrams(t):
    return P.grams(t.part, 2, "p_partkey", "p_name").select("p_partkey", "gram", "start")


@query("SELECT p_partkey, [p_name[1:length(p_name)//2], p_name[length(p_name)//2+1:]] AS parts FROM part")
def even_segments(t):
    return t.part.select("p_partkey", S.segments(F.col("p_name"), 2).alias("parts"))


@query("SELECT i, i // 588 AS lead, (i // 28) % 21 AS vowel, (i % 28) AS tail, chr((44032 + i)::INT) AS syllable FROM range(11172) r(i)")
def hangul_syllables(t):
    i = t.spark.range(11172).withColumnRenamed("id", "i")
    parts = i.select("i", S.compose_hangul(F.expr("i div 588"), F.expr("(i div 28) % 21"), F.expr("i % 28")).alias("syllable"))
    return parts.withColumn("x", S.decompose_hangul(F.col("syllable"))).select("i", "x.lead", "x.vowel", "x.tail", "syllable")


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM part")
def capitalize(t):
    return t.part.select("p_partkey", F.initcap("p_name").alias("name"))


@query(f"SELECT doc_id, len(list_filter({WORDS}, lambda w: length(w) BETWEEN 2 AND 29 AND w NOT IN {T.STOPWORDS}))::INT AS n FROM documents")
def analyzer(t):
    return t.documents.select("doc_id", F.size(T.analyze(F.col("text"))).alias("n"))


@query(r"SELECT doc_id, list_transform(regexp_extract_all(text, '\b[A-Z]{2,}\b'), lambda x: x) AS found FROM documents")
def regex_matches(t):
    return t.documents.select("doc_id", F.regexp_extract_all("text", F.lit(r"(?<![0-9A-Za-z_])([A-Z]{2,})(?![0-9A-Za-z_])"), F.lit(1)).alias("found"))


@query(f"WITH {PAIRS} SELECT a, b, levenshtein(a, b)::INT AS d, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS sim FROM pairs")
def levenshtein_pairs(t):
    return _pairs(t).select("a", "b", F.levenshtein("a", "b").alias("d"), F.round(D.levenshtein_similarity(F.col("a"), F.col("b")), 6).alias("sim"))


@query(f"WITH {PAIRS} SELECT a, b, damerau_levenshtein(a, b)::INT AS d FROM pairs")
def damerau_pairs(t):
    return _pairs(t).select("a", "b", D.pair_udf(D.damerau, "int")("a", "b").alias("d"))


@query()
def alignment_scores(t):
    a, b = F.col("a"), F.col("b")
    scores = {"smith_waterman": D.smith_waterman, "needleman_wunsch": D.needleman_wunsch, "affine_gap": D.affine_gap, "weighted": D.weighted_edit, "sw_similarity": D.smith_waterman_similarity, "substring": D.substring_distance}
    return _pairs(t).select("a", "b", *[D.pair_udf(f)(a, b).alias(n) for n, f in scores.items()])


@query()
def alignment_paths(t):
    return _pairs(t).select("a", "b", D.alignment(F.col("a"), F.col("b")).alias("x")).select("a", "b", "x.*")


@query("WITH s AS (SELECT DISTINCT p_name FROM part), c AS (SELECT unnest(list_distinct(string_split(p_name, ''))) AS ch FROM s) SELECT ch, round(ln(((SELECT count(*) FROM s) + 1) / count(*)), 6) AS weight FROM c GROUP BY 1")
def character_idf(t):
    n = t.part.select("p_name").distinct()
    total = n.agg((F.count("*") + 1).alias("n"))
    return n.select(F.explode(F.array_distinct(F.split("p_name", ""))).alias("ch")).groupBy("ch").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("ch", F.round(F.ln(F.col("n") / F.col("df")), 6).alias("weight"))


STRINGS = "s AS (SELECT min(p_partkey) AS id, lower(p_name || ' ' || p_brand) AS s FROM part GROUP BY 2)"


def _strings(t):
    return t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("s")).groupBy("s").agg(F.min("p_partkey").alias("id"))


@query(f"WITH {STRINGS} SELECT a.id AS qid, b.id AS sid, levenshtein(a.s, b.s)::INT AS distance FROM s a, s b WHERE levenshtein(a.s, b.s) <= 2")
def similarity_search(t):
    s = _strings(t)
    return P.search(s.select(F.col("id").alias("qid"), F.col("s").alias("q")), s.select(F.col("id").alias("sid"), "s"), 2, 2)


@query(f"WITH {STRINGS}, g AS (SELECT DISTINCT id, s[i:i+1] AS gram FROM (SELECT id, s, unnest(range(1, length(s))) AS i FROM s)) SELECT gram, round(ln(((SELECT count(*) FROM s) + 1) / count(*)), 6) AS weight FROM g GROUP BY 1")
def gram_idf(t):
    g = P.grams(_strings(t), 2, "id", "s")
    return P.gram_weights(g, "idf", "id").withColumn("weight", F.round("weight", 6))


@query("WITH q AS (SELECT DISTINCT p_name AS q FROM part), n AS (SELECT p_partkey AS e, p_name AS s FROM part), m AS (SELECT q, e, max(1 - levenshtein(q, s) / greatest(length(q), length(s))) AS score FROM q, n WHERE levenshtein(q, s) <= 1 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, e) AS rank FROM m) SELECT q, e AS entity, round(score, 6) AS score FROM r WHERE rank <= 5")
def entity_identification(t):
    names = t.part.select(F.col("p_partkey").alias("entity"), F.col("p_partkey").alias("sid"), F.col("p_name").alias("s"))
    queries = t.part.select(F.col("p_name").alias("q")).distinct().withColumn("qid", F.col("q"))
    return P.identify(queries, names, 2, 1).where("rank <= 5").select(F.col("qid").alias("q"), "entity", F.round("score", 6).alias("score"))


@query("WITH a AS (SELECT p_name AS name, list(DISTINCT p_brand) AS v FROM part GROUP BY 1), b AS (SELECT p_name AS name, list(DISTINCT p_type) AS v FROM part GROUP BY 1) SELECT name, list_sort(list_distinct(list_concat(coalesce(a.v, []), coalesce(b.v, [])))) AS variants FROM a FULL JOIN b USING (name)")
def entity_merge(t):
    a = t.part.groupBy(F.col("p_name").alias("name")).agg(F.collect_set("p_brand").alias("variants"))
    b = t.part.groupBy(F.concat("p_name", F.lit(" (old)")).alias("name")).agg(F.collect_set("p_type").alias("variants"))
    return P.merge_entities(a, b)


@query("SELECT k, round(1.0 * sum(hit) / count(*), 6) AS precision, round(1.0 * sum(hit) / (SELECT count(DISTINCT p_name) FROM part), 6) AS recall FROM (SELECT a.p_name AS q, b.p_name = a.p_name AS same, row_number() OVER (PARTITION BY a.p_name ORDER BY 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) DESC, b.p_name) AS rank, (b.p_name = a.p_name)::INT AS hit FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b WHERE levenshtein(a.p_name, b.p_name) <= 3) x, (VALUES (1), (5), (10)) v(k) WHERE rank <= k GROUP BY k")
def identification_scores(t):
    n = t.part.select(F.col("p_name").alias("s")).distinct()
    names = n.select(F.col("s").alias("entity"), F.col("s").alias("sid"), "s")
    found = P.identify(n.select(F.col("s").alias("qid"), F.col("s").alias("q")), names, 2, 3)
    return P.identification_scores(found, n.select(F.col("s").alias("qid"), F.col("s").alias("entity"))).select("k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {PAIRS} SELECT a, b, -levenshtein(a, b)::DOUBLE AS score FROM pairs")
def global_alignment(t):
    """With no reward and equal penalties the best global alignment is the edit distance."""
    return _pairs(t).select("a", "b", D.pair_udf(D.needleman_wunsch)(F.col("a"), F.col("b")).alias("score"))


@query(f"WITH {PAIRS}, s AS (SELECT DISTINCT b, b[i:j] AS sub FROM (SELECT DISTINCT b FROM pairs), (SELECT unnest(range(1, 40)) AS i), (SELECT unnest(range(0, 40)) AS j) WHERE j >= i - 1 AND j <= length(b) AND i <= length(b) + 1) SELECT a, b, min(levenshtein(a, sub))::INT AS distance FROM (SELECT DISTINCT a FROM pairs), s GROUP BY ALL")
def substring_distances(t):
    return _pairs(t).select("a", "b", D.pair_udf(D.substring_distance, "int")(F.col("a"), F.col("b")).alias("distance"))
