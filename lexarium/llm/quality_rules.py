"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines (``\\n``-split, at least one word) are normalised (A-Z... lower case, white space to one space) and hashed;
the distinct documents of a host that hold a line are counted, and a line above the host's limit is removed from
its documents. A document that loses more than half of its words that way is depleted and rejected, as is one
that fails the base rules (too few words, or too many inside repeated 8-word windows).

Rows: null text counts as empty, so it has no words and fails. A null host is the host "". Every row is a
document of its own, so repeated ids or rows count each, and rows come back one for one. An empty table gives an
empty result. Columns besides those named are not read, except that ``clean`` returns all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.session import cut

_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")
#: So many frequent lines at most are sent to all executors (8 bytes each); more are joined by hash and host.
MOST_BROADCAST = 100_000


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, _SPACE, " "))))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _BLANKS, "")) > 0)


def frequent_lines(docs: DataFrame, min_docs: int = 20, share: float = 0.05, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, line hash) of lines that more than max(min_docs, share x the host's documents) of a host's documents hold.

    Counting is pre-aggregated before the shuffle, so a line or host with a third of all rows is one key like any other.
    """
    rows = docs.select(F.coalesce(docs[host_col].cast("string"), F.lit("")).alias("host"), F.array_distinct(F.transform(_lines(F.coalesce(docs[text_col], F.lit(""))), _line_hash)).alias("hashes"))
    lines = rows.select("host", F.explode("hashes").alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs"))
    hosts = rows.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.count("*") * F.lit(share)).alias("limit"))
    return lines.where(F.col("docs") > min_docs).join(hosts, "host").where("docs > limit").select("host", "line")


def _with_removed(docs: DataFrame, frequent: DataFrame, count: int) -> DataFrame:
    """Add _removed, the hashes of a document's frequent lines."""
    docs = docs.withColumn("_hashes", F.transform(F.col("_lines"), _line_hash))
    if count <= MOST_BROADCAST:
        by_host = frequent.groupBy("host").agg(F.collect_list("line").alias("_bad")).withColumnRenamed("host", "_host")
        joined = docs.join(F.broadcast(by_host), "_host", "left")
        return joined.withColumn("_removed", F.when(F.col("_bad").isNull(), F.array().cast("array<bigint>")).otherwise(F.array_intersect("_hashes", "_bad"))).drop("_bad")
    key = F.struct("_id", "_host", F.xxhash64("_text").alias("h"))
    found = docs.select(key.alias("_key"), F.col("_host").alias("host"), F.explode("_hashes").alias("line")).join(frequent, ["host", "line"]).groupBy("_key").agg(F.collect_set("line").alias("_removed"))
    joined = docs.withColumn("_key", key).join(found.withColumnRenamed("_key", "_other"), F.col("_key").eqNullSafe(F.col("_other")), "left")
    return joined.withColumn("_removed", F.coalesce("_removed", F.array().cast("array<bigint>"))).drop("_key", "_other")


def judged(docs: DataFrame, min_docs: int = 20, share: float = 0.05, min_words: int = 20, repeat_percent: int = 30, depleted_percent: int = 50, window: int = 8, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """All rows with the columns of the rules, each named with a leading underscore, beside the input's own."""
    frequent = cut(frequent_lines(docs, min_docs, share, text_col, host_col))
    rows = docs.withColumns({"_id": F.col(id_col), "_text": F.coalesce(F.col(text_col), F.lit("")), "_host": F.coalesce(F.col(host_col).cast("string"), F.lit(""))})
    rows = rows.withColumns({"_words": F.transform(_words(F.col("_text")), lambda w: F.xxhash64(w)), "_lines": _lines(F.col("_text"))})
    rows = _with_removed(rows, frequent, frequent.count())
    rows = rows.withColumns({
        "_n_words": F.size("_words").cast("long"),
        "_word_chars": F.length(F.translate("_text", _BLANKS, "")).cast("long"),
        "_n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_removed_words": F.when(F.size("_removed") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.filter("_lines", lambda x: F.array_contains("_removed", _line_hash(x))), F.lit(0).cast("long"), lambda s, x: s + F.size(_words(x)))),
        "_grams": F.when(F.size("_words") < window, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size("_words") - window, F.lit(0))), lambda i: F.xxhash64(*[F.get("_words", i + j) for j in range(window)]))),
    })
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, k: F.coalesce((x["h"] == F.get("_sorted", k - 1)["h"]), F.lit(False)) | F.coalesce((x["h"] == F.get("_sorted", k + 1)["h"]), F.lit(False))
    rows = rows.withColumn("_places", F.sort_array(F.transform(F.filter("_sorted", same), lambda x: x["i"])))
    rows = rows.withColumn("_n_repeat_words", F.aggregate(F.transform("_places", lambda p, k: F.least(F.lit(window), F.coalesce(F.get("_places", k + 1), p + window) - p)), F.lit(0).cast("long"), lambda s, x: s + x))
    failed = (F.col("_n_words") < min_words) | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * repeat_percent)
    rows = rows.withColumns({"_base_failed": failed, "_kept": ~failed & (F.col("_removed_words") * 100 <= F.col("_n_words") * depleted_percent)})
    # Behind a generator no filter of a caller is pushed down: it would repeat the array expressions inside each other.
    found = F.explode(F.array(F.struct("_removed", *(f"_{n}" for n in COUNTS)))).alias("_found")
    return rows.select(*docs.columns, "_text", found).select(*docs.columns, "_text", "_found.*")


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """One row a document: id, counts, base_failed, removed_words and kept."""
    slim = docs.select(docs[limits.get("id_col", "doc_id")].alias("doc_id"), docs[limits.get("text_col", "text")].alias("text"), docs[limits.get("host_col", "source")].alias("source"))
    own = {k: v for k, v in limits.items() if not k.endswith("_col")}
    return judged(slim, **own).select("doc_id", *(F.col(f"_{n}").alias(n) for n in COUNTS))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The kept documents with all their columns; frequent lines are gone from their texts."""
    slim = docs.select(F.struct(*docs.columns).alias("row"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[host_col].alias("source"))
    rows = judged(slim, **limits).where("_kept")
    kept = F.array_join(F.filter(F.split("_text", "\n"), lambda x: ~F.array_contains("_removed", _line_hash(x))), "\n")
    text = F.when(F.size("_removed") == 0, F.col("text")).otherwise(kept)
    return rows.select("row", text.alias("text")).select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
l AS (SELECT rid, host, unnest(ls) AS raw, generate_subscripts(ls, 1) AS k FROM d),
n AS (SELECT rid, host, k, raw, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS line FROM l),
freq AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT rid) AS c FROM n GROUP BY ALL)
  JOIN (SELECT host, count(*) AS hd FROM d GROUP BY host) USING (host) WHERE c > 20 AND c > hd * 0.05),
gone AS (
  SELECT rid, sum(len(list_filter(regexp_split_to_array(raw, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS removed_words
  FROM n SEMI JOIN freq USING (host, line) GROUP BY rid),
g AS (SELECT rid, i, w[i:i+7] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, sum(s) AS n_repeat_words FROM (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS s FROM r) GROUP BY rid),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND removed_words * 100 <= n_words * 50 AS kept FROM f
"""
