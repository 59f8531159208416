"""Readers of text collections, topics, judgments and runs as DataFrames.

Suffixes .gz and .bz2 are decompressed by Spark. Marker strings for missing values become null. Parsers work on
columns, so a file of any size is split over tasks where its format allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexarium.functions import strings as S


def lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = spark.read.text(path)
    return df if limit is None else df.limit(limit)


def whole_texts(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, value): each file as one row."""
    return spark.read.option("recursiveFileLookup", recursive).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Records of non-empty lines, separated by empty ones: (lines)."""
    df = spark.read.text(path, lineSep="\n\n")
    return df.select(F.filter(F.split("value", "\n"), lambda x: x != "").alias("lines")).where(F.size("lines") > 0)


def counter(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", quote="", schema="key string, cnt double")


def counter_map(spark: SparkSession, path: str) -> DataFrame:
    """(outer, inner, cnt) of lines 'outer:sum TAB inner:cnt ...'; the sum is not kept."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    cells = parts.select(F.regexp_extract(F.get("p", 0), "^(.*):", 1).alias("outer"), F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("c"))
    return cells.select("outer", F.regexp_extract("c", "^(.*):", 1).alias("inner"), F.substring_index("c", ":", -1).cast("double").alias("cnt"))


def tsv(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Tab-separated strings; 'null' and 'empty' are null, <NL> is a newline."""
    df = spark.read.csv(path, sep="\t", quote="", schema=", ".join(f"`{c}` string" for c in columns))
    return df.select(*[F.replace(S.null_markers(F.col(c)), F.lit("<NL>"), F.lit("\n")).alias(c) for c in columns])


def svm(spark: SparkSession, path: str) -> DataFrame:
    """(label, cells) of 'label idx:val ...' lines; cells are (i, x), places from 1."""
    parts = spark.read.text(path).select(F.split("value", " ").alias("p"))
    cell = lambda c: F.struct(F.substring_index(c, ":", 1).cast("int").alias("i"), F.substring_index(c, ":", -1).cast("double").alias("x"))
    return parts.select(F.get("p", 0).alias("label"), F.transform(F.slice("p", F.lit(2), F.size("p")), cell).alias("cells"))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).agg(F.count("*").alias("n"))


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of a tag as rows; attributes come as _name."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def topics(spark: SparkSession, path: str) -> DataFrame:
    """(qid, type, description, summary, diagnosis) of topic elements."""
    df = xml_rows(spark, path, "topic", "_number string, _type string, description string, summary string, diagnosis string")
    return df.select(F.col("_number").alias("qid"), F.col("_type").alias("type"), "description", "summary", "diagnosis")


def tagged(spark: SparkSession, path: str, first: str = ".I") -> DataFrame:
    """(id, fields map) of records whose lines '.X' name the field of the lines behind; '.I id' starts one."""
    records = spark.read.text(path, lineSep=f"\n{first} ").select(F.regexp_replace("value", rf"^\{first} ", "").alias("r")).where("trim(r) <> ''")
    split = F.split("r", r"\n(?=\.[A-Z]\b)")
    pairs = F.transform(F.slice(split, F.lit(2), F.size(split)), lambda x: F.struct(F.substring(x, 2, 1), F.trim(F.substring(x, F.lit(3), F.length(x)), F.lit(" \n\t"))))
    return records.select(F.trim(F.get(split, 0)).alias("id"), F.map_from_entries(pairs).alias("fields"))


def fixed_width_topics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim(F.substring("value", 1, 3)).alias("qid"), F.expr("trim(substring(value, 5))").alias("text"))


def judgments(spark: SparkSession, path: str, style: str = "plain") -> DataFrame:
    """(qid, doc, rel): plain 'qid _ doc rel'; judged 'qid ui doc judge...' kept where all judges agree (d 2, p 1);
    labelled with RELEVANT in the fifth column and # comments."""
    cols = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").select(F.split(F.trim("value"), r"\s+").alias("c"))
    if style == "plain":
        return cols.select(F.get("c", 0).alias("qid"), F.get("c", 2).alias("doc"), F.get("c", 3).cast("double").alias("rel"))
    if style == "labelled":
        return cols.select(F.get("c", 0).alias("qid"), F.get("c", 1).alias("doc"), (F.get("c", 4) == "RELEVANT").cast("double").alias("rel"))
    votes = F.array_distinct(F.filter(F.slice("c", F.lit(4), F.size("c")), lambda x: x != ""))
    rel = F.when(F.get(votes, 0) == "d", 2.0).when(F.get(votes, 0) == "p", 1.0).otherwise(0.0)
    return cols.where(F.size(votes) == 1).select(F.get("c", 0).alias("qid"), F.get("c", 2).alias("doc"), rel.alias("rel"))


def run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="qid string, doc string, score double")


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, text, redirect) of page elements."""
    df = xml_rows(spark, path, "page", "title string, revision struct<text: string>")
    text = F.col("revision.text")
    target = F.regexp_extract(text, r"(?i)^\s*#redirect\s*\[\[([^\]|#]+)", 1)
    return df.select("title", text.alias("text"), F.when(target != "", target).alias("redirect"))


def sgml_documents(spark: SparkSession, path: str) -> DataFrame:
    """(docno, text) of <DOC> records."""
    docs = spark.read.text(path, lineSep="</DOC>").where(F.contains("value", F.lit("<DOCNO>")))
    return docs.select(F.trim(F.regexp_extract("value", r"(?s)<DOCNO>(.*?)</DOCNO>", 1)).alias("docno"), S.strip_html(F.regexp_replace("value", r"(?s)^.*?</DOCNO>", "")).alias("text"))


def crawl_dump(spark: SparkSession, path: str) -> DataFrame:
    """(uid, date, url, content) of #UID/#DATE/#URL/#CONTENT/#EOR records."""
    r = spark.read.text(path, lineSep="#EOR").where(F.contains("value", F.lit("#UID:")))
    field = lambda n: F.trim(F.regexp_extract("value", rf"#{n}:([^\n]*)", 1))
    return r.select(field("UID").alias("uid"), field("DATE").alias("date"), field("URL").alias("url"), S.strip_html(F.regexp_extract("value", r"(?s)#CONTENT:(.*)$", 1)).alias("content"))


def outline(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """(page, chapter, section, title) of nested lists: lines of one, two and three asterisks; chapter prefixes go."""
    rows = pages.select(page, F.posexplode(F.split(text, "\n")).alias("line", "value")).withColumn("depth", F.length(F.regexp_extract("value", r"^(\*+)", 1)))
    rows = rows.where("depth > 0").withColumn("name", S.strip_chapter(F.regexp_replace("value", r"^\*+\s*", "")))
    w = Window.partitionBy(page).orderBy("line")
    at = lambda d: F.last(F.when(F.col("depth") == d, F.col("name")), ignorenulls=True).over(w)
    return rows.withColumns({"chapter": at(1), "section": at(2)}).where("depth = 3").select(page, "chapter", "section", F.col("name").alias("title"))


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
