"""Record shapes: papers, organizations, dictionaries of short forms, and settings of runs."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attributes(blocks: DataFrame, sep: str = ":\t") -> DataFrame:
    """(fields map) of blocks whose lines are 'key<sep>value'; the first of equal keys counts."""
    pair = lambda x: F.struct(F.substring_index(x, sep, 1).alias("k"), F.substring(x, F.length(F.substring_index(x, sep, 1)) + len(sep) + 1, F.length(x)).alias("v"))
    cells = blocks.select(F.transform(F.filter("lines", lambda x: F.contains(x, F.lit(sep))), pair).alias("p"))
    first = F.filter("p", lambda x, i: F.array_position(F.transform("p", lambda y: y["k"]), x["k"]) == i + 1)
    return cells.select(F.map_from_entries(F.transform(first, lambda x: F.struct(x["k"], x["v"]))).alias("fields"))


def papers(meta: DataFrame) -> DataFrame:
    """Nested papers from attribute maps: authors and subjects are lists at semicolons."""
    part = lambda k: F.filter(F.transform(F.split(F.coalesce(F.col("fields")[k], F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return meta.select(F.col("fields")["id"].alias("id"), F.col("fields")["title"].alias("title"), part("authors").alias("authors"), F.col("fields")["abs"].alias("abs"), part("subjects").alias("subjects"))


def organizations(blocks: DataFrame) -> DataFrame:
    """(name, variants) of blocks whose first line is 'name TAB ...' and whose others are variants, united by name."""
    rows = blocks.select(F.substring_index(F.get("lines", 0), "\t", 1).alias("name"), F.slice("lines", F.lit(2), F.size("lines")).alias("v"))
    return rows.select("name", F.explode_outer("v").alias("v")).groupBy("name").agg(F.array_sort(F.collect_set("v")).alias("variants"))


def short_forms(blocks: DataFrame) -> DataFrame:
    """(short, word, p) of blocks 'short form' and lines 'word TAB count': each short form's distribution of words."""
    rows = blocks.select(F.get("lines", 0).alias("short"), F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("l"))
    cells = rows.select("short", F.substring_index("l", "\t", 1).alias("word"), F.substring_index("l", "\t", -1).cast("double").alias("c"))
    return cells.select("short", "word", (F.col("c") / F.sum("c").over(Window.partitionBy("short"))).alias("p"))


@dataclass
class Settings:
    """Twelve settings of a feedback run; ``parse`` reads them from a run's name, in order, behind its first part."""

    top_k: int = 1000
    fb_iters: int = 10
    fb_docs: int = 5
    fb_words: int = 25
    mu: float = 2000.0
    mix_coll: float = 0.5
    doc_prior: bool = False
    doubled: bool = False
    wiki: bool = False
    mix_fb: float = 0.5
    smoothed: bool = False
    rerank: bool = False

    @classmethod
    def parse(cls, name: str) -> Settings:
        out = cls()
        for f, x in zip(fields(cls), name.split("_")[1:], strict=False):
            kind = type(getattr(out, f.name))
            setattr(out, f.name, x.lower() == "true" if kind is bool else kind(float(x)))
        return out


def run_statistics(lines: DataFrame, column: str = "value") -> DataFrame:
    """(query, mean mixture of every collection) of search-log lines 'qid=... coll=... mix=...'."""
    get = lambda k: F.regexp_extract(column, rf"{k}=(\S+)", 1)
    rows = lines.select(get("qid").alias("qid"), get("coll").alias("coll"), get("mix").cast("double").alias("mix")).where("qid <> ''")
    names = [r.coll for r in rows.select("coll").distinct().orderBy("coll").limit(1000).collect()]  # a row a collection
    return rows.groupBy("qid").pivot("coll", names).agg(F.avg("mix"))
