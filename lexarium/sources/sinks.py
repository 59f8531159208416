"""Writers of counters, runs and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def text(df: DataFrame, path: str, column: str = "value", compression: str = "gzip", append: bool = False) -> None:
    df.select(F.col(column).alias("value")).write.mode("append" if append else "error").option("compression", compression).text(path)


def counter(df: DataFrame, path: str) -> None:
    """key TAB count, largest first within globally sorted parts."""
    df.orderBy(F.desc("cnt"), "key").select("key", "cnt").write.csv(path, sep="\t")


def counter_map_lines(df: DataFrame) -> DataFrame:
    """'outer:sum TAB inner:cnt ...', inner counts largest first."""
    cell = F.struct((-F.col("cnt")).alias("n"), F.col("inner").alias("k"))
    g = df.groupBy("outer").agg(F.sum("cnt").alias("s"), F.array_sort(F.collect_list(cell)).alias("cells"))
    return g.select(F.concat_ws("\t", F.concat_ws(":", "outer", F.col("s").cast("string")), F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["k"], (-c["n"]).cast("string"))), "\t")).alias("value"))


def trec_lines(run: DataFrame, name: str) -> DataFrame:
    """'qid Q0 doc rank score run'."""
    ranked = run.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc")))
    return ranked.select("qid", "rank", F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), F.col("doc").cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", "score"), F.lit(name)).alias("value"))


def svm_lines(df: DataFrame, label: str = "label", vec: str = "v") -> DataFrame:
    """'label idx:val ...' of non-zero values, places from 1."""
    cells = F.filter(F.transform(F.col(vec), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), lambda c: c["x"] != 0)
    return df.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_join(F.transform(cells, lambda c: F.concat(c["i"].cast("string"), F.lit(":"), F.format_string("%.6f", c["x"]))), " ")).alias("value"))


def jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.mode("overwrite").option("truncate", True).format("jdbc").options(url=url, dbtable=table, **options).save()
