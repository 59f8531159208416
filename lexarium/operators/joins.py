"""Joins on order and ranges, as sorts and equi-joins on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row at or before it, within ``by``; null where there is none.

    One union, one sort within ``by`` and a running last value, so nothing is paired.
    """
    rest = [c for c in left.columns if c not in (by, order)]
    a = left.select(by, order, F.struct(*rest).alias("_row"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(by, order, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(by).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(by, order, "_row.*", F.col("_v").alias(value))


def within(left: DataFrame, right: DataFrame, by: str, order: str, width: int) -> DataFrame:
    """Pairs of rows of equal ``by`` whose right time is at most ``width`` seconds behind the left one.

    Times are cut into cells of that width; a right row can only meet left rows of its own and the previous cell, so
    the join is an equi-join on cells. Right columns get the suffix _r.
    """
    cell = (F.unix_micros(F.col(order).cast("timestamp")) / (width * 1_000_000)).cast("long")
    a = left.withColumn("_c", F.explode(F.array(cell, cell + 1)))
    b = right.select([F.col(c).alias(f"{c}_r") for c in right.columns]).withColumn("_c", (F.unix_micros(F.col(f"{order}_r").cast("timestamp")) / (width * 1_000_000)).cast("long"))
    gap = F.unix_micros(F.col(f"{order}_r").cast("timestamp")) - F.unix_micros(F.col(order).cast("timestamp"))
    return a.join(b, (F.col(by) == F.col(f"{by}_r")) & (a["_c"] == b["_c"])).where((gap >= 0) & (gap <= width * 1_000_000)).drop("_c")


def sessions(df: DataFrame, by: str, order: str, gap: int) -> DataFrame:
    """(by, start, end, n) of runs of rows that lie less than ``gap`` seconds apart."""
    t = F.unix_micros(F.col(order).cast("timestamp"))
    w = Window.partitionBy(by).orderBy(order)
    new = F.when(t - F.lag(t).over(w) < gap * 1_000_000, 0).otherwise(1)
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_new", new).withColumn("_i", island).groupBy(by, "_i").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("_i")
