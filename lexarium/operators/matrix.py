"""Matrices as (i, j, v) rows. Absent cells are 0. Dense algebra of small matrices is numpy's, behind a size check."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and columns a matrix may have for the dense routines, which run on the driver.
DENSE = 2000


def add(a: DataFrame, b: DataFrame, x: float = 1.0, y: float = 1.0) -> DataFrame:
    """x a + y b."""
    both = a.select("i", "j", (F.col("v") * x).alias("v")).unionByName(b.select("i", "j", (F.col("v") * y).alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def multiply_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "w"), ["i", "j"]).select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """a b: a join on the inner index, summed with map-side combining."""
    right = b.select(F.col("i").alias("k"), F.col("j"), F.col("v").alias("w"))
    return a.select("i", F.col("j").alias("k"), "v").join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def sums(a: DataFrame, axis: str = "i") -> DataFrame:
    return a.groupBy(axis).agg(F.sum("v").alias("v"))


def normalize(a: DataFrame, axis: str = "i", power: int = 1) -> DataFrame:
    """Rows (i) or columns (j) divided by their sum or Euclidean norm."""
    s = F.sum(F.abs("v") ** power).over(Window.partitionBy(axis))
    size = s if power == 1 else F.sqrt(s)
    return a.withColumn("v", F.when(size == 0, 0.0).otherwise(F.col("v") / size))


def trace(a: DataFrame) -> DataFrame:
    return a.where("i = j").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("trace"))


def frobenius(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("norm"))


def dense(a: DataFrame) -> np.ndarray:
    """The matrix on the driver; refuses one beyond DENSE."""
    n = a.agg(F.max("i"), F.max("j")).first()
    if n[0] is None:
        return np.zeros((0, 0))
    if max(n) >= DENSE:
        raise ValueError(f"{n[0] + 1} x {n[1] + 1} is too large for a dense routine")
    out = np.zeros((n[0] + 1, n[1] + 1))
    for i, j, v in a.select("i", "j", "v").collect():
        out[i, j] = v
    return out


def rows(spark, m: np.ndarray) -> DataFrame:
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(x), int(y), float(m[x, y])) for x, y in zip(i, j, strict=True)], "i long, j long, v double")


def determinant(a: DataFrame) -> float:
    return float(np.linalg.det(dense(a)))


def inverse(a: DataFrame) -> DataFrame:
    return rows(a.sparkSession, np.linalg.inv(dense(a)))


def power(a: DataFrame, n: int) -> DataFrame:
    return rows(a.sparkSession, np.linalg.matrix_power(dense(a), n))


def solve(a: DataFrame, b: list[float]) -> list[float]:
    """Least-squares solution of a x = b, which is the exact one where there is one."""
    return np.linalg.lstsq(dense(a), np.array(b), rcond=None)[0].tolist()


def qr(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    q, r = np.linalg.qr(dense(a))
    return rows(a.sparkSession, q), rows(a.sparkSession, r)


def lu(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unit lower and upper factors without pivoting; fails on a zero pivot."""
    u = dense(a)
    low = np.eye(len(u))
    for k in range(len(u)):
        if u[k, k] == 0:
            raise ZeroDivisionError("zero pivot")
        low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return rows(a.sparkSession, low), rows(a.sparkSession, u)


def eigenvalues(a: DataFrame) -> list[float]:
    return sorted(np.linalg.eigvals(dense(a)).real.tolist(), reverse=True)


def rank(a: DataFrame) -> int:
    return int(np.linalg.matrix_rank(dense(a)))
