"""Files and folders of any store that Spark can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length) of all files below a folder."""
    store, place = _store(spark, path)
    found, rows = store.listFiles(place, recursive), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toString(), f.getLen()))
    return spark.createDataFrame(sorted(rows), "path string, length long")


def make(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.mkdirs(place)


def move(spark: SparkSession, source: str, target: str) -> bool:
    store, place = _store(spark, source)
    return store.rename(place, _store(spark, target)[1])


def copy(spark: SparkSession, source: str, target: str) -> bool:
    (a, x), (b, y) = _store(spark, source), _store(spark, target)
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(a, x, b, y, False, spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a file or a folder with all below it; False where there is none."""
    store, place = _store(spark, path)
    return store.delete(place, True)
