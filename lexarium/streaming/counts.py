"""Streaming counters: the batch counters over a stream with event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.session import shared_dir


def windowed_counts(stream: DataFrame, key: str, time: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts of a key in tumbling or sliding windows; rows later than the watermark are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    out = stream.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("cnt"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), key, "cnt")


def drained(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Run a bounded stream of counts to its end and return each key's last count, from tables in the shared folder.

    Updates of each batch are written by the executors, so nothing passes through the driver; a batch that is run again
    writes its own table again.
    """
    path = f"{shared_dir(counts.sparkSession)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/out/number={number}")

    q = counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return counts.sparkSession.read.parquet(f"{path}/out").groupBy(*keys).agg(F.max_by("cnt", "batch").alias("cnt"))
