"""Sinks, sources and the streaming counter, over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexarium.operators import counters as C
from lexarium.plans.registry import query
from lexarium.session import shared_dir
from lexarium.sources import readers, sinks
from lexarium.streaming import counts


@query("SELECT event_type AS key, count(*)::DOUBLE AS cnt FROM events GROUP BY 1")
def counter_file_round_trip(t):
    path = f"{shared_dir(t.spark)}/{uuid.uuid4().hex}"
    sinks.counter(C.count(t.events.withColumnRenamed("event_type", "key"), "key"), path)
    return readers.counter(t.spark, path)


@query("SELECT user_id::VARCHAR AS outer, event_type AS inner, count(*)::DOUBLE AS cnt FROM events GROUP BY ALL".replace("AS outer", 'AS "outer"').replace("AS inner", 'AS "inner"'))
def counter_map_file_round_trip(t):
    path = f"{shared_dir(t.spark)}/{uuid.uuid4().hex}"
    sinks.text(sinks.counter_map_lines(C.count(t.events.select(F.col("user_id").alias("outer"), F.col("event_type").alias("inner")), "outer", "inner")), path)
    return readers.counter_map(t.spark, path)


@query("SELECT l_orderkey || ' Q0 ' || l_partkey || ' ' || row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_partkey) || ' ' || printf('%.6f', s) || ' base' AS value FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS s FROM lineitem GROUP BY ALL)")
def trec_run_lines(t):
    run = t.lineitem.groupBy(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc")).agg(F.sum("l_quantity").alias("score"))
    return sinks.trec_lines(run, "base").select("value")


@query("SELECT label || ' ' || array_to_string(list_transform(list_filter(range(1, 65), lambda i: embedding[i] <> 0), lambda i: i || ':' || printf('%.6f', embedding[i]::DOUBLE)), ' ') AS value FROM embeddings")
def svm_lines(t):
    return sinks.svm_lines(t.embeddings.select("label", F.col("embedding").cast("array<double>").alias("v")))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_column(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT nullif(c_mktsegment, 'MACHINERY') AS segment, count(*) AS n FROM customer GROUP BY 1")
def null_markers(t):
    from lexarium.functions.strings import null_markers as marked

    return t.customer.select(marked(F.col("c_mktsegment"), "machinery").alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS cnt FROM events GROUP BY ALL")
def streaming_window_counts(t):
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(t.path)
    return counts.drained(counts.windowed_counts(stream, "event_type"), ["start", "event_type"])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS cnt FROM events GROUP BY ALL")
def batch_window_counts(t):
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), "event_type", "cnt")
