"""Queries: scans, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.plans.registry import query
from larkspur.sources import scans
from larkspur.sources.views import table
from larkspur.streaming import events as streaming


@query("csv_scan_pruned", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS o_totalprice FROM orders")
def csv_scan_pruned(spark, sf_dir):
    path = scans.scratch(spark, "orders-csv")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    scans.write_csv(rows, path)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"
    return scans.read_csv(spark, path, schema, ["o_orderkey", "o_totalprice"])


@query("resumable_sink", "SELECT event_id, event_type FROM events")
def resumable_sink(spark, sf_dir):
    path = scans.scratch(spark, "events-chunks")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    scans.write_chunks(rows.where("event_id % 3 = 0"), path, "event_id")
    scans.write_chunks(rows, path, "event_id")
    return spark.read.schema(rows.schema).parquet(path)


@query("best_run", "SELECT min_by(o_orderpriority, (v, o_orderpriority)) AS best, round(min(v), 6) AS value FROM (SELECT o_orderpriority, avg(o_totalprice) AS v FROM orders GROUP BY 1)")
def best_run(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("v"))
    return runs.agg(F.min_by("o_orderpriority", F.struct("v", "o_orderpriority")).alias("best"), F.round(F.min("v"), 6).alias("value"))


@query("stream_windowed_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    source = scans.scratch(spark, "events-stream")
    rows.write.parquet(source)
    schema = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    plan = lambda x: streaming.windowed_counts(x, "1 day", "2 days")
    out = streaming.run_to_end(spark, source, schema, plan, scans.scratch(spark, "events-out"), scans.scratch(spark, "events-state"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
