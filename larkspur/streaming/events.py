"""Streaming forms (an extension): windowed counts with late data, and resumable enrichment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Events per type and window (tumbling, or sliding by ``slide``); later ones than ``late`` are left out."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of a user that end after ``gap`` without events."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return counted.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_end(spark: SparkSession, source: str, schema: str, plan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Read a folder of Parquet as a stream, apply ``plan``, write to a table in ``sink`` and return it.

    ``checkpoint`` remembers which files are done: a second run handles new files only.  In append mode
    each batch has a folder of its own, so a batch that is repeated after a failure replaces what it left.
    """
    stream = plan(spark.readStream.schema(schema).parquet(source))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(sink if mode == "complete" else f"{sink}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    out = spark.read.parquet(sink)
    return out if mode == "complete" else out.drop("batch")
