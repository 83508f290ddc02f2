"""Structured Streaming ingest of event tables, which the batch operators don't have: each file's lines once, and late events by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierloom.functions.text import wall_micros
from tierloom.sources import canonical


def stream_lines(spark: SparkSession, path: str, checkpoint: str, good: str, bad: str):
    """Canonicalizes JSONL files as they come: events are appended to ``good``, malformed lines to ``bad``. Returns the query."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.jsonl*").load(path)
    parts = F.split(F.decode("content", "ISO-8859-1"), "\n")  # one character a byte, so that no byte is lost
    lines = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.posexplode(parts).alias("line_index", "line"))
    lines = lines.select("file", F.col("line_index").cast("bigint").alias("line_index"), F.encode("line", "ISO-8859-1").alias("raw")).filter(F.octet_length("raw") > 0)

    def each(batch: DataFrame, number: int) -> None:
        events = canonical.canonicalize(batch).persist()
        events.filter("error is null").write.mode("append").parquet(good)
        events.filter("error is not null").select("file", "line_index", "error", "residual").write.mode("append").parquet(bad)
        events.unpersist()

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events and their mean value per window and type; what comes later than ``late`` is left out of a stream's windows."""
    rows = events.withColumn("at", F.timestamp_micros(wall_micros(F.col("ts")))).withWatermark("at", late)
    return rows.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("events"), F.avg("value").alias("mean_value"))
