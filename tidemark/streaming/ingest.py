"""Incremental ingestion: files become versions of facts, each once, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.facts import FactSpec
from tidemark.operators.store import MonthStore


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, spec: FactSpec, max_files: int = 100) -> StreamingQuery:
    """Reads new files of a folder, refuses knowledge from the future, and appends to the month store at `target`. The checkpoint moves only after the append; what it repeats is known by its key."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        MonthStore(spark, target, spec, batch.schema).append(batch)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type in tumbling windows, for a batch or a stream with a watermark."""
    told = events.withWatermark("ts", late) if events.isStreaming else events
    return told.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
