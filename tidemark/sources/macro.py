"""Vintages of macroeconomic series from JSON pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.facts import refuse

PAGE = "count int, offset int, limit int, observations array<struct<date: string, realtime_start: string, realtime_end: string, value: string>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from JSON files whose schema is stated, never inferred; a malformed file is refused."""
    return spark.read.schema(PAGE).option("mode", "FAILFAST").option("multiLine", True).json(path)


def knowledge_time(vintage: Column) -> Column:
    """Midnight in New York at the end of the vintage's day, as a UTC instant."""
    return F.to_utc_timestamp(F.date_add(vintage, 1).cast("timestamp"), "America/New_York")


def open_end(text: Column) -> Column:
    """A date; null if it is `.` or the far end of time."""
    day = F.when(text != ".", F.to_date(text))
    return F.when(day < F.lit("9999-12-31").cast("date"), day)


def observations(pages: DataFrame, series: str = "series_id") -> DataFrame:
    """pages (series_id, observations) to one row a value: `.` is missing, anything else must be a finite decimal."""
    flat = pages.select(series, F.explode("observations").alias("o"))
    text = F.trim("o.value")
    told = flat.select(
        series,
        F.to_date("o.date").alias("observation_date"),
        F.when(text != ".", F.expr("try_cast(trim(o.value) AS decimal(38,10))")).alias("value"),
        (text == ".").alias("is_missing"),
        F.to_date("o.realtime_start").alias("vintage_start"),
        open_end(F.col("o.realtime_end")).alias("vintage_end"),
    )
    told = refuse(told, ~F.col("is_missing") & F.col("value").isNull(), "a value that is no finite decimal")
    return told.withColumn("knowledge_time", knowledge_time(F.col("vintage_start")))


def newer(rows: DataFrame, watermarks: DataFrame, key: str = "series_id") -> DataFrame:
    """Rows of vintages beyond the watermark (key, vintage) of their series; a series without one is all new."""
    return rows.join(watermarks.select(key, F.col("vintage").alias("_seen")), key, "left").where("_seen IS NULL OR vintage_start > _seen").drop("_seen")


def has_more(offset: Column, n: Column, count: Column) -> Column:
    return offset + n < count
