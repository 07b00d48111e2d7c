"""Filings and macro vintages from folders, as a batch or as a stream of the same rows.

    index/day=20240105/*.idx        lines of a daily index
    headers/day=20240105/*.json     one object a filing: accession, body
    pages/series_id=GDP/*.json      pages of observations of a series

A stream takes at most so many files a batch, in the order in which they came; its checkpoint moves only after a batch is
stored, and what a batch that is run again would repeat is known by its key. So it can stop anywhere and go on without loss or repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.scratch import exists
from tidemark.operators.facts import new_rows
from tidemark.sources import filings, macro

#: Index days of one batch at most: a day is a file.
DAYS = 5
HEADERS = "accession string, body string, day string"
FILINGS = "accession string, cik long, company string, form string, filed date, accepted timestamp, period string, documents int, error string"
FILING_KEY = ("accession", "cik")
OBSERVATION_KEY = ("series_id", "observation_date", "vintage_start")


def headers_of(spark: SparkSession, folder: str, days: DataFrame | None = None) -> DataFrame:
    """accession and body; of the days (a frame of one column) only their partitions are read."""
    if not exists(spark, f"{folder}/headers"):
        return spark.createDataFrame([], HEADERS).drop("day")
    rows = spark.read.schema(HEADERS).json(f"{folder}/headers")
    return (rows if days is None else rows.where(F.col("day").isin([r[0] for r in days.collect()]))).select("accession", "body")


def filing_rows(lines: DataFrame, headers: DataFrame, forms: Sequence[str] = ()) -> DataFrame:
    """Filings of index lines with what their headers tell; `forms` are those that are wanted, all if none are named.

    Each filing stands once, however often the index lists it. One without a header, or whose header lacks or contradicts something, has an error instead of its fields; so
    has one that was accepted at a local time that is no single instant, or under another form.
    """
    entries = filings.distinct_filings(filings.parse_index(lines))
    if forms:
        entries = entries.where(F.col("form").isin(list(forms)))
    wanted = headers.join(entries.select("accession").distinct(), "accession", "left_semi").groupBy("accession").agg(F.min("body").alias("body"))
    told = filings.parse_headers(wanted).select("accession", F.col("form").alias("_form"), "accepted", "period", F.size("documents").alias("documents"), F.col("error").alias("_error"), F.lit(True).alias("_there"))
    met = entries.join(told, "accession", "left").withColumn("_at", filings.eastern_to_utc(F.col("accepted")))
    error = F.when(F.col("_there").isNull(), "no header").when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("_form") != F.col("form"), "another form").when(F.col("_at").isNull(), "no single instant of acceptance")
    met = met.withColumn("error", error)
    sound = {c: F.when(F.col("error").isNull(), F.col(x)).alias(c) for c, x in (("accepted", "_at"), ("period", "period"), ("documents", "documents"))}
    return met.select(*FILING_KEY, "company", "form", "filed", *sound.values(), "error")


def filing_table(spark: SparkSession, folder: str, forms: Sequence[str] = ()) -> DataFrame:
    """All filings of a folder, as a batch."""
    return filing_rows(filings.index_lines(spark, f"{folder}/index"), headers_of(spark, folder), forms)


def append_new(batch: DataFrame, target: str, key: tuple[str, ...]) -> None:
    """Appends the rows whose key the target lacks."""
    spark = batch.sparkSession
    there = spark.read.schema(batch.schema).parquet(target) if exists(spark, target) else spark.createDataFrame([], batch.schema)
    new_rows(batch, there, key).write.mode("append").parquet(target)


def filing_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, forms: Sequence[str] = (), days: int = DAYS) -> StreamingQuery:
    """Appends new filings of a folder to the table at `target`, `days` index files a batch, until there are no more. Headers are read of the batch's own days."""
    lines = spark.readStream.schema("value string, day string").option("maxFilesPerTrigger", days).text(f"{folder}/index").select(F.col("value").alias("line"), "day")

    def store(batch: DataFrame, number: int) -> None:
        append_new(filing_rows(batch.select("line"), headers_of(spark, folder, batch.select("day").distinct()), forms), target, FILING_KEY)

    return lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_series(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of all series of a folder, with the series from the folder's name; a malformed page is refused."""
    return spark.read.schema(f"{macro.PAGE}, series_id string").option("mode", "FAILFAST").option("multiLine", True).json(f"{folder}/pages")


def page_gaps(pages: DataFrame) -> DataFrame:
    """Series whose pages do not tell all they count: series_id, expected, told. Pages that stand twice count once."""
    each = pages.groupBy("series_id", "offset").agg(F.max(F.size("observations")).alias("n"), F.max("count").alias("expected"))
    return each.groupBy("series_id").agg(F.max("expected").cast("long").alias("expected"), F.sum("n").alias("told")).where("told != expected")


def observation_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Appends new observations of a folder's pages, each vintage once."""
    pages = spark.readStream.schema(f"{macro.PAGE}, series_id string").option("maxFilesPerTrigger", files).option("mode", "FAILFAST").option("multiLine", True).json(f"{folder}/pages")

    def store(batch: DataFrame, number: int) -> None:
        append_new(macro.observations(batch), target, OBSERVATION_KEY)

    return pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
