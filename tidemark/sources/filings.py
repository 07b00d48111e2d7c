"""Filing indexes and headers from text files, as DataFrames. Lines are rows, so a file may be of any size."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.batches import of_texts
from tidemark.operators.facts import refuse

ACCESSION = "^[0-9]{10}-[0-9]{2}-[0-9]{6}$"
EASTERN = "America/New_York"


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def parse_index(lines: DataFrame) -> DataFrame:
    """Rows of five fields whose first is a number: cik, company, form, filed, accession, path.  Others are preamble."""
    parts = F.split("line", "\\|", -1)
    rows = lines.select(F.transform(parts, lambda x: F.trim(x)).alias("p")).where((F.size("p") == 5) & F.element_at("p", 1).rlike("^[0-9]+$"))
    at = lambda k: F.element_at("p", k)
    accession = F.regexp_replace(F.element_at(F.split(at(5), "/"), -1), "\\.txt$", "")
    told = rows.select(at(1).cast("long").alias("cik"), at(2).alias("company"), at(3).alias("form"), F.try_to_timestamp(at(4), F.lit("yyyyMMdd")).cast("date").alias("filed"), accession.alias("accession"), at(5).alias("path"))
    told = refuse(told, F.col("filed").isNull(), "a filing date that is no date")
    return refuse(told, ~F.col("accession").rlike(ACCESSION), "a row without an accession number")


def distinct_filings(entries: DataFrame) -> DataFrame:
    """One row an accession and filer, with how often it occurs; rows that contradict each other are refused."""
    told = entries.groupBy("accession", "cik").agg(F.count("*").alias("n_rows"), F.min(F.struct("path", "company", "form", "filed")).alias("e"), F.min(F.struct("form", "filed")).alias("a"), F.max(F.struct("form", "filed")).alias("b"))
    told = refuse(told, F.col("a") != F.col("b"), "two rows describe one filing in two ways")
    return told.select("accession", "cik", "e.company", "e.form", "e.filed", "n_rows")


def index_report(entries: DataFrame) -> DataFrame:
    by = entries.groupBy("accession", "cik").agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("rows_read"), F.sum(F.col("n") - 1).alias("duplicates"), F.countDistinct("accession").alias("accessions"))


def parse_listing(listings: DataFrame) -> DataFrame:
    """Names of daily index files in quarter listings (JSON text in `body`), with their day; other names are counted by is_daily."""
    item = F.from_json("body", "directory struct<item: array<struct<name: string>>>", {"mode": "FAILFAST"})
    names = listings.select(F.explode(item["directory"]["item"]["name"]).alias("name"))
    day = F.regexp_extract("name", "^master\\.([0-9]{8})\\.idx$", 1)
    return names.select("name", (day != "").alias("is_daily"), F.try_to_timestamp(F.when(day != "", day), F.lit("yyyyMMdd")).cast("date").alias("day"))


def eastern_to_utc(text: Column) -> Column:
    """A local time of fourteen digits as a UTC instant; null where the clock skips or repeats it, since no one reading is right."""
    local = F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))
    utc = F.to_utc_timestamp(local, EASTERN)
    # Of a repeated hour the other reading is an hour later and shows the same clock; a skipped time does not come back.
    back = lambda x: F.date_format(F.from_utc_timestamp(x, EASTERN), "yyyyMMddHHmmss")
    hour = F.expr("INTERVAL 1 HOUR")
    single = (back(utc) == text) & (back(utc + hour) != text) & (back(utc - hour) != text)
    return F.when(single, utc)


def only_certain(df: DataFrame, raw: str, instant: str) -> DataFrame:
    return refuse(df, F.col(raw).isNotNull() & F.col(instant).isNull(), "a local time that the clock skips or repeats")


TAG = re.compile(r"<(/?)([A-Z][A-Z0-9-]*)>(.*)")
HEADER = "accession string, form string, accepted string, filed string, period string, declared int, documents array<struct<sequence: int, type: string, filename: string, description: string>>, error string"


def parse_headers(headers: DataFrame) -> DataFrame:
    """headers (accession, body) to their fields: the first of each tag, and the manifest of <DOCUMENT> blocks. A header that lacks or contradicts something has an error instead."""

    def one(accession: str, body: str) -> tuple:
        fields: dict[str, str] = {}
        documents: list[dict[str, str]] = []
        inside: dict[str, str] | None = None
        for line in html.unescape(body or "").splitlines():
            if not (m := TAG.match(line.strip())):
                continue
            closing, tag, value = m[1] == "/", m[2], m[3].strip()
            if tag == "DOCUMENT":
                if closing and inside is not None:
                    documents.append(inside)
                inside = None if closing else {}
            elif not closing:
                (fields if inside is None else inside).setdefault(tag, value)
        error = next((f"no {t}" for t in ("ACCEPTANCE-DATETIME", "TYPE", "FILING-DATE") if not fields.get(t)), None)
        if fields.get("ACCESSION-NUMBER", accession) != accession:
            error = "another accession"
        for d in documents:
            if not d.get("TYPE") or not d.get("FILENAME") or not d.get("SEQUENCE", "").isdigit():
                error = error or "an incomplete document block"
        count = fields.get("PUBLIC-DOCUMENT-COUNT", "")
        listed = None if error else [{"sequence": int(d["SEQUENCE"]), "type": d["TYPE"], "filename": d["FILENAME"], "description": d.get("DESCRIPTION") or None} for d in documents]
        return accession, fields.get("TYPE"), fields.get("ACCEPTANCE-DATETIME"), fields.get("FILING-DATE"), fields.get("PERIOD"), int(count) if count.isdigit() else None, listed, error

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([one(a, b) for a, b in zip(batch["accession"], batch["body"], strict=True)], columns=["accession", "form", "accepted", "filed", "period", "declared", "documents", "error"])

    return of_texts(headers.select("accession", "body")).mapInPandas(run, HEADER)


#: Fixed value: where the public archive lies.
ARCHIVE = "https://www.sec.gov/Archives/edgar"


def listing_url(year: Column, quarter: Column) -> Column:
    """Of a quarter's directory of daily indexes; a quarter that is none fails."""
    ok = quarter.between(1, 4)
    return F.when(ok, F.concat(F.lit(f"{ARCHIVE}/daily-index/"), year.cast("string"), F.lit("/QTR"), quarter.cast("string"), F.lit("/index.json"))).when(~ok, F.raise_error(F.lit("a quarter is 1 to 4")).cast("string"))


def index_url(day: Column, name: Column) -> Column:
    """Of a daily index whose name a listing gave; the day says in which quarter it lies."""
    return F.concat(F.lit(f"{ARCHIVE}/daily-index/"), F.year(day).cast("string"), F.lit("/QTR"), F.quarter(day).cast("string"), F.lit("/"), name)


def header_url(cik: Column, accession: Column) -> Column:
    """Of a filing's header; an accession number of another form fails."""
    plain = F.regexp_replace(accession, "-", "")
    ok = accession.rlike("^[0-9]{10}-[0-9]{2}-[0-9]{6}$")
    return F.when(ok, F.concat(F.lit(f"{ARCHIVE}/data/"), cik.cast("string"), F.lit("/"), plain, F.lit("/"), accession, F.lit("-index-headers.html"))).when(~ok, F.raise_error(F.lit("not an accession number")).cast("string"))
