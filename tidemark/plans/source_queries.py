"""Source files and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import new_folder
from tidemark.operators import text
from tidemark.plans.book import Book
from tidemark.plans.tables import table
from tidemark.sources import filings, flow, macro
from tidemark.streaming.ingest import windowed_counts

BOOK = Book()


def index_lines(spark, sf_dir: str) -> DataFrame:
    """Every order as a line of a daily index, every tenth twice, every 50th as a preamble."""
    o = table(spark, sf_dir, "orders")
    number = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    line = F.concat_ws("|", F.col("o_custkey").cast("string"), F.concat(F.lit("Company "), F.col("o_custkey").cast("string")), F.when(F.col("o_orderkey") % 3 == 0, "10-K").otherwise("8-K"), F.date_format("o_orderdate", "yyyyMMdd"), F.concat(F.lit("edgar/data/"), number, F.lit("-24-000001.txt")))
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, "CIK|Company Name|Form Type|Date Filed|File Name").otherwise(line).alias("line"))
    return rows.unionAll(rows.where("o_orderkey % 10 = 0")).select("line")


ENTRY = "en AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-24-000001' AS accession, o_custkey AS cik, 'Company ' || o_custkey AS company, CASE WHEN o_orderkey % 3 = 0 THEN '10-K' ELSE '8-K' END AS form, CAST(o_orderdate AS DATE) AS filed FROM orders WHERE o_orderkey % 50 <> 0)"


@BOOK.add("index_parse", f"WITH {ENTRY} SELECT accession, cik, any_value(company) AS company, any_value(form) AS form, any_value(filed) AS filed, count(*) + count(*) FILTER (o_orderkey % 10 = 0) AS n_rows FROM en GROUP BY accession, cik")
def index_parse(spark, sf_dir: str) -> DataFrame:
    return filings.distinct_filings(filings.parse_index(index_lines(spark, sf_dir)))


@BOOK.add("index_report", f"WITH {ENTRY}, g AS (SELECT accession, cik, count(*) + count(*) FILTER (o_orderkey % 10 = 0) AS n FROM en GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS rows_read, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(DISTINCT accession) AS accessions FROM g")
def index_report(spark, sf_dir: str) -> DataFrame:
    return filings.index_report(filings.parse_index(index_lines(spark, sf_dir)))


@BOOK.add("listing_parse", "SELECT 'master.' || strftime(d, '%Y%m%d') || '.idx' AS name, true AS is_daily, d AS day FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) UNION ALL SELECT 'sitemap.xml', false, NULL")
def listing_parse(spark, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit('{"name": "master.'), F.date_format("o_orderdate", "yyyyMMdd"), F.lit('.idx"}'))
    items = table(spark, sf_dir, "orders").select(name.alias("x")).distinct().agg(F.concat_ws(",", F.collect_list("x")).alias("x"))  # one entry a day
    return filings.parse_listing(items.select(F.concat(F.lit('{"directory": {"item": ['), "x", F.lit(', {"name": "sitemap.xml"}]}}')).alias("body")))


@BOOK.add("eastern_to_utc", "SELECT event_id, CAST(((strftime(ts, '%Y-%m-%d %H:%M:%S')::TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS TIMESTAMP) AS utc FROM events")
def eastern_to_utc(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyyMMddHHmmss").alias("raw"))
    told = filings.only_certain(e.withColumn("utc", filings.eastern_to_utc(F.col("raw"))), "raw", "utc")
    return told.select("event_id", F.col("utc").cast("timestamp_ntz").alias("utc"))


PAGES = "ob AS (SELECT user_id AS series_id, CAST(ts AS DATE) AS d, event_id, CASE WHEN event_type = 'error' THEN '.' ELSE CAST(CAST(value AS DECIMAL(20,4)) AS VARCHAR) END AS v FROM events)"


#: Events from which one page takes its observations.
PAGE_ROWS = 1000


def pages(spark, sf_dir: str) -> DataFrame:
    """The observations of each user in pages of bounded size."""
    day = F.date_format("ts", "yyyy-MM-dd")
    item = F.struct(day.alias("date"), day.alias("realtime_start"), F.when(F.col("event_id") % 2 == 0, "9999-12-31").otherwise(F.date_format(F.date_add("ts", 7), "yyyy-MM-dd")).alias("realtime_end"), F.when(F.col("event_type") == "error", ".").otherwise(F.col("value").cast("decimal(20,4)").cast("string")).alias("value"))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("series_id"), F.floor(F.col("event_id") / PAGE_ROWS).alias("page")).agg(F.collect_list(item).alias("observations")).drop("page")


@BOOK.add("observation_parse", f"WITH {PAGES} SELECT series_id, d AS observation_date, CASE WHEN v <> '.' THEN CAST(v AS DOUBLE) END AS value, v = '.' AS is_missing, CASE WHEN event_id % 2 = 1 THEN d + 7 END AS vintage_end, CAST((CAST(d + 1 AS TIMESTAMP) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS TIMESTAMP) AS knowledge_time FROM ob")
def observation_parse(spark, sf_dir: str) -> DataFrame:
    told = macro.observations(pages(spark, sf_dir))
    return told.select("series_id", "observation_date", F.col("value").cast("double").alias("value"), "is_missing", "vintage_end", F.col("knowledge_time").cast("timestamp_ntz").alias("knowledge_time"))


@BOOK.add("vintage_watermark", f"WITH {PAGES} SELECT series_id, count(*) AS n FROM ob WHERE series_id % 2 = 1 OR d > DATE '2024-01-15' GROUP BY series_id")
def vintage_watermark(spark, sf_dir: str) -> DataFrame:
    rows = macro.observations(pages(spark, sf_dir))
    seen = rows.where("series_id % 2 = 0").select("series_id", F.lit("2024-01-15").cast("date").alias("vintage")).distinct()
    return macro.newer(rows, seen).groupBy("series_id").agg(F.count("*").alias("n"))


@BOOK.add("windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def windowed(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", F.col("value").cast("decimal(20,4)").alias("value"))
    return windowed_counts(e).select("start", "event_type", "n", F.col("total").cast("double").alias("total"))


SPACE = r"[ \t\n\r\f\v]"


def cut_sql(at: str, most: int = 1000) -> str:
    """Where a chunk that begins after `at` characters ends: at the last border of the best rank in its window, from which white space that goes on beyond it is taken away."""
    window = f"CASE WHEN regexp_matches(substr(text, {at} + {most + 1}, 1), '{SPACE}') THEN regexp_replace(substr(text, {at} + 1, {most}), '{SPACE}+$', '') ELSE substr(text, {at} + 1, {most}) END"
    ranks = [rf"\n[ \t\r\f\v]*\n{SPACE}*", rf"[.!?…][\"''”’»)\]]*{SPACE}+", f"{SPACE}+"]
    ends = ", ".join(f"nullif(length(regexp_extract({window}, '(?s)^.*{r}')), 0)" for r in ranks)
    return f"CASE WHEN length(text) - {at} <= {most} THEN length(text) ELSE {at} + coalesce({ends}, {most}) END"


CHUNKS_SQL = f"""
WITH RECURSIVE c AS (
  SELECT doc_id, 0 AS chunk, 0 AS start, {cut_sql("0")} AS "end", text FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, chunk + 1, "end", {cut_sql('"end"')}, text FROM c WHERE "end" < length(text))
SELECT doc_id, chunk, start, "end", substr(text, start + 1, "end" - start) AS text FROM c
"""


@BOOK.add("chunking", CHUNKS_SQL)
def chunking(spark, sf_dir: str) -> DataFrame:
    return text.chunks(table(spark, sf_dir, "documents"), 1000)


@BOOK.add("chunk_tiling", "SELECT doc_id, sha256(text) AS sha, length(text) AS n FROM documents WHERE text <> ''")
def chunk_tiling(spark, sf_dir: str) -> DataFrame:
    """Chunks put together again."""
    parts = text.chunks(table(spark, sf_dir, "documents"), 1000).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "text", "end"))).alias("c"))
    return parts.select("doc_id", F.sha2(F.array_join("c.text", ""), 256).alias("sha"), F.element_at("c", -1)["end"].cast("long").alias("n"))


#: Names that the masking query masks besides times.
NAMES = [("COMPANY", "Apache Software Foundation"), ("COMPANY", "Creative Commons Corp"), ("PERSON", "Mary Ann Johnson"), ("TICKER", "MIT"), ("IDENTIFIER", "0000320193")]


@BOOK.add("mask")
def mask(spark, sf_dir: str) -> DataFrame:
    return text.masked(table(spark, sf_dir, "documents"), NAMES)


@BOOK.add(
    "leak_scan",
    """WITH run AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).?[0-9A-Za-z]+')) AS x FROM documents)
 SELECT doc_id, 'literal:license' AS kind, unnest(regexp_extract_all(text, '(?i)\\blicense\\b')) AS found FROM documents
 UNION ALL SELECT doc_id, 'date', unnest(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) FROM documents
 UNION ALL SELECT doc_id, 'quarter', unnest(regexp_extract_all(text, '(?i)\\bQ[1-4]\\b')) FROM documents
 UNION ALL SELECT doc_id, 'year', right(x, 4) FROM run WHERE regexp_full_match(x, '(?s)[^0-9A-Za-z.,$€£¥#]?(19|20)[0-9]{2}')""",
)
def leak_scan(spark, sf_dir: str) -> DataFrame:
    return text.leaks(table(spark, sf_dir, "documents"), ["license"])


def found_sql(kind: str, severity: str, pattern: str, found: str = "x", also: str = "true") -> str:
    """Matches of a pattern with their places: each stands after all gaps up to it and all matches before it. Of a match the last characters are the find."""
    lists = f"SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS s FROM documents"
    each = f"SELECT doc_id, unnest(m) AS x, unnest(s[1:len(m)]) AS gap, unnest(range(len(m))) AS i FROM ({lists})"
    ends = f"SELECT doc_id, x, sum(length(gap) + length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM ({each})"
    return f"""SELECT doc_id, '{kind}' AS kind, CAST(e - length({found}) AS INT) AS start, CAST(e AS INT) AS "end", '{severity}' AS severity, {found} AS found FROM ({ends}) WHERE {also}"""


FINDINGS_SQL = f"""
WITH f AS ({found_sql("literal:license", "LEAK", r"(?i)\blicense\b")} UNION ALL {found_sql("date", "LEAK", "[0-9]{4}-[0-9]{2}-[0-9]{2}")} UNION ALL {found_sql("quarter", "LEAK", r"(?i)\bQ[1-4]\b")}
UNION ALL {found_sql("year", "REVIEW", "(?s).?[0-9A-Za-z]+", "right(x, 4)", "regexp_full_match(x, '(?s)[^0-9A-Za-z.,$€£¥#]?(19|20)[0-9]{2}')")})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", kind) - 1 AS INT) AS n, kind, start, "end", severity, found FROM f
"""


@BOOK.add("leak_findings", FINDINGS_SQL)
def leak_findings(spark, sf_dir: str) -> DataFrame:
    return text.findings(table(spark, sf_dir, "documents"), ["license"])


@BOOK.add("content_hash", "SELECT doc_id, sha256(lang || '|' || text) AS key FROM documents")
def content_hash(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", "lang", "text"), 256).alias("key"))


@BOOK.add("validate_answers", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'not an object' WHEN 1 THEN 'unknown key' WHEN 2 THEN 'missing value' WHEN 3 THEN CASE WHEN value / 100 > 1 OR value < 0 THEN 'out of range' ELSE 'ok' END ELSE 'ok' END AS status FROM events")
def validate_answers(spark, sf_dir: str) -> DataFrame:
    body = F.expr("""CASE event_id % 6 WHEN 0 THEN '[1, 2]' WHEN 1 THEN '{"tone": 0, "confidence": 1, "topic": "a", "mood": 1}' WHEN 2 THEN '{"tone": 0, "topic": "a"}'
      WHEN 3 THEN concat('{"tone": 0.5, "confidence": ', cast(cast(value / 100 AS decimal(20,8)) AS string), ', "topic": "b"}') ELSE '{"tone": -1, "confidence": 0.25, "topic": "c"}' END""")
    return text.validated(table(spark, sf_dir, "events").select("event_id", body.alias("answer"))).select("event_id", "status")


@BOOK.add("cache_stats", "WITH c AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE doc_id % 2 = 0) SELECT count(*) AS calls, round(avg(CASE WHEN key IS NULL THEN 0.0 ELSE 1.0 END), 8) AS hit_rate FROM documents LEFT JOIN c ON sha256(text) = key")
def cache_stats(spark, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    cache = calls.where("doc_id % 2 = 0").select("key", F.lit("seen").alias("answer")).distinct()
    return text.with_cache(calls, cache)[1].withColumn("hit_rate", F.round("hit_rate", 8))


def filing_folder(spark, sf_dir: str) -> str:
    """A folder of indexes and headers by month: an index line an order, some of them twice; headers but for every 40th, of another form for every 41st, at a time that the clock skips for every 43rd."""
    folder, o = new_folder(spark, "filings"), table(spark, sf_dir, "orders")
    day, month = F.date_format("o_orderdate", "yyyyMMdd"), F.date_format("o_orderdate", "yyyyMM")
    accession = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("-24-000001"))
    form = F.when(F.col("o_orderkey") % 3 == 0, "10-K").otherwise("8-K")
    line = F.concat_ws("|", F.col("o_custkey").cast("string"), F.concat(F.lit("Company "), F.col("o_custkey").cast("string")), form, day, F.concat(F.lit("edgar/data/"), accession, F.lit(".txt")))
    lines = o.select(line.alias("value"), month.alias("day"), "o_orderkey")
    lines.unionAll(lines.where("o_orderkey % 10 = 0")).drop("o_orderkey").repartition("day").write.partitionBy("day").text(f"{folder}/index")
    accepted = F.when(F.col("o_orderkey") % 43 == 0, "20240310023000").otherwise(F.concat(day, F.lit("1200"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0")))
    told = F.when(F.col("o_orderkey") % 41 == 0, "NT 10-K").otherwise(form)
    body = F.concat(F.lit("<ACCEPTANCE-DATETIME>"), accepted, F.lit("\n<TYPE>"), told, F.lit("\n<FILING-DATE>"), day, F.lit("\n<PERIOD>"), F.date_format("o_orderdate", "yyyyMM"), F.lit("\n<DOCUMENT>\n<TYPE>"), form, F.lit("\n<SEQUENCE>1\n<FILENAME>a.htm\n</DOCUMENT>\n"))
    o.where("o_orderkey % 40 != 0").select(accession.alias("accession"), body.alias("body"), month.alias("day")).repartition("day").write.partitionBy("day").json(f"{folder}/headers")
    return folder


FILINGS_SQL = """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 40 = 0 THEN 'no header' WHEN o_orderkey % 41 = 0 THEN 'another form' WHEN o_orderkey % 43 = 0 THEN 'no single instant of acceptance' END AS error FROM orders WHERE o_orderkey % 3 = 0)
SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-24-000001' AS accession, o_custkey AS cik, 'Company ' || o_custkey AS company, '10-K' AS form, CAST(o_orderdate AS DATE) AS filed,
  CASE WHEN error IS NULL THEN strftime(timezone('UTC', timezone('America/New_York', CAST(o_orderdate AS TIMESTAMP) + INTERVAL 12 HOUR + to_seconds(o_orderkey % 60))), '%Y-%m-%d %H:%M:%S') END AS accepted,
  CASE WHEN error IS NULL THEN strftime(o_orderdate, '%Y%m') END AS period, CASE WHEN error IS NULL THEN 1 END AS documents, error FROM o
"""


@BOOK.add("filing_table", FILINGS_SQL)
def filing_table(spark, sf_dir: str) -> DataFrame:
    """The annual reports of a folder of indexes and headers."""
    told = flow.filing_table(spark, filing_folder(spark, sf_dir), ("10-K",))
    return told.withColumn("accepted", F.date_format("accepted", "yyyy-MM-dd HH:mm:ss"))
