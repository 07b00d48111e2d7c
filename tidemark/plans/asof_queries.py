"""Queries over versioned facts: every table in them is read as of one instant."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import new_folder
from tidemark.operators import facts as B
from tidemark.operators.intervals import interval_join, versions_at
from tidemark.operators.store import MonthStore
from tidemark.plans.book import Book
from tidemark.plans.tables import AS_OF, EVENT_FACTS, EVENTS, event_facts, table, visible_sql

BOOK = Book()
VIS = f"WITH {EVENT_FACTS}, {visible_sql()}"
OUT = "entity, CAST(valid_from AS DATE) AS day, value"


def asof(spark, sf_dir: str) -> B.AsOf:
    anchor = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"))
    return B.AsOf(spark, AS_OF).with_facts(event_facts(spark, sf_dir), EVENTS).with_plain("anchor", anchor)


ANCHOR = "anchor AS (SELECT c_custkey AS entity, c_mktsegment AS segment FROM customer)"


@BOOK.add("asof_visible", f"{VIS} SELECT {OUT} FROM vis")
def asof_visible(spark, sf_dir: str) -> DataFrame:
    return asof(spark, sf_dir).table("event_facts", ("value",)).select("entity", F.to_date("valid_from").alias("day"), "value")


@BOOK.add(
    "asof_history_flip",
    f"WITH {EVENT_FACTS}, {visible_sql('a', '2024-01-10')}, {visible_sql('b', '2024-01-20')} SELECT coalesce(a.entity, b.entity) AS entity, CAST(coalesce(a.valid_from, b.valid_from) AS DATE) AS day, a.value AS before, b.value AS after FROM a FULL JOIN b ON a.entity = b.entity AND a.valid_from = b.valid_from WHERE a.value IS DISTINCT FROM b.value",
)
def asof_history_flip(spark, sf_dir: str) -> DataFrame:
    """Facts that two instants tell differently."""
    facts = event_facts(spark, sf_dir)
    a, b = (B.visible(facts, EVENTS, dt.datetime(2024, 1, day, tzinfo=dt.UTC), ("value",)).withColumnRenamed("value", name) for day, name in ((10, "before"), (20, "after")))
    both = a.join(b, ["entity", "valid_from"], "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select("entity", F.to_date("valid_from").alias("day"), "before", "after")


SHAPES = {
    "asof_join": (
        "SELECT e.entity, CAST(e.valid_from AS DATE) AS day, e.value, a.segment FROM event_facts e JOIN anchor a ON e.entity = a.entity",
        f"{VIS}, {ANCHOR} SELECT e.entity, CAST(e.valid_from AS DATE) AS day, e.value, a.segment FROM vis e JOIN anchor a ON e.entity = a.entity",
    ),
    "asof_self_join": (
        "SELECT a.entity, CAST(a.valid_from AS DATE) AS day, b.value - a.value AS change FROM event_facts a JOIN event_facts b ON a.entity = b.entity AND b.valid_from = a.valid_from + INTERVAL 1 DAY",
        f"{VIS} SELECT a.entity, CAST(a.valid_from AS DATE) AS day, b.value - a.value AS change FROM vis a JOIN vis b ON a.entity = b.entity AND b.valid_from = a.valid_from + INTERVAL 1 DAY",
    ),
    "asof_cte": (
        "WITH m AS (SELECT entity, max(value) AS top FROM event_facts GROUP BY entity), n AS (SELECT entity, top FROM m WHERE top > 50) SELECT e.entity, CAST(e.valid_from AS DATE) AS day, n.top FROM event_facts e JOIN n ON e.entity = n.entity AND e.value = n.top",
        f"{VIS}, m AS (SELECT entity, max(value) AS top FROM vis GROUP BY entity), n AS (SELECT entity, top FROM m WHERE top > 50) SELECT e.entity, CAST(e.valid_from AS DATE) AS day, n.top FROM vis e JOIN n ON e.entity = n.entity AND e.value = n.top",
    ),
    "asof_subquery": ("SELECT entity, count(*) AS n FROM (SELECT * FROM event_facts WHERE value > 10) s GROUP BY entity", f"{VIS} SELECT entity, count(*) AS n FROM (SELECT * FROM vis WHERE value > 10) s GROUP BY entity"),
    "asof_exists": (
        "SELECT a.entity, a.segment FROM anchor a WHERE EXISTS (SELECT 1 FROM event_facts e WHERE e.entity = a.entity AND e.value > 20)",
        f"{VIS}, {ANCHOR} SELECT a.entity, a.segment FROM anchor a WHERE EXISTS (SELECT 1 FROM vis e WHERE e.entity = a.entity AND e.value > 20)",
    ),
    "asof_in": ("SELECT a.entity, a.segment FROM anchor a WHERE a.entity IN (SELECT entity FROM event_facts WHERE value > 20)", f"{VIS}, {ANCHOR} SELECT a.entity, a.segment FROM anchor a WHERE a.entity IN (SELECT entity FROM vis WHERE value > 20)"),
    "asof_not_in": ("SELECT a.entity FROM anchor a WHERE a.entity NOT IN (SELECT entity FROM event_facts WHERE entity IS NOT NULL)", f"{VIS}, {ANCHOR} SELECT a.entity FROM anchor a WHERE a.entity NOT IN (SELECT entity FROM vis WHERE entity IS NOT NULL)"),
    "asof_union": ("SELECT entity FROM event_facts WHERE value > 50 UNION SELECT entity FROM event_facts WHERE value < 5", f"{VIS} SELECT entity FROM vis WHERE value > 50 UNION SELECT entity FROM vis WHERE value < 5"),
    "asof_intersect": ("SELECT entity FROM event_facts WHERE value > 50 INTERSECT SELECT entity FROM event_facts WHERE value < 5", f"{VIS} SELECT entity FROM vis WHERE value > 50 INTERSECT SELECT entity FROM vis WHERE value < 5"),
    "asof_scalar_subquery": (
        "SELECT e.entity, CAST(e.valid_from AS DATE) AS day, (SELECT count(*) FROM event_facts) AS n FROM event_facts e WHERE e.knowledge_time = (SELECT max(x.knowledge_time) FROM event_facts x WHERE x.entity = e.entity)",
        f"{VIS} SELECT e.entity, CAST(e.valid_from AS DATE) AS day, (SELECT count(*) FROM vis) AS n FROM vis e WHERE e.knowledge_time = (SELECT max(x.knowledge_time) FROM vis x WHERE x.entity = e.entity)",
    ),
    "asof_group_max": (
        "SELECT a.segment, max(g.top) AS top, sum(g.n) AS n FROM (SELECT entity, max(value) AS top, count(*) AS n FROM event_facts GROUP BY entity) g JOIN anchor a ON a.entity = g.entity GROUP BY a.segment",
        f"{VIS}, {ANCHOR} SELECT a.segment, max(g.top) AS top, CAST(sum(g.n) AS BIGINT) AS n FROM (SELECT entity, max(value) AS top, count(*) AS n FROM vis GROUP BY entity) g JOIN anchor a ON a.entity = g.entity GROUP BY a.segment",
    ),
    "asof_top": ("SELECT entity, CAST(valid_from AS DATE) AS day, value FROM event_facts ORDER BY value DESC, entity, valid_from LIMIT 10", f"{VIS} SELECT {OUT} FROM vis ORDER BY value DESC, entity, valid_from LIMIT 10"),
    "asof_distinct": ("SELECT DISTINCT CAST(valid_from AS DATE) AS day FROM event_facts", f"{VIS} SELECT DISTINCT CAST(valid_from AS DATE) AS day FROM vis"),
}


def _shape(text: str):
    return lambda spark, sf_dir: asof(spark, sf_dir).sql(text)


for _name, (_text, _sql) in SHAPES.items():
    BOOK.add(_name, _sql)(_shape(_text))


@BOOK.add("asof_interval_lookup", f"{VIS} SELECT {OUT} FROM vis WHERE valid_from <= TIMESTAMP '2024-01-12 06:00:00' AND valid_to > TIMESTAMP '2024-01-12 06:00:00'")
def asof_interval_lookup(spark, sf_dir: str) -> DataFrame:
    found = asof(spark, sf_dir).table("event_facts", ("value", "valid_to"))
    return B.in_force(found, F.lit("2024-01-12 06:00:00").cast("timestamp_ntz")).select("entity", F.to_date("valid_from").alias("day"), "value")


@BOOK.add("asof_range_scan", f"{VIS} SELECT {OUT} FROM vis WHERE valid_from BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'")
def asof_range_scan(spark, sf_dir: str) -> DataFrame:
    found = asof(spark, sf_dir).table("event_facts", ("value",))
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    return found.where(F.col("valid_from").between(day("2024-01-05"), day("2024-01-09"))).select("entity", F.to_date("valid_from").alias("day"), "value")


@BOOK.add(
    "asof_baseline_join",
    f"WITH {EVENT_FACTS}, r AS (SELECT entity, valid_from, max(knowledge_time) AS knowledge_time, max(seq) AS seq FROM event_facts GROUP BY 1, 2) SELECT r.entity, CAST(r.valid_from AS DATE) AS day, r.seq, (SELECT b.seq FROM r b WHERE b.entity = r.entity AND b.valid_from < r.valid_from AND b.knowledge_time <= r.knowledge_time ORDER BY b.valid_from DESC, b.seq DESC LIMIT 1) AS baseline FROM r",
)
def asof_baseline_join(spark, sf_dir: str) -> DataFrame:
    """Each row with the latest earlier one that was known when it was learned."""
    rows = event_facts(spark, sf_dir).groupBy("entity", "valid_from").agg(F.max("knowledge_time").alias("knowledge_time"), F.max("seq").alias("seq"))
    return B.baseline_of(rows, ("entity",)).select("entity", F.to_date("valid_from").alias("day"), "seq", "baseline")


OPEN = f"""{EVENT_FACTS}, open AS (SELECT entity, min(valid_from) AS valid_from, TIMESTAMP '9999-12-31 23:59:59.999999' AS valid_to, min(knowledge_time) AS knowledge_time, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS value FROM event_facts GROUP BY entity)"""


def open_facts(spark, sf_dir: str) -> DataFrame:
    return event_facts(spark, sf_dir).groupBy("entity").agg(F.min("valid_from").alias("valid_from"), F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz").alias("valid_to"), F.min("knowledge_time").alias("knowledge_time"), F.sum(F.round(F.col("value") * 100).cast("long")).cast("double").alias("value"), F.lit(False).alias("is_retraction"))


NEW = "TIMESTAMP '2024-02-20 00:00:00'"


@BOOK.add("supersede_close", f"WITH {OPEN} SELECT entity, valid_from, TIMESTAMP '2024-02-15 00:00:00' AS valid_to, {NEW} AS knowledge_time, value FROM open")
def supersede_close(spark, sf_dir: str) -> DataFrame:
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return B.close_interval(open_facts(spark, sf_dir), EVENTS, at("2024-02-15 00:00:00"), at("2024-02-20 00:00:00")).drop("is_retraction")


@BOOK.add(
    "supersede_open",
    f"WITH {OPEN} SELECT entity, valid_from, TIMESTAMP '2024-02-15 00:00:00' AS valid_to, {NEW} AS knowledge_time, value FROM open UNION ALL SELECT entity, TIMESTAMP '2024-02-15 00:00:00', valid_to, {NEW}, value + 1 FROM open",
)
def supersede_open(spark, sf_dir: str) -> DataFrame:
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return B.supersede(open_facts(spark, sf_dir), EVENTS, at("2024-02-15 00:00:00"), at("2024-02-20 00:00:00"), {"value": F.col("value") + 1}).drop("is_retraction")


@BOOK.add("retract_visible", f"WITH {OPEN} SELECT entity, value FROM open WHERE entity % 3 <> 0")
def retract_visible(spark, sf_dir: str) -> DataFrame:
    """After the facts of every third entity are withdrawn, the others are what is visible."""
    facts = open_facts(spark, sf_dir)
    gone = B.retract(facts.where("entity % 3 = 0"), EVENTS, F.lit("2024-02-20 00:00:00").cast("timestamp_ntz"))
    return B.visible(facts.unionByName(gone), B.FactSpec("open", ("entity",), ("value",)), dt.datetime(2024, 3, 1, tzinfo=dt.UTC), ("value",)).select("entity", "value")


@BOOK.add("payload_violations", f"WITH {EVENT_FACTS} SELECT seq, 'observation without required payload' AS reason FROM event_facts WHERE NOT is_retraction AND CASE WHEN seq % 50 = 0 THEN NULL ELSE value END IS NULL UNION ALL SELECT seq, 'retraction with payload' FROM event_facts WHERE is_retraction AND seq % 7 = 0")
def payload_violations(spark, sf_dir: str) -> DataFrame:
    """Facts with payload removed and added by rule; what breaks the contract."""
    value = F.when(F.col("is_retraction") & (F.col("seq") % 7 == 0), 1.0).when(~F.col("is_retraction") & (F.col("seq") % 50 == 0), None).otherwise(F.col("value"))
    return B.violations(event_facts(spark, sf_dir).withColumn("value", value), EVENTS).select("seq", "reason")


@BOOK.add("idempotent_append", f"WITH {EVENT_FACTS} SELECT entity, count(*) AS n FROM (SELECT DISTINCT entity, valid_from, knowledge_time, seq FROM event_facts WHERE seq % 2 = 1) GROUP BY entity")
def idempotent_append(spark, sf_dir: str) -> DataFrame:
    """What a batch adds of which every row comes twice and half is there already."""
    facts = event_facts(spark, sf_dir)
    return B.new_rows(facts.unionAll(facts), facts.where("seq % 2 = 0"), ("entity", "valid_from", "knowledge_time", "seq")).groupBy("entity").agg(F.count("*").alias("n"))


@BOOK.add(
    "event_versions",
    f"""WITH {EVENT_FACTS}, p AS (SELECT event_id, user_id, ts, ts - INTERVAL 1 DAY AS at FROM events),
    m AS (SELECT p.event_id, f.value, f.is_retraction, CAST(f.valid_from AS DATE) AS day, row_number() OVER (PARTITION BY p.event_id, f.valid_from ORDER BY f.knowledge_time DESC, f.seq DESC) AS rn FROM p JOIN event_facts f ON f.entity = p.user_id AND f.valid_from <= p.at AND p.at < f.valid_to AND f.knowledge_time <= p.ts)
    SELECT p.event_id, m.day, m.value FROM p LEFT JOIN m ON m.event_id = p.event_id AND m.rn = 1 AND NOT m.is_retraction""",
)
def event_versions(spark, sf_dir: str) -> DataFrame:
    """Each event with what was known at its time of its user's fact of the day before."""
    ts = F.col("ts").cast("timestamp_ntz")
    points = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity"), ts.alias("known"), (ts - F.expr("INTERVAL 1 DAY")).alias("at"))
    told = versions_at(points, event_facts(spark, sf_dir), EVENTS, columns=("value",), how="left")
    return told.select("event_id", F.to_date("valid_from").alias("day"), "value")


@BOOK.add(
    "lines_in_transit",
    "SELECT a.s AS supplier, a.day, count(*) AS n, CAST(sum(CAST(b.l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity FROM (SELECT DISTINCT l_suppkey AS s, CAST(l_shipdate AS DATE) AS day FROM lineitem) a JOIN lineitem b ON b.l_suppkey = a.s AND CAST(b.l_shipdate AS DATE) <= a.day AND a.day < CAST(b.l_shipdate AS DATE) + 30 GROUP BY 1, 2",
)
def lines_in_transit(spark, sf_dir: str) -> DataFrame:
    """By supplier and day on which it sent something: the lines that it sent in the last thirty days, and their pieces."""
    line, day = table(spark, sf_dir, "lineitem"), F.to_date("l_shipdate")
    points = line.select(F.col("l_suppkey").alias("supplier"), day.alias("day")).distinct()
    spans = line.select(F.col("l_suppkey").alias("supplier"), day.alias("sent"), F.date_add(day, 30).alias("got"), F.col("l_quantity").cast("decimal(12,2)").alias("l_quantity"))
    return interval_join(points, spans, ("supplier",), "day", "sent", "got").groupBy("supplier", "day").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@BOOK.add("store_range_scan", f"{VIS} SELECT {OUT} FROM vis WHERE valid_from >= TIMESTAMP '2024-01-05' AND valid_from < TIMESTAMP '2024-01-10'")
def store_range_scan(spark, sf_dir: str) -> DataFrame:
    """A range of facts from the month store, after two batches that overlap, a compaction between them and late versions after it."""
    facts, at = event_facts(spark, sf_dir), dt.datetime(2024, 1, 8, tzinfo=dt.UTC)
    store = MonthStore(spark, new_folder(spark, "store"), EVENTS, facts.schema)
    store.append(facts.where("seq % 3 != 0"))
    store.compact(at)
    store.append(facts)
    store.compact(at)
    found = store.read(AS_OF, dt.datetime(2024, 1, 5, tzinfo=dt.UTC), dt.datetime(2024, 1, 10, tzinfo=dt.UTC), ("value",))
    return found.select("entity", F.to_date("valid_from").alias("day"), "value")
