"""Universes over many dates, expectations, alert and prompt records, answers of models, units and addresses."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import canonical
from tidemark.operators import extraction, monitoring, transforms, universe
from tidemark.plans.book import Book
from tidemark.plans.ledger_queries import SAMPLES, samples
from tidemark.plans.research_queries import EXCHANGE, EXCHANGES, r
from tidemark.plans.tables import BARS, bars, table
from tidemark.sources import filings, trials

BOOK = Book()

DAYS = (dt.date(1997, 3, 1), dt.date(1997, 9, 1), dt.date(1998, 3, 1), dt.date(1998, 6, 1))
CRITERIA = universe.Criteria(EXCHANGES, 1400.0, 30000.0, 5)


def listings(spark, sf_dir: str) -> DataFrame:
    """Every supplier; each seventh is listed late, each ninth delisted early."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return s.withColumn("exchange", F.expr(EXCHANGE)).withColumns({"first_listed_on": F.when(F.col("id") % 7 == 0, F.lit(dt.date(1997, 9, 1))), "delisted_on": F.when(F.col("id") % 9 == 0, F.lit(dt.date(1998, 2, 28)))})


BUILT = f"""{BARS}, dd AS (SELECT unnest([{', '.join(f"DATE '{d}'" for d in DAYS)}]) AS rebalance_date), li AS (SELECT s_suppkey AS id, {EXCHANGE.replace('id ', 's_suppkey ')} AS exchange FROM supplier), cd AS (SELECT * FROM dd CROSS JOIN li WHERE (id % 7 <> 0 OR rebalance_date >= DATE '1997-09-01') AND (id % 9 <> 0 OR rebalance_date <= DATE '1998-02-28')),
 rk AS (SELECT rebalance_date, id, close, close * volume AS dollars, row_number() OVER (PARTITION BY rebalance_date, id ORDER BY date DESC) AS k FROM dd JOIN bars ON date BETWEEN rebalance_date - {universe.lookback_days(5) - 1} AND rebalance_date), ad AS (SELECT rebalance_date, id, max(CASE WHEN k = 1 THEN close END) AS price, CASE WHEN count(*) = 5 THEN median(dollars) END AS adv FROM rk WHERE k <= 5 GROUP BY 1, 2),
 bu AS (SELECT cd.*, price, adv, coalesce(exchange IN ('XNYS', 'XNAS', 'ARCX'), false) AS f1, coalesce(price >= 1400, false) AS f2, coalesce(adv >= 30000, false) AS f3 FROM cd LEFT JOIN ad USING (rebalance_date, id))"""


def built(spark, sf_dir: str) -> DataFrame:
    return universe.build(listings(spark, sf_dir), bars(spark, sf_dir), list(DAYS), CRITERIA, DAYS[-1])


@BOOK.add("universe_build", f"WITH {BUILT} SELECT rebalance_date, id, exchange, price, round(adv, 4) AS adv, concat_ws(',', CASE WHEN NOT f1 THEN 'exchange' END, CASE WHEN NOT f2 THEN 'price' END, CASE WHEN NOT f3 THEN 'adv' END) AS failed FROM bu")
def universe_build(spark, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).select("rebalance_date", "id", "exchange", "price", r("adv", 4).alias("adv"), F.array_join("failed_filters", ",").alias("failed"))


@BOOK.add("universe_history_waterfall", f"WITH {BUILT} SELECT rebalance_date, 'exchange' AS screen, count(*) FILTER (NOT f1) AS removed, count(*) FILTER (f1) AS remaining FROM bu GROUP BY 1 UNION ALL SELECT rebalance_date, 'price', count(*) FILTER (f1 AND NOT f2), count(*) FILTER (f1 AND f2) FROM bu GROUP BY 1 UNION ALL SELECT rebalance_date, 'adv', count(*) FILTER (f1 AND f2 AND NOT f3), count(*) FILTER (f1 AND f2 AND f3) FROM bu GROUP BY 1")
def universe_history_waterfall(spark, sf_dir: str) -> DataFrame:
    return universe.waterfall(built(spark, sf_dir), by=("rebalance_date",)).select("rebalance_date", "screen", "removed", "remaining")


@BOOK.add("universe_snapshot_latest", f"WITH {BUILT} SELECT rebalance_date, count(*) AS n, rebalance_date <> DATE '1997-03-01' AS rebuilt FROM bu GROUP BY rebalance_date")
def universe_snapshot_latest(spark, sf_dir: str) -> DataFrame:
    """A store of two builds, one under other criteria and one after the cutoff."""
    rows, at = built(spark, sf_dir), lambda n: dt.datetime(1998, 7, n, tzinfo=dt.UTC)
    store = universe.snapshots(rows, CRITERIA, at(1)).unionAll(universe.snapshots(rows.where(F.col("rebalance_date") != F.lit(DAYS[0])), CRITERIA, at(2)))
    store = store.unionAll(universe.snapshots(rows, universe.Criteria(EXCHANGES, 1.0, 1.0, 5), at(3))).unionAll(universe.snapshots(rows, CRITERIA, at(9)))
    told = universe.latest_snapshots(store, CRITERIA.digest(), at(5))
    return told.groupBy("rebalance_date").agg(F.count("*").alias("n"), F.max(F.col("as_of") == F.lit(at(2))).alias("rebuilt"))


EXPECTED_ROWS = [line.split() for line in transforms.EXPECTED.strip().splitlines()]
FACTORS = [*(f for f, *_ in EXPECTED_ROWS), "unheard_of"]
EXPECTED_SQL = ", ".join(f"('{f}', {1 if s == '+' else -1}, {a}, {b})" for f, s, a, b in EXPECTED_ROWS)


@BOOK.add(
    "expectation_report",
    f"""WITH ex(factor, s, low, high) AS (VALUES {EXPECTED_SQL}), e AS (SELECT list_extract({FACTORS}, CAST(1 + user_id % {len(FACTORS)} AS BIGINT)) AS factor, CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS x FROM events),
    pm AS (SELECT factor, round((sum(x) / count(x) - 5000) / 50000.0, 9) AS premium, round((sum(x) / count(x) - 5000) / 100.0, 9) AS t FROM e GROUP BY factor)
    SELECT factor, premium, CASE WHEN s IS NULL THEN 'not expected' WHEN premium IS NULL THEN 'not measured' WHEN abs(t) < 2 THEN 'none' WHEN sign(premium) <> s THEN 'opposite' WHEN NOT premium BETWEEN low AND high THEN 'out of range' ELSE 'reproduces' END AS verdict FROM pm LEFT JOIN ex USING (factor)""",
)
def expectation_report(spark, sf_dir: str) -> DataFrame:
    """Users stand for factors and how far their values lie from fifty for what was measured."""
    name = F.element_at(F.array(*map(F.lit, FACTORS)), (1 + F.col("user_id") % len(FACTORS)).cast("int"))
    e = table(spark, sf_dir, "events").select(name.alias("factor"), F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("long")).alias("x"))
    apart = F.sum("x") / F.count("x") - 5000
    premia = e.groupBy("factor").agg(F.round(apart / 50000.0, 9).alias("premium"), F.round(apart / 100.0, 9).alias("t"))
    return transforms.against_expectations(premia, transforms.expectations(spark)).select("factor", "premium", "verdict")


@BOOK.add("drift_report", f"WITH {SAMPLES}, n AS (SELECT feature, count(x) AS n FROM rf GROUP BY 1), m AS (SELECT feature, count(x) AS m FROM ob WHERE feature <> 'view' GROUP BY 1) SELECT feature, coalesce(n, 0) AS n_reference, coalesce(m, 0) AS n_observed, CASE WHEN coalesce(n, 0) = 0 THEN 'no reference' WHEN coalesce(m, 0) = 0 THEN 'nothing observed' WHEN n < 360 THEN 'too few reference rows' ELSE 'measured' END AS status FROM n FULL JOIN m USING (feature)")
def drift_report(spark, sf_dir: str) -> DataFrame:
    reference, observed = samples(spark, sf_dir)
    return monitoring.drift_report(reference, observed.where("feature != 'view'"), 10).select("feature", "n_reference", "n_observed", "status")


@BOOK.add("alert_states", "SELECT event_id AS alert_id, CAST(CASE WHEN event_id % 2 = 0 THEN 1 + event_id % 3 ELSE 0 END AS BIGINT) AS attempts, CASE WHEN event_id % 7 = 0 THEN 'acknowledged' WHEN event_id % 6 = 0 THEN 'delivered' WHEN event_id % 2 = 0 THEN 'failing' ELSE 'new' END AS state FROM events WHERE event_type = 'error'")
def alert_states(spark, sf_dir: str) -> DataFrame:
    raised = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("alert_id"), F.col("ts").alias("raised_at"))
    tries = raised.where("alert_id % 2 = 0").select("alert_id", F.explode(F.sequence(F.lit(0), (F.col("alert_id") % 3).cast("int"))).alias("k"), "raised_at")
    attempts = tries.select("alert_id", F.col("raised_at").alias("at"), (F.col("alert_id") % 6 == 0).alias("ok"))
    return monitoring.alert_states(raised, attempts, raised.where("alert_id % 7 = 0").select("alert_id", F.col("raised_at").alias("at"))).select("alert_id", "attempts", "state")


@BOOK.add("alert_record", "SELECT DISTINCT 'user:' || user_id AS dedup FROM events WHERE event_type = 'error' AND user_id % 5 <> 0")
def alert_record(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("dedup"), F.lit("WARNING").alias("severity"), F.col("event_type").alias("detail"), F.col("ts").alias("raised_at"), "user_id")
    store = e.select("dedup", F.when(F.col("user_id") % 5 != 0, F.col("raised_at")).alias("acknowledged_at"))
    return monitoring.recorded_alerts(e.drop("user_id"), store).select("dedup")


@BOOK.add("history_page", "SELECT event_id AS id, ts AS at FROM events WHERE (ts, event_id) < (SELECT (ts, event_id) FROM events ORDER BY ts DESC, event_id DESC LIMIT 1 OFFSET 49) ORDER BY ts DESC, event_id DESC LIMIT 50")
def history_page(spark, sf_dir: str) -> DataFrame:
    """The second page of fifty events, newest first."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("at"))
    last = monitoring.page_of_history(rows, 50).collect()[-1]
    return monitoring.page_of_history(rows, 50, after=(last["at"], last["id"]))


@BOOK.add("weekday_counts", "SELECT o_orderkey, (SELECT count(*) FROM range(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) + 1, INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5) AS n FROM orders")
def weekday_counts(spark, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", monitoring.weekdays(day, F.date_add(day, (F.col("o_orderkey") % 40).cast("int"))).alias("n"))


ANSWER = """CASE doc_id % 7 WHEN 0 THEN '[]' WHEN 1 THEN '{"added": [], "removed": [], "retained_count": 1, "confidence": 0.5, "more": 1}' WHEN 2 THEN '{"added": [], "removed": null, "retained_count": 1, "confidence": 0.5}'
  WHEN 3 THEN '{"added": ["x"], "removed": [], "retained_count": 1.5, "confidence": 0.5}' WHEN 4 THEN '{"added": ["x"], "removed": [], "retained_count": 2, "confidence": "0.5"}' WHEN 5 THEN '{"added": ["x"], "removed": [], "retained_count": -1, "confidence": 0.5}' ELSE '{"added": ["x", "y"], "removed": ["z"], "retained_count": 3, "confidence": 1}' END"""


@BOOK.add("answer_forms", "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'not an object' WHEN 1 THEN 'unknown key' WHEN 2 THEN 'missing value' WHEN 3 THEN 'wrong type' WHEN 4 THEN 'wrong type' WHEN 5 THEN 'out of range' ELSE 'ok' END AS status, CASE WHEN doc_id % 7 = 6 THEN 3 END AS retained FROM documents")
def answer_forms(spark, sf_dir: str) -> DataFrame:
    told = extraction.parsed(table(spark, sf_dir, "documents").select("doc_id", F.expr(ANSWER).alias("answer")), extraction.FORMS["risk_set"])
    return told.select("doc_id", "status", F.col("value.retained_count").cast("int").alias("retained"))


@BOOK.add("extraction_run", "SELECT doc_id, 0 AS chunk, 'ok' AS status, doc_id % 2 = 0 AS cached FROM documents WHERE length(text) BETWEEN 1 AND 200 AND NOT regexp_matches(text, '[0-9]') AND NOT regexp_matches(text, '(?i)(today|yesterday|tomorrow|ago|year|quarter|month|week|day|period|january|february|march|april|june|july|august|september|october|november|december|apache|creative|johnson|mit)')")
def extraction_run(spark, sf_dir: str) -> DataFrame:
    """Short plain documents through mask, chunks, cache, a stand-in for a model, and the check of what it says."""
    docs = table(spark, sf_dir, "documents").where(F.length("text").between(1, 200) & ~F.col("text").rlike("[0-9]") & ~F.col("text").rlike("(?i)(today|yesterday|tomorrow|ago|year|quarter|month|week|day|period|january|february|march|april|june|july|august|september|october|november|december|apache|creative|johnson|mit)"))
    said = lambda prompt: F.format_string('{"added": [], "removed": [], "retained_count": %d, "confidence": 0.5}', F.length(prompt))
    form, template = extraction.FORMS["risk_set"], "Compare: {text}."
    first = extraction.extracted(docs.where("doc_id % 2 = 0"), template, form, said)
    ids = docs.select("doc_id")
    told = extraction.extracted(docs, template, form, said, first.select("key", "answer"))
    return told.join(ids, "doc_id").select("doc_id", "chunk", "status", (F.col("cached") & (F.col("doc_id") % 2 == 0)).alias("cached"))


@BOOK.add("filing_deltas", "WITH f AS (SELECT o_orderkey AS seq, o_custkey AS cik, o_orderkey % 2 AS form, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) AS k FROM orders) SELECT seq, CASE WHEN k = 1 THEN 'no comparison' WHEN seq % 3 = 0 THEN 'unanswered' WHEN seq % 3 = 1 THEN 'measured' ELSE 'rejected' END AS outcome FROM f")
def filing_deltas(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("cik"), (F.col("o_orderkey") % 2).alias("form"), F.col("o_orderkey").alias("valid_from"), F.col("o_orderkey").alias("knowledge_time"))
    from tidemark.operators.facts import baseline_of

    pairs = baseline_of(o, ("cik", "form"))
    good = '{"added": [], "removed": [], "retained_count": 1, "confidence": 1}'
    answers = pairs.where("seq % 3 != 0 AND baseline IS NOT NULL").select("seq", "baseline", F.when(F.col("seq") % 3 == 1, good).otherwise("{}").alias("answer"))
    return extraction.deltas(o, answers, extraction.FORMS["risk_set"]).select("seq", "outcome")


SAVED = "sv AS (SELECT source AS name, doc_id AS saved_at, lang || ' ' || (doc_id % 4) AS body FROM documents)"


@BOOK.add("prompt_versions", f"WITH {SAVED}, f AS (SELECT name, body, min(saved_at) AS saved_at FROM sv GROUP BY 1, 2) SELECT name, row_number() OVER (PARTITION BY name ORDER BY saved_at) AS version, saved_at, body FROM f")
def prompt_versions(spark, sf_dir: str) -> DataFrame:
    return extraction.prompt_versions(saved_prompts(spark, sf_dir)).select("name", "version", "saved_at", "body")


def saved_prompts(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.col("doc_id").alias("saved_at"), F.concat_ws(" ", "lang", (F.col("doc_id") % 4).cast("string")).alias("body"))


@BOOK.add("prompt_active", f"WITH {SAVED}, f AS (SELECT name, body, min(saved_at) AS saved_at FROM sv GROUP BY 1, 2), v AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY saved_at) AS version, body FROM f), m AS (SELECT name, max(version) - 1 AS version FROM v GROUP BY name HAVING max(version) > 1) SELECT name, version, body FROM v JOIN m USING (name, version)")
def prompt_active(spark, sf_dir: str) -> DataFrame:
    """Each prompt's last version is activated, then rolled back by one."""
    versions = extraction.prompt_versions(saved_prompts(spark, sf_dir))
    last = versions.groupBy("name").agg(F.max("version").alias("version")).where("version > 1")
    log = last.select("name", "version", F.lit(1).alias("sequence")).unionAll(last.select("name", F.col("version") - 1, F.lit(2)))
    return extraction.active_prompts(versions, log)


@BOOK.add("golden_verdicts", "SELECT source AS name, 1 AS version, count(*) FILTER (doc_id % 5 <> 0) AS n, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END) FILTER (doc_id % 5 <> 0), 8) AS share, CASE WHEN avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END) FILTER (doc_id % 5 <> 0) >= 0.33 THEN 'promote' WHEN count(*) FILTER (doc_id % 5 <> 0) = 0 THEN 'none' ELSE 'hold' END AS verdict FROM documents GROUP BY source")
def golden_verdicts(spark, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.lit(1).alias("version"), F.col("doc_id").alias("case"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 3 == 0).alias("passed"))
    return extraction.golden_verdicts(scores, 0.33).withColumn("share", r("share"))


@BOOK.add("unit_conversions", "SELECT event_id, value / 100 * 10000 AS bps, value / 10000 AS fraction, value * 100 AS bps_of_percent, value / 100 AS percent, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * 0 + value / 10000 * 500 AS usd, value / 500 * 10000 AS bps_of_usd FROM events")
def unit_conversions(spark, sf_dir: str) -> DataFrame:
    v, side = F.col("value"), F.when(F.col("event_id") % 2 == 0, 500.0).otherwise(-500.0)
    return table(spark, sf_dir, "events").select("event_id", canonical.bps(v / 100).alias("bps"), canonical.fraction_of_bps(v).alias("fraction"), canonical.bps_of_percent(v).alias("bps_of_percent"), canonical.percent_of_bps(v).alias("percent"), canonical.usd_of_bps(v, side).alias("usd"), canonical.bps_of_usd(v, side).alias("bps_of_usd"))


@BOOK.add("filing_urls", "SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/daily-index/' || year(o_orderdate) || '/QTR' || quarter(o_orderdate) || '/index.json' AS listing, 'https://www.sec.gov/Archives/edgar/daily-index/' || year(o_orderdate) || '/QTR' || quarter(o_orderdate) || '/master.idx' AS daily, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '24000001/' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-24-000001-index-headers.html' AS header FROM orders")
def filing_urls(spark, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    accession = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("-24-000001"))
    return table(spark, sf_dir, "orders").select("o_orderkey", filings.listing_url(F.year(day), F.quarter(day)).alias("listing"), filings.index_url(day, F.lit("master.idx")).alias("daily"), filings.header_url(F.col("o_custkey"), accession).alias("header"))


@BOOK.add("trial_ledger", "SELECT 'run' || o_orderkey AS run_id, 'strategy' || o_custkey % 5 AS strategy, o_orderkey % 100 / 50.0 AS sharpe FROM orders")
def trial_ledger(spark, sf_dir: str) -> DataFrame:
    line = F.format_string("| run%d | strategy%d | 2024-01-01 | %s |  |", "o_orderkey", F.col("o_custkey") % 5, (F.col("o_orderkey") % 100 / 50.0).cast("string"))
    heading = spark.createDataFrame([("# Trials",), ("| run_id | strategy | started | sharpe | note |",), ("|---|---|---|---|---|",), ("",)], "line string")
    return trials.parse(heading.unionAll(table(spark, sf_dir, "orders").select(line.alias("line")))).select("run_id", "strategy", "sharpe")
