"""Event-sourced state and monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ledger, monitoring
from tidemark.plans.book import Book
from tidemark.plans.tables import EVENT_FACTS, event_facts, table

BOOK = Book()


@BOOK.add("audit_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def audit_latest(spark, sf_dir: str) -> DataFrame:
    return ledger.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id"), ("user_id",)).select("user_id", "event_type", "value", "event_id")


LOG = """lg AS (SELECT l_orderkey AS order_id, k AS sequence, CASE WHEN k = 1 THEN 'acknowledged' WHEN l_orderkey % 97 = 0 AND k = 3 THEN 'acknowledged' ELSE 'partially_filled' END AS from_state, CASE WHEN k = n THEN 'filled' ELSE 'partially_filled' END AS to_state, CAST(round(l_quantity) AS BIGINT) AS fill, total - CASE WHEN l_orderkey % 89 = 0 THEN 1 ELSE 0 END AS quantity
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, CAST(sum(CAST(round(l_quantity) AS BIGINT)) OVER (PARTITION BY l_orderkey) AS BIGINT) AS total FROM lineitem))"""


def order_log(spark, sf_dir: str) -> DataFrame:
    """Each order's lines as its fills; every 97th breaks its chain and every 89th fills too much."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    fill = F.round("l_quantity").cast("long")
    told = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.row_number().over(w.orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("sequence"), F.count("*").over(w).alias("n"), fill.alias("fill"), F.sum(fill).over(w).alias("total"))
    start = F.when(F.col("sequence") == 1, "acknowledged").when((F.col("order_id") % 97 == 0) & (F.col("sequence") == 3), "acknowledged").otherwise("partially_filled")
    return told.select("order_id", "sequence", start.alias("from_state"), F.when(F.col("sequence") == F.col("n"), "filled").otherwise("partially_filled").alias("to_state"), "fill", (F.col("total") - F.when(F.col("order_id") % 89 == 0, 1).otherwise(0)).alias("quantity"))


@BOOK.add(
    "order_replay",
    f"""WITH {LOG}, x AS (SELECT *, lag(to_state) OVER w AS was, CAST(sum(fill) OVER w AS BIGINT) AS filled FROM lg WINDOW w AS (PARTITION BY order_id ORDER BY sequence)),
 y AS (SELECT *, CASE WHEN was IS NOT NULL AND was <> from_state THEN 'broken chain' WHEN filled > quantity THEN 'overfill' END AS wrong FROM x)
 SELECT order_id, arg_max(to_state, sequence) AS state, arg_max(filled, sequence) AS filled, count(*) AS n, coalesce(arg_min(wrong, sequence) FILTER (wrong IS NOT NULL), 'ok') AS status FROM y GROUP BY order_id""",
)
def order_replay(spark, sf_dir: str) -> DataFrame:
    return ledger.replay(order_log(spark, sf_dir))


PAIRS = "pr AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'filled' WHEN 3 THEN 'pending_cancel' ELSE 'partially_filled' END AS state, CASE event_id % 7 WHEN 0 THEN 'release' WHEN 1 THEN 'fill_complete' WHEN 2 THEN 'request_cancel' WHEN 3 THEN 'expire' WHEN 4 THEN 'poke' ELSE 'partial_fill' END AS event FROM events)"
TABLE = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in ledger.TRANSITIONS)


@BOOK.add("order_transitions", f"WITH {PAIRS}, tt(state, event, to_state) AS (VALUES {TABLE}) SELECT pr.state, pr.event, to_state, CASE WHEN to_state IS NOT NULL THEN 'ok' WHEN pr.state IN ('filled', 'cancelled', 'rejected', 'expired') THEN 'final' WHEN pr.event = 'poke' THEN 'unknown' ELSE 'illegal' END AS verdict, count(*) AS n FROM pr LEFT JOIN tt ON pr.state = tt.state AND pr.event = tt.event GROUP BY 1, 2, 3, 4")
def order_transitions(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    state = F.expr("CASE event_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'filled' WHEN 3 THEN 'pending_cancel' ELSE 'partially_filled' END")
    event = F.expr("CASE event_id % 7 WHEN 0 THEN 'release' WHEN 1 THEN 'fill_complete' WHEN 2 THEN 'request_cancel' WHEN 3 THEN 'expire' WHEN 4 THEN 'poke' ELSE 'partial_fill' END")
    return ledger.with_next_state(e.select(state.alias("state"), event.alias("event"))).groupBy("state", "event", "to_state", "verdict").agg(F.count("*").alias("n"))


BOOKS = """a AS (SELECT l_suppkey AS account, l_partkey AS security, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS shares FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2),
 b AS (SELECT l_suppkey AS account, l_partkey AS security, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) * CASE WHEN l_partkey % 50 = 0 THEN -1 ELSE 1 END AS shares FROM lineitem WHERE l_returnflag <> 'N' OR l_partkey % 2 = 0 GROUP BY 1, 2)"""


@BOOK.add(
    "reconcile",
    f"WITH {BOOKS}, j AS (SELECT account, security, coalesce(a.shares, 0) AS ours, coalesce(b.shares, 0) AS theirs FROM a FULL JOIN b USING (account, security)) SELECT *, CASE WHEN ours = theirs THEN 'match' WHEN theirs = 0 THEN 'only ours' WHEN ours = 0 THEN 'only theirs' WHEN sign(ours) <> sign(theirs) THEN 'opposite side' ELSE 'quantity' END AS kind FROM j",
)
def reconcile(spark, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("account"), F.col("l_partkey").alias("security"), "l_returnflag", F.round("l_quantity").cast("long").alias("q"))
    ours = line.where("l_returnflag <> 'A'").groupBy("account", "security").agg(F.sum("q").alias("shares"))
    theirs = line.where("l_returnflag <> 'N' OR security % 2 = 0").groupBy("account", "security").agg(F.sum("q").alias("shares")).withColumn("shares", F.col("shares") * F.when(F.col("security") % 50 == 0, -1).otherwise(1))
    return ledger.reconcile(ours, theirs)


@BOOK.add("spend_committed", "SELECT event_type AS provider, CAST(date_trunc('day', ts) AS DATE) AS \"window\", CAST(sum(CAST(value AS DECIMAL(20,4))) AS DOUBLE) AS committed FROM events GROUP BY 1, 2")
def spend_committed(spark, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.to_date("ts").alias("window"), F.col("value").cast("decimal(20,4)").alias("delta"))
    return ledger.committed(log).withColumn("committed", F.col("committed").cast("double"))


@BOOK.add(
    "spend_admission",
    """WITH RECURSIVE q AS (SELECT event_type AS provider, CAST(date_trunc('day', ts) AS DATE) AS w, event_id AS seq, CAST(value AS DECIMAL(20,4)) AS amount, row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY event_id) AS k FROM events),
 f AS (SELECT provider, w, seq, amount, k, amount <= 300 AS admitted, CASE WHEN amount <= 300 THEN amount ELSE 0 END::DECIMAL(38,4) AS s FROM q WHERE k = 1
 UNION ALL SELECT q.provider, q.w, q.seq, q.amount, q.k, f.s + q.amount <= 300, (CASE WHEN f.s + q.amount <= 300 THEN f.s + q.amount ELSE f.s END)::DECIMAL(38,4) FROM f JOIN q ON q.provider = f.provider AND q.w = f.w AND q.k = f.k + 1)
 SELECT provider, w AS "window", seq, CAST(amount AS DOUBLE) AS amount, admitted FROM f""",
)
def spend_admission(spark, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.to_date("ts").alias("window"), F.col("event_id").alias("seq"), F.col("value").cast("decimal(20,4)").alias("amount"))
    return ledger.admitted(calls, F.lit(300).cast("decimal(20,4)")).withColumn("amount", F.col("amount").cast("double"))


@BOOK.add("call_cost", "SELECT doc_id, CAST(ceil((strlen(text) + 1024) * 2.5 * 10000) AS DOUBLE) / 10000 / 1000000 AS usd FROM documents")
def call_cost(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ledger.call_cost(F.col("text"), F.lit("2.5").cast("decimal(12,4)")).cast("double").alias("usd"))


SESSIONS = "ss AS (SELECT l_suppkey AS security, CAST(date_trunc('month', l_shipdate) AS DATE) AS session_date, CAST(l_linenumber % 4 AS INTEGER) AS bucket, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3)"


@BOOK.add("volume_profile", f"WITH {SESSIONS}, d AS (SELECT DISTINCT security, session_date FROM ss), g AS (SELECT d.*, b.bucket, coalesce(ss.v, 0) AS v FROM d CROSS JOIN (SELECT unnest(range(4)) AS bucket) b LEFT JOIN ss ON ss.security = d.security AND ss.session_date = d.session_date AND ss.bucket = b.bucket) SELECT security, session_date, bucket, CAST(sum(v) OVER (PARTITION BY security, bucket ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before FROM g")
def volume_profile(spark, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    q = F.round("l_quantity").cast("long")
    sums = [F.sum(F.when(F.col("l_linenumber") % 4 == b, q).otherwise(0)) for b in range(4)]
    sessions = line.groupBy(F.col("l_suppkey").alias("security"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("session_date")).agg(F.array(*sums).alias("volumes"))
    return ledger.volume_profile(sessions)


CURVE = ledger.u_curve(13)
WEIGHTS = ", ".join(f"({i}, {w})" for i, w in enumerate(CURVE))


@BOOK.add(
    "apportion",
    f"""WITH w(idx, weight) AS (VALUES {WEIGHTS}), p AS (SELECT o_orderkey AS parent, 100 + o_orderkey % 5000 AS quantity FROM orders), x AS (SELECT parent, idx, (quantity - 26) AS rest, weight, sum(weight) OVER (PARTITION BY parent) AS s FROM p, w),
 y AS (SELECT parent, idx, rest, rest * weight // s AS part, rest * weight % s AS rem FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY rem DESC, idx) AS rk, rest - sum(part) OVER (PARTITION BY parent) AS miss FROM y) SELECT parent, idx, CAST(2 + part + CASE WHEN rk <= miss THEN 1 ELSE 0 END AS BIGINT) AS shares FROM z""",
)
def apportion(spark, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent"), (100 + F.col("o_orderkey") % 5000).alias("quantity"))
    return ledger.apportion(parents, spark.createDataFrame(list(enumerate(CURVE)), "idx int, weight long"), 2)


@BOOK.add("kill_switch", "SELECT c_custkey AS account, CASE WHEN c_custkey % 41 = 0 THEN 'manual' WHEN coalesce(NOT d < 0.2, true) THEN 'drawdown' WHEN c_custkey % 30 > 24 THEN 'freshness' WHEN c_custkey % 17 = 0 THEN 'reconciliation' END AS reason FROM (SELECT *, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 10 / 40.0 END AS d FROM customer)")
def kill_switch(spark, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    state = table(spark, sf_dir, "customer").select(c.alias("account"), F.when(c % 13 != 0, c % 10 / 40.0).alias("drawdown"), (c % 30).cast("double").alias("age_hours"), (c % 17 != 0).alias("matched"), (c % 41 == 0).alias("manual"))
    return ledger.kill_switch(state, 0.2, 24.0).select("account", "reason")


def samples(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("feature"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("x"), (F.dayofmonth("ts") <= 15).alias("old"))
    return e.where("old").drop("old"), e.where("NOT old").drop("old").withColumn("x", F.when(F.col("feature") == "click", F.col("x") * 1.5).otherwise(F.col("x")))


SAMPLES = "sm AS (SELECT event_type AS feature, CASE WHEN event_id % 11 <> 0 THEN value END AS x, day(ts) <= 15 AS old FROM events), rf AS (SELECT feature, x FROM sm WHERE old), ob AS (SELECT feature, CASE WHEN feature = 'click' THEN x * 1.5 ELSE x END AS x FROM sm WHERE NOT old)"
EDGES = "[" + ", ".join(str(k / 10) for k in range(1, 10)) + "]"
PSI = f"""{SAMPLES}, ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, {EDGES}))) AS edges FROM rf WHERE x IS NOT NULL GROUP BY feature),
 bp AS (SELECT rf.feature, len(list_filter(edges, lambda e: e <= x)) AS bin, count(*) / sum(count(*)) OVER (PARTITION BY rf.feature) AS p FROM rf JOIN ed ON rf.feature = ed.feature WHERE x IS NOT NULL GROUP BY 1, 2), bq AS (SELECT ob.feature, len(list_filter(edges, lambda e: e <= x)) AS bin, count(*) / sum(count(*)) OVER (PARTITION BY ob.feature) AS q FROM ob JOIN ed ON ob.feature = ed.feature WHERE x IS NOT NULL GROUP BY 1, 2),
 al AS (SELECT feature, unnest(range(len(edges) + 1)) AS bin FROM ed), pq AS (SELECT al.feature, greatest(1e-6, coalesce(p, 0)) AS p, greatest(1e-6, coalesce(q, 0)) AS q FROM al LEFT JOIN bp ON bp.feature = al.feature AND bp.bin = al.bin LEFT JOIN bq ON bq.feature = al.feature AND bq.bin = al.bin),
 ps AS (SELECT feature, count(*) AS bins, sum((q - p) * ln(q / p)) AS psi FROM pq GROUP BY feature), dr AS (SELECT *, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'major' END AS band FROM ps)"""


@BOOK.add("psi", f"WITH {PSI} SELECT feature, bins, round(psi, 8) AS psi, band FROM dr")
def psi(spark, sf_dir: str) -> DataFrame:
    return monitoring.psi(*samples(spark, sf_dir), 10).withColumn("psi", F.round("psi", 8))


@BOOK.add("nan_rate_psi", f"WITH {SAMPLES}, a AS (SELECT feature, avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) AS p FROM rf GROUP BY 1), b AS (SELECT feature, avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) AS q FROM ob GROUP BY 1) SELECT feature, round(p, 8) AS p, round(q, 8) AS q, round((q - p) * ln(q / p) + (p - q) * ln((1 - q) / (1 - p)), 9) AS psi FROM a JOIN b USING (feature)")
def nan_rate_psi(spark, sf_dir: str) -> DataFrame:
    told = monitoring.missing_rate_psi(*samples(spark, sf_dir))
    return told.select("feature", F.round("p", 8).alias("p"), F.round("q", 8).alias("q"), F.round("psi", 9).alias("psi"))


@BOOK.add("alerts", f"WITH {PSI} SELECT 'drift:' || feature AS dedup, CASE band WHEN 'major' THEN 'CRITICAL' ELSE 'WARNING' END AS severity, band AS detail FROM dr WHERE band <> 'stable' UNION ALL SELECT DISTINCT 'halt:' || user_id, CASE WHEN user_id % 2 = 0 THEN 'WARNING' ELSE 'CRITICAL' END, CASE WHEN user_id % 2 = 0 THEN 'above' ELSE 'below' END FROM events WHERE event_type = 'error' AND value > 60")
def alerts(spark, sf_dir: str) -> DataFrame:
    drift = monitoring.psi(*samples(spark, sf_dir), 10)
    halts = table(spark, sf_dir, "events").where("event_type = 'error' AND value > 60").select(F.col("user_id").alias("key"), F.when(F.col("user_id") % 2 == 0, "above").otherwise("below").alias("direction"))
    return monitoring.alerts(drift, halts)


@BOOK.add(
    "expectation_band",
    "WITH p AS (SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t, value AS r FROM events), v AS (SELECT CASE WHEN count(r) OVER w = 20 THEN avg(r) OVER w END AS v FROM p WINDOW w AS (PARTITION BY path ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT count(*) AS windows, round(quantile_cont(v, 0.05), 7) AS low, round(quantile_cont(v, 0.5), 7) AS mid, round(quantile_cont(v, 0.95), 7) AS high FROM v WHERE v IS NOT NULL",
)
def expectation_band(spark, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("t"), F.col("value").alias("r"))
    return monitoring.expectation_band(paths, 20, 0.05).select("windows", *[F.round(c, 7).alias(c) for c in ("low", "mid", "high")])


@BOOK.add("live_decision", "SELECT user_id, CASE WHEN max(value) FILTER (event_type = 'purchase') IS NULL THEN 'halt: missing' WHEN user_id % 30 > 24 THEN 'halt: stale' WHEN user_id % 19 = 0 THEN 'halt: gross of cost' WHEN max(value) FILTER (event_type = 'purchase') < 10 THEN 'halt: below' WHEN max(value) FILTER (event_type = 'purchase') > 60 THEN 'halt: above' ELSE 'continue' END AS decision FROM events GROUP BY user_id")
def live_decision(spark, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("v"))
    u = F.col("user_id")
    return told.select("user_id", monitoring.decide(F.col("v"), F.lit(10.0), F.lit(60.0), (u % 30).cast("double"), 24.0, u % 19 != 0).alias("decision"))


@BOOK.add("coverage", "SELECT count(DISTINCT CAST(l_shipdate AS DATE)) AS days, count(*) AS n, min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day FROM lineitem")
def coverage(spark, sf_dir: str) -> DataFrame:
    return monitoring.coverage(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")))


@BOOK.add(
    "gaps",
    """WITH r AS (SELECT DISTINCT l_suppkey AS source, CAST(l_shipdate AS DATE) AS d FROM lineitem), e AS (SELECT source, unnest(range(min(d), max(d) + 1, INTERVAL 1 DAY))::DATE AS d FROM r GROUP BY source), m AS (SELECT e.source, e.d FROM e ANTI JOIN r ON r.source = e.source AND r.d = e.d WHERE isodow(e.d) <= 5),
 g AS (SELECT source, d, d - CAST(row_number() OVER (PARTITION BY source ORDER BY d) AS INTEGER) AS g FROM m) SELECT source, min(d) AS first_day, max(d) AS last_day, count(*) AS n_days FROM g GROUP BY source, g""",
)
def gaps(spark, sf_dir: str) -> DataFrame:
    return monitoring.weekday_gaps(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.to_date("l_shipdate").alias("day")), by=("source",))


@BOOK.add("open_halts", "SELECT event_id AS halt_id, user_id FROM events WHERE event_type = 'error' AND event_id NOT IN (SELECT event_id - 1 FROM events WHERE event_type = 'click')")
def open_halts(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return monitoring.open_halts(e.where("event_type = 'error'").select(F.col("event_id").alias("halt_id"), "user_id"), e.where("event_type = 'click'").select((F.col("event_id") - 1).alias("halt_id")))


@BOOK.add("alerts_pending", "SELECT event_id AS alert_id, CASE WHEN event_id % 3 = 0 THEN 'deliver' ELSE 'escalate' END AS action FROM events WHERE event_type = 'error' AND event_id % 5 <> 0 AND (event_id % 3 = 0 OR ts <= TIMESTAMP '2024-01-20' - INTERVAL 4 HOUR)")
def alerts_pending(spark, sf_dir: str) -> DataFrame:
    raised = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("alert_id"), F.col("ts").cast("timestamp_ntz").alias("raised_at"))
    sent = raised.where("alert_id % 3 <> 0").select("alert_id", F.col("raised_at").alias("delivered_at"))
    return monitoring.pending(raised, sent, raised.where("alert_id % 5 = 0"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


RUNS = "rn AS (SELECT event_type AS source, ts AS started_at, event_id AS run_id, value > 5 AS ok FROM events)"


def run_log(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp_ntz").alias("started_at"), F.col("event_id").alias("run_id"), (F.col("value") > 5).alias("ok"))


@BOOK.add("run_staleness", f"WITH {RUNS}, l AS (SELECT source, max((started_at, run_id)) AS m FROM rn WHERE ok GROUP BY source) SELECT rn.source, max(l.m[1]) AS last_success, count(*) FILTER (NOT ok AND (l.m IS NULL OR (started_at, run_id) > l.m)) AS failures_since FROM rn LEFT JOIN l ON l.source = rn.source GROUP BY rn.source".replace("max((started_at, run_id))", "max({'a': started_at, 'b': run_id})").replace("max(l.m[1])", "max(l.m.a)").replace("(started_at, run_id) > l.m", "{'a': started_at, 'b': run_id} > l.m"))
def run_staleness(spark, sf_dir: str) -> DataFrame:
    return monitoring.staleness(run_log(spark, sf_dir))


@BOOK.add("run_latest_checkpoint", f"WITH {RUNS} SELECT source, arg_max(run_id, started_at) AS run_id FROM (SELECT * FROM rn WHERE ok) GROUP BY source")
def run_latest_checkpoint(spark, sf_dir: str) -> DataFrame:
    from tidemark.sources.runs import latest_checkpoint

    runs = run_log(spark, sf_dir).withColumn("checkpoint", F.when(F.col("ok"), F.col("run_id")))
    return latest_checkpoint(runs).select("source", F.col("checkpoint").alias("run_id"))


@BOOK.add("knowledge_lag", f"WITH {EVENT_FACTS} SELECT entity, CAST(floor(max(epoch_us(knowledge_time) - epoch_us(valid_from)) / 1000000) AS BIGINT) AS max_lag_seconds, count(*) AS n, floor(max(epoch_us(knowledge_time) - epoch_us(valid_from)) / 1000000) > 86000 AS breach FROM event_facts GROUP BY entity")
def knowledge_lag(spark, sf_dir: str) -> DataFrame:
    return monitoring.knowledge_lag(event_facts(spark, sf_dir), 86000, ("entity",))
