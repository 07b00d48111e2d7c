"""Universe, factors, transforms, labels, splits, statistics, backtests and portfolios."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import factors, transforms, universe
from tidemark.operators.facts import FactSpec
from tidemark.plans.book import Book
from tidemark.plans.tables import BARS, CROSS_SECTION, bars, cross_section, table

BOOK = Book()
DAY = dt.date(1998, 6, 1)
EXCHANGE = "CASE WHEN id % 4 = 0 THEN 'XNYS' WHEN id % 4 = 1 THEN 'XNAS' WHEN id % 4 = 2 THEN 'ARCX' ELSE 'OTC' END"
EXCHANGES = ("XNYS", "XNAS", "ARCX")


def r(col, digits: int = 8):
    return F.round(col, digits)


def adv_sql(day: str = "1998-06-01", n: int = 5, name: str = "adv") -> str:
    days = universe.lookback_days(n) - 1
    return f"""{name} AS (SELECT id, max(CASE WHEN rn = 1 THEN close END) AS price, CASE WHEN count(*) = {n} THEN median(close * volume) END AS adv FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS rn FROM bars WHERE date BETWEEN DATE '{day}' - {days} AND DATE '{day}') WHERE rn <= {n} GROUP BY id)"""


@BOOK.add("universe_adv_median", f"WITH {BARS}, {adv_sql()} SELECT id, price, round(adv, 4) AS adv FROM adv")
def universe_adv_median(spark, sf_dir: str) -> DataFrame:
    return universe.average_dollar_volume(bars(spark, sf_dir), DAY, 5).select("id", "price", r("adv", 4).alias("adv"))


def _screened(spark, sf_dir: str, day: dt.date = DAY) -> DataFrame:
    listed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    known = listed.join(universe.average_dollar_volume(bars(spark, sf_dir), day, 5), "id", "left").withColumn("exchange", F.expr(EXCHANGE))
    return universe.screen(known, EXCHANGES, 1400.0, 30000.0)


def screened_sql(day: str = "1998-06-01", name: str = "scr") -> str:
    return f"""{adv_sql(day, name=name + '_adv')}, {name} AS (SELECT id, price, adv, {EXCHANGE} AS exchange, coalesce({EXCHANGE} IN ('XNYS', 'XNAS', 'ARCX'), false) AS f1, coalesce(price >= 1400, false) AS f2, coalesce(adv >= 30000, false) AS f3 FROM (SELECT s_suppkey AS id FROM supplier) LEFT JOIN {name}_adv USING (id))"""


@BOOK.add("universe_screen", f"WITH {BARS}, {screened_sql()} SELECT id, exchange, concat_ws(',', CASE WHEN NOT f1 THEN 'exchange' END, CASE WHEN NOT f2 THEN 'price' END, CASE WHEN NOT f3 THEN 'adv' END) AS failed FROM scr")
def universe_screen(spark, sf_dir: str) -> DataFrame:
    return _screened(spark, sf_dir).select("id", "exchange", F.array_join("failed_filters", ",").alias("failed"))


@BOOK.add(
    "universe_waterfall",
    f"""WITH {BARS}, {screened_sql()} SELECT 'exchange' AS screen, count(*) AS considered, count(*) FILTER (NOT f1) AS removed, CAST(0 AS BIGINT) AS also_failed, count(*) FILTER (f1) AS remaining FROM scr
 UNION ALL SELECT 'price', count(*) FILTER (f1), count(*) FILTER (f1 AND NOT f2), count(*) FILTER (NOT f1 AND NOT f2), count(*) FILTER (f1 AND f2) FROM scr
 UNION ALL SELECT 'adv', count(*) FILTER (f1 AND f2), count(*) FILTER (f1 AND f2 AND NOT f3), count(*) FILTER (NOT f3 AND NOT (f1 AND f2)), count(*) FILTER (f1 AND f2 AND f3) FROM scr""",
)
def universe_waterfall(spark, sf_dir: str) -> DataFrame:
    return universe.waterfall(_screened(spark, sf_dir)).drop("step")


MEMBERS = "m AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS date, id FROM bars WHERE volume > 60)"


def members(spark, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).where("volume > 60").select(F.to_date(F.date_trunc("month", "date")).alias("date"), "id").distinct()


@BOOK.add(
    "universe_turnover",
    f"""WITH {BARS}, {MEMBERS}, d AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM m)), p AS (SELECT d.date, m.id FROM d JOIN m ON m.date = d.prev), c AS (SELECT d.date, m.id FROM d JOIN m ON m.date = d.date WHERE d.prev IS NOT NULL),
 j AS (SELECT coalesce(c.date, p.date) AS date, c.id AS ci, p.id AS pi FROM c FULL JOIN p ON c.date = p.date AND c.id = p.id)
 SELECT date, count(*) FILTER (pi IS NULL) AS entered, count(*) FILTER (ci IS NULL) AS "left", count(ci) AS n, count(pi) AS previous, round((count(*) FILTER (pi IS NULL) + count(*) FILTER (ci IS NULL)) / (count(ci) + count(pi)), 8) AS rate FROM j GROUP BY date""",
)
def universe_turnover(spark, sf_dir: str) -> DataFrame:
    return universe.turnover(members(spark, sf_dir)).withColumn("rate", r("rate"))


@BOOK.add(
    "universe_spans",
    f"""WITH {BARS}, {MEMBERS}, k AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM m)), i AS (SELECT id, m.date, k, k - row_number() OVER (PARTITION BY id ORDER BY k) AS g FROM m JOIN k ON m.date = k.date)
 SELECT id, min(date) AS first_date, max(date) AS last_date, count(*) AS n_dates, max(k) = (SELECT max(k) FROM k) AS is_open FROM i GROUP BY id, g""",
)
def universe_spans(spark, sf_dir: str) -> DataFrame:
    return universe.spans(members(spark, sf_dir))


@BOOK.add("universe_size_series", f"WITH {BARS}, {screened_sql('1998-06-01', 'a')}, {screened_sql('1998-07-01', 'b')}, u AS (SELECT DATE '1998-06-01' AS date, f1 AND f2 AND f3 AS ok FROM a UNION ALL SELECT DATE '1998-07-01', f1 AND f2 AND f3 FROM b) SELECT date, count(*) AS candidates, count(*) FILTER (ok) AS members, round(count(*) FILTER (ok) / count(*), 8) AS inclusion FROM u GROUP BY date")
def universe_size_series(spark, sf_dir: str) -> DataFrame:
    days = [dt.date(1998, 6, 1), dt.date(1998, 7, 1)]
    a, b = (_screened(spark, sf_dir, d).select(F.lit(d).alias("date"), "failed_filters") for d in days)
    return universe.size_series(a.unionByName(b)).withColumn("inclusion", r("inclusion"))


def factor_sql(value: str, days: int, n: int = 10_000) -> str:
    return f"""WITH {BARS}, w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS back, ln(close) - lead(ln(close)) OVER (PARTITION BY id ORDER BY date DESC) AS r FROM bars WHERE date >= DATE '1998-06-01' - {days} AND date < DATE '1998-06-01') SELECT id, round({value}, 8) AS value FROM w WHERE back <= {n} GROUP BY id"""


def _before(spark, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).where(F.col("date") < F.lit(DAY))


FRESH = "date_diff('day', max(date), DATE '1998-06-01') <= 10"
REGISTRY = factors.baseline()


@BOOK.add("momentum", factor_sql(f"CASE WHEN {FRESH} THEN ln(max(CASE WHEN back = 5 THEN close END) / max(CASE WHEN back = 40 THEN close END)) END", 400))
def momentum(spark, sf_dir: str) -> DataFrame:
    return REGISTRY.compute("momentum_12_1", _before(spark, sf_dir), DAY, near=5, far=40).withColumn("value", r("value"))


@BOOK.add("reversal", factor_sql(f"CASE WHEN {FRESH} THEN -ln(max(CASE WHEN back = 1 THEN close END) / max(CASE WHEN back = 8 THEN close END)) END", 60))
def reversal(spark, sf_dir: str) -> DataFrame:
    return REGISTRY.compute("short_term_reversal", _before(spark, sf_dir), DAY, far=8).withColumn("value", r("value"))


VERSIONED_BARS = "bv AS (SELECT l_suppkey AS id, CAST(l_shipdate AS DATE) AS date, CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER) AS k, (CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) * 10000 // CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT)) / 10000.0::DOUBLE AS close FROM lineitem GROUP BY 1, 2, 3)"


def versioned_bars(spark, sf_dir: str) -> DataFrame:
    """A bar a supplier and day of shipping, a version of it for each day on which its lines arrive, as many days later as their numbers."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    shipped = F.to_date("l_shipdate")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id"), shipped.cast("timestamp_ntz").alias("valid_from"), F.date_add(shipped, F.col("l_linenumber").cast("int")).cast("timestamp_ntz").alias("knowledge_time")).agg(cents("l_extendedprice").alias("paid"), cents("l_quantity").alias("pieces"))
    return sums.select("id", "valid_from", (F.col("valid_from") + F.expr("INTERVAL 1 DAY")).alias("valid_to"), "knowledge_time", (F.expr("paid * 10000 div pieces") / 10000.0).alias("close"), F.lit(False).alias("is_retraction"))


@BOOK.add(
    "feature_asof",
    f"""WITH {VERSIONED_BARS}, vi AS (SELECT id, date, max_by(close, k) AS close FROM bv WHERE k <= DATE '1998-06-01' GROUP BY 1, 2), ra AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS back FROM vi WHERE date >= DATE '1998-06-01' - 60),
 va AS (SELECT id, CASE WHEN date_diff('day', max(date), DATE '1998-06-01') <= 10 THEN -ln(max(close) FILTER (back = 1) / max(close) FILTER (back = 8)) END AS value FROM ra GROUP BY id) SELECT s_suppkey AS id, round(value, 8) AS value, 'log return' AS units, TIMESTAMP '1998-06-01' AS as_of FROM supplier LEFT JOIN va ON va.id = s_suppkey""",
)
def feature_asof(spark, sf_dir: str) -> DataFrame:
    """Reversals of all suppliers from the versions of their bars that had arrived by the day."""
    prices = versioned_bars(spark, sf_dir)
    securities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    told = REGISTRY.compute_asof("short_term_reversal", prices, FactSpec("price", ("id",), ("close",), ("close",)), securities, DAY, days=60, far=8)
    return told.withColumn("value", r("value"))


@BOOK.add("low_volatility", factor_sql(f"CASE WHEN count(r) = 30 AND {FRESH} THEN -stddev_samp(r) * sqrt(252) END", 400, 30))
def low_volatility(spark, sf_dir: str) -> DataFrame:
    return REGISTRY.compute("low_volatility", _before(spark, sf_dir), DAY, n=30).withColumn("value", r("value"))


@BOOK.add("amihud", factor_sql(f"CASE WHEN count(r) = 30 AND {FRESH} AND bool_and(close * volume > 0) THEN avg(abs(r) / (close * volume)) * 1e6 END", 400, 30))
def amihud(spark, sf_dir: str) -> DataFrame:
    return REGISTRY.compute("amihud_illiquidity", _before(spark, sf_dir), DAY, n=30).withColumn("value", r(F.col("value") * 1e6))


WINSOR = """b AS (SELECT date, max(CASE WHEN k = CAST(floor((n - 1) * 0.05::DOUBLE) AS BIGINT) + 1 THEN x END) AS lo, max(CASE WHEN k = CAST(ceil((n - 1) * 0.95::DOUBLE) AS BIGINT) + 1 THEN x END) AS hi FROM (SELECT date, x, row_number() OVER (PARTITION BY date ORDER BY x) AS k, count(*) OVER (PARTITION BY date) AS n FROM cs) GROUP BY date), wz AS (SELECT cs.date, grp, id, beta, greatest(lo, least(hi, x)) AS x FROM cs JOIN b ON cs.date = b.date)"""
ZED = "z AS (SELECT w.date, grp, id, beta, CASE WHEN n >= 2 AND s > 1e-12 * a THEN (x - m) / s END AS x FROM {src} w JOIN (SELECT date, avg(x) AS m, stddev_samp(x) AS s, max(abs(x)) AS a, count(x) AS n FROM {src} GROUP BY date) q ON w.date = q.date)"
NEUTRAL = "g AS (SELECT w.date, w.grp, id, beta, CASE WHEN n >= 2 THEN x - m END AS x FROM {src} w JOIN (SELECT date, grp, avg(x) AS m, count(x) AS n FROM {src} GROUP BY date, grp) q ON w.date = q.date AND w.grp = q.grp)"
BETA = "t AS (SELECT w.date, grp, id, beta, CASE WHEN n >= 3 AND sqrt(v) > 1e-12 * a THEN x - mx - c / v * (beta - mb) END AS x FROM {src} w JOIN (SELECT date, avg(x) AS mx, avg(beta) AS mb, covar_samp(x, beta) AS c, var_samp(beta) AS v, max(abs(beta)) AS a, count(*) AS n FROM {src} WHERE x IS NOT NULL AND beta IS NOT NULL GROUP BY date) q ON w.date = q.date)"


def _tidy(df: DataFrame) -> DataFrame:
    return df.select("date", "id", r("x", 7).alias("x"))


@BOOK.add("winsorize", f"WITH {CROSS_SECTION}, {WINSOR} SELECT date, id, round(x, 7) AS x FROM wz")
def winsorize(spark, sf_dir: str) -> DataFrame:
    return _tidy(transforms.winsorize(cross_section(spark, sf_dir), 0.05, 0.95))


@BOOK.add("zscore", f"WITH {CROSS_SECTION}, {ZED.format(src='cs')} SELECT date, id, round(x, 7) AS x FROM z")
def zscore(spark, sf_dir: str) -> DataFrame:
    return _tidy(transforms.zscore(cross_section(spark, sf_dir)))


@BOOK.add("neutralize", f"WITH {CROSS_SECTION}, {NEUTRAL.format(src='cs')} SELECT date, id, round(x, 7) AS x FROM g")
def neutralize(spark, sf_dir: str) -> DataFrame:
    return _tidy(transforms.neutralize(cross_section(spark, sf_dir)))


@BOOK.add("beta_neutralize", f"WITH {CROSS_SECTION}, {BETA.format(src='cs')} SELECT date, id, round(x, 7) AS x FROM t")
def beta_neutralize(spark, sf_dir: str) -> DataFrame:
    return _tidy(transforms.beta_neutralize(cross_section(spark, sf_dir)))


@BOOK.add("transform_pipeline", f"WITH {CROSS_SECTION}, {WINSOR.replace('0.05', '0.01').replace('0.95', '0.99')}, {ZED.format(src='wz')}, {NEUTRAL.format(src='z')}, {BETA.format(src='g')} SELECT date, id, round(x, 7) AS x FROM t")
def transform_pipeline(spark, sf_dir: str) -> DataFrame:
    return _tidy(transforms.transform(cross_section(spark, sf_dir), beta="beta"))


@BOOK.add(
    "premia",
    f"WITH {BARS}, p AS (SELECT id, ln(close) - lag(ln(close)) OVER (PARTITION BY id ORDER BY date) AS x FROM bars) SELECT id, round(avg(x) * 12, 8) AS premium, round(stddev_samp(x) / sqrt(count(x)) * 12, 8) AS standard_error, round(avg(x) / (stddev_samp(x) / sqrt(count(x))), 6) AS t, count(x) AS n, CASE WHEN abs(avg(x) / (stddev_samp(x) / sqrt(count(x)))) < 0.02 THEN 'none' WHEN sign(avg(x)) <> 1 THEN 'opposite' WHEN NOT avg(x) * 12 BETWEEN 0.03 AND 0.3 THEN 'out of range' ELSE 'reproduces' END AS verdict FROM p GROUP BY id",
)
def premia(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    price = F.log("close")
    returns = bars(spark, sf_dir).select("id", (price - F.lag(price).over(Window.partitionBy("id").orderBy("date"))).alias("x"))
    told = transforms.realized_premium(returns, by=("id",))
    return told.select("id", r("premium").alias("premium"), r("standard_error").alias("standard_error"), r("t", 6).alias("t"), "n", transforms.verdict(F.col("t"), F.col("premium"), F.lit(0.03), F.lit(0.3), 0.02).alias("verdict"))


import math
from itertools import combinations  # noqa: E402

from pyspark.sql import Window  # noqa: E402

from tidemark.operators import backtests, costs, labels, splits  # noqa: E402

RETURNS = f"{BARS}, ret AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) - 1 AS i, ln(close) - lag(ln(close)) OVER (PARTITION BY id ORDER BY date) AS r FROM bars)"


def returns(spark, sf_dir: str) -> DataFrame:
    return labels.log_returns(bars(spark, sf_dir))


@BOOK.add("log_returns", f"WITH {RETURNS} SELECT id, date, i, round(r, 8) AS r FROM ret")
def log_returns(spark, sf_dir: str) -> DataFrame:
    return returns(spark, sf_dir).select("id", "date", "i", r("r").alias("r"))


VOL = f"{RETURNS}, vol AS (SELECT *, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS sigma FROM ret WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"


@BOOK.add("trailing_vol", f"WITH {VOL} SELECT id, date, round(sigma, 7) AS sigma FROM vol")
def trailing_vol(spark, sf_dir: str) -> DataFrame:
    return labels.trailing_volatility(returns(spark, sf_dir), 20).select("id", "date", r("sigma", 7).alias("sigma"))


BARRIERS = f"""{VOL}, c AS (SELECT *, coalesce(sum(r) OVER (PARTITION BY id ORDER BY i), 0) AS c, count(*) OVER (PARTITION BY id) AS n FROM vol),
 e AS (SELECT id, date, i, c, sigma * sqrt(10.0) * 0.5 AS width FROM c WHERE i >= 20 AND i < n - 10 AND sigma IS NOT NULL),
 h AS (SELECT e.id, e.date, e.i, min(CASE WHEN p.c - e.c >= e.width THEN p.i END) AS u, min(CASE WHEN p.c - e.c <= -e.width THEN p.i END) AS d FROM e JOIN c p ON p.id = e.id AND p.i > e.i AND p.i <= e.i + 10 GROUP BY 1, 2, 3),
 lab AS (SELECT id, date, i, CASE WHEN u IS NULL AND d IS NULL THEN 0 WHEN d IS NULL OR u < d THEN 1 ELSE -1 END AS outcome, coalesce(least(u, d), i + 10) AS i_end FROM h)"""


@BOOK.add("triple_barrier", f"WITH {BARRIERS} SELECT id, date, i, outcome, i_end FROM lab")
def triple_barrier(spark, sf_dir: str) -> DataFrame:
    return labels.triple_barrier(returns(spark, sf_dir), 20, 10, 0.5).drop("width")


@BOOK.add("label_counts", f"WITH {BARRIERS} SELECT outcome, count(*) AS n FROM lab GROUP BY outcome")
def label_counts(spark, sf_dir: str) -> DataFrame:
    return labels.class_labels(labels.triple_barrier(returns(spark, sf_dir), 20, 10, 0.5)).groupBy("outcome").agg(F.count("*").alias("n"))


@BOOK.add(
    "uniqueness",
    f"""WITH {BARRIERS}, s AS (SELECT id, i, i + 1 AS first, i_end AS last FROM lab), c AS (SELECT s.id, b, count(*) AS c FROM s, LATERAL (SELECT unnest(range(s.first, s.last + 1)) AS b) GROUP BY 1, 2)
 SELECT s.id, s.i, round(avg(1.0 / c.c), 8) AS weight FROM s JOIN c ON c.id = s.id AND c.b BETWEEN s.first AND s.last GROUP BY 1, 2""".replace("), c AS (SELECT s.id", "), cc AS (SELECT s.id").replace("avg(1.0 / c.c)", "avg(1.0 / cc.c)").replace("JOIN c ON c.id = s.id AND c.b", "JOIN cc ON cc.id = s.id AND cc.b"),
)
def uniqueness(spark, sf_dir: str) -> DataFrame:
    found = labels.triple_barrier(returns(spark, sf_dir), 20, 10, 0.5)
    spans = found.select("id", "i", (F.col("i") + 1).cast("long").alias("first"), F.col("i_end").alias("last"))
    return labels.uniqueness(spans).select("id", "i", r("weight").alias("weight"))


@BOOK.add(
    "uniqueness_normalized",
    f"""WITH {BARRIERS}, s AS (SELECT id, i, i + 1 AS first, i_end AS last FROM lab), cc AS (SELECT s.id, b, count(*) AS c FROM s, LATERAL (SELECT unnest(range(s.first, s.last + 1)) AS b) GROUP BY 1, 2), w AS (SELECT s.id, s.i, avg(1.0 / cc.c) AS weight FROM s JOIN cc ON cc.id = s.id AND cc.b BETWEEN s.first AND s.last GROUP BY 1, 2)
 SELECT id, i, round(weight / avg(weight) OVER (PARTITION BY id), 8) AS normalized FROM w""",
)
def uniqueness_normalized(spark, sf_dir: str) -> DataFrame:
    """The weights of each security's labels, scaled to sum to their number."""
    found = labels.triple_barrier(returns(spark, sf_dir), 20, 10, 0.5)
    spans = found.select("id", "i", (F.col("i") + 1).cast("long").alias("first"), F.col("i_end").alias("last"))
    return labels.normalized(labels.uniqueness(spans)).select("id", "i", r("normalized").alias("normalized"))


@BOOK.add(
    "uniqueness_report",
    f"""WITH {BARRIERS}, s AS (SELECT id, i, i + 1 AS first, i_end AS last FROM lab), cc AS (SELECT s.id, b, count(*) AS c FROM s, LATERAL (SELECT unnest(range(s.first, s.last + 1)) AS b) GROUP BY 1, 2), w AS (SELECT s.id, s.i, avg(1.0 / cc.c) AS weight FROM s JOIN cc ON cc.id = s.id AND cc.b BETWEEN s.first AND s.last GROUP BY 1, 2)
 SELECT w.id, count(*) AS n, round(sum(weight), 6) AS effective, round(min(weight), 8) AS least, round(max(weight), 8) AS most, any_value(k.c) AS concurrency FROM w JOIN (SELECT id, max(c) AS c FROM cc GROUP BY id) k ON k.id = w.id GROUP BY w.id""",
)
def uniqueness_report(spark, sf_dir: str) -> DataFrame:
    found = labels.triple_barrier(returns(spark, sf_dir), 20, 10, 0.5)
    spans = found.select("id", "i", (F.col("i") + 1).cast("long").alias("first"), F.col("i_end").alias("last"))
    told = labels.uniqueness_report(labels.uniqueness(spans))
    return told.select("id", "n", r("effective", 6).alias("effective"), r("least").alias("least"), r("most").alias("most"), "concurrency")


EVENT_TIMES = "ev AS (SELECT event_id AS id, date_diff('minute', TIMESTAMP '2024-01-01', ts) AS start, date_diff('minute', TIMESTAMP '2024-01-01', ts) + 60 + event_id % 600 AS \"end\" FROM events)"


def event_times(spark, sf_dir: str) -> DataFrame:
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) - F.floor(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) / 60_000_000)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), minute.alias("start"), (minute + 60 + F.col("event_id") % 600).alias("end"))


FOLDS = f"{EVENT_TIMES}, f AS (SELECT *, ntile(5) OVER (ORDER BY start, id) - 1 AS fold FROM ev), t AS (SELECT fold AS split, min(start) AS t0, max(\"end\") AS t1 FROM f GROUP BY fold)"
ROLE = "CASE WHEN f.fold = t.split THEN 'test' WHEN start <= t1 AND \"end\" >= t0 THEN 'purged' WHEN start > t1 AND start <= t1 + 100 THEN 'embargoed' ELSE 'train' END"


@BOOK.add("purged_kfold", f"WITH {FOLDS} SELECT id, split, {ROLE} AS role FROM f, t")
def purged_kfold(spark, sf_dir: str) -> DataFrame:
    return splits.purged_kfold(event_times(spark, sf_dir), 5, 100)


CHOICES = ", ".join(f"({s}, {a}, {b})" for s, c in enumerate(combinations(range(5), 2)) for a, b in splits.runs(c))
TESTED = ", ".join(f"({s}, {g})" for s, c in enumerate(combinations(range(5), 2)) for g in c)


@BOOK.add(
    "cpcv_splits",
    f"""WITH {FOLDS}, ch(split, a, b) AS (VALUES {CHOICES}), te(split, g) AS (VALUES {TESTED}), sp AS (SELECT ch.split, a, min(t0) AS t0, max(t1) AS t1 FROM ch JOIN t ON t.split BETWEEN a AND b GROUP BY 1, 2),
 x AS (SELECT f.id, sp.split, f.fold, bool_or(start <= t1 AND "end" >= t0) AS m, bool_or(start > t1 AND start <= t1 + 100) AS w FROM f, sp GROUP BY 1, 2, 3)
 SELECT x.split, x.fold, CASE WHEN te.g IS NOT NULL THEN 'test' WHEN m THEN 'purged' WHEN w THEN 'embargoed' ELSE 'train' END AS role, count(*) AS n, CAST(sum(x.id) AS BIGINT) AS ids FROM x LEFT JOIN te ON te.split = x.split AND te.g = x.fold GROUP BY 1, 2, 3""",
)
def cpcv_splits(spark, sf_dir: str) -> DataFrame:
    return splits.cpcv(event_times(spark, sf_dir), 5, 2, 100).groupBy("split", "fold", "role").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@BOOK.add(
    "cpcv_paths",
    f"WITH te(split, grp) AS (VALUES {TESTED}), pa AS (SELECT row_number() OVER (PARTITION BY grp ORDER BY split) - 1 AS path, grp, split FROM te), {EVENT_TIMES}, f AS (SELECT id, ntile(5) OVER (ORDER BY start, id) - 1 AS grp FROM ev) SELECT f.id, pa.path, pa.split FROM f JOIN pa ON pa.grp = f.grp",
)
def cpcv_paths(spark, sf_dir: str) -> DataFrame:
    """By event and path the split whose test tells it."""
    groups = splits.with_fold(event_times(spark, sf_dir), 5).select("id", F.col("fold").alias("grp"))
    return groups.join(F.broadcast(splits.cpcv_paths(spark, 5, 2)), "grp").select("id", "path", "split")  # a row a group and path


@BOOK.add(
    "sharpe_moments",
    f"WITH {RETURNS}, q AS (SELECT id, count(r) AS n, avg(r) AS m, stddev_samp(r) AS s, var_pop(r) AS v FROM ret GROUP BY id) SELECT q.id, any_value(q.n) AS n, round(any_value(m / s), 7) AS sharpe, round(avg(pow(r - m, 3)) / pow(any_value(v), 1.5), 6) AS skew, round(avg(pow(r - m, 4)) / pow(any_value(v), 2), 6) AS kurtosis FROM q JOIN ret ON ret.id = q.id WHERE r IS NOT NULL GROUP BY q.id",
)
def sharpe_moments(spark, sf_dir: str) -> DataFrame:
    told = splits.moments(returns(spark, sf_dir).where("r IS NOT NULL"), "r", ("id",))
    return told.select("id", "n", r("sharpe", 7).alias("sharpe"), r("skew", 6).alias("skew"), r("kurtosis", 6).alias("kurtosis"))


@BOOK.add("average_ranks", "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS rank FROM lineitem")
def average_ranks(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", splits.average_rank(["l_suppkey"], F.col("l_quantity")).alias("rank"))


PANEL = f"""{RETURNS}, pan AS (SELECT t, config, coalesce(r, 0.0) AS r FROM (SELECT DISTINCT i - 1 AS t FROM ret WHERE i >= 1) CROSS JOIN (SELECT DISTINCT id AS config FROM ret WHERE i >= 1) LEFT JOIN (SELECT i - 1 AS t, id AS config, r FROM ret) USING (t, config)), np AS (SELECT max(t) + 1 AS n FROM pan)"""


def panel(spark, sf_dir: str) -> DataFrame:
    """The returns of all securities over all periods; one that trades no more is flat."""
    told = returns(spark, sf_dir).where("i >= 1").select((F.col("i") - 1).alias("t"), F.col("id").alias("config"), "r")
    # A security's periods are numbered from 0 without holes, so its returns are an array by period, and none of them moves.
    paths = told.groupBy("config").agg(F.sort_array(F.collect_list(F.struct("t", "r"))).alias("v"))
    last = told.agg(F.max("t").alias("last")).where("last IS NOT NULL")
    flat = F.transform(F.sequence(F.lit(0), "last"), lambda t: F.coalesce(F.get("v.r", t), F.lit(0.0)))
    return paths.join(F.broadcast(last)).select("config", F.posexplode(flat).alias("t", "r")).select("t", "config", "r")


def periods_of(rows: DataFrame) -> int:
    return (rows.agg(F.max("t")).first()[0] or 0) + 1


SIDES = ", ".join(f"({i}, {b}, {str(b in c).lower()})" for i, c in enumerate(combinations(range(6), 3)) for b in range(6))
PBO = f"""{PANEL}, bs AS (SELECT CASE WHEN t < n % 6 * (n // 6 + 1) THEN t // (n // 6 + 1) ELSE n % 6 + (t - n % 6 * (n // 6 + 1)) // (n // 6) END AS block, config, count(r) AS n, sum(r) AS s, sum(r * r) AS q FROM pan, np GROUP BY 1, 2), sd(split, block, inside) AS (VALUES {SIDES}),
 a AS (SELECT split, config, inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM bs JOIN sd USING (block) GROUP BY 1, 2, 3), v AS (SELECT split, config, inside, s / n / sqrt((q - s * s / n) / (n - 1)) AS v FROM a),
 p AS (SELECT split, config, max(v) FILTER (inside) AS vi, max(v) FILTER (NOT inside) AS vo FROM v GROUP BY 1, 2), k AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY vo) AS rank, row_number() OVER (PARTITION BY split ORDER BY vi DESC, config) AS rn, count(*) OVER (PARTITION BY split) AS n FROM p),
 best AS (SELECT split, config AS best, CAST(rank AS DOUBLE) AS rank, ln((rank / (n + 1)) / (1 - rank / (n + 1))) AS logit FROM k WHERE rn = 1)"""


@BOOK.add("pbo_splits", f"WITH {PBO} SELECT split, best, rank, round(logit, 8) AS logit FROM best")
def pbo_splits(spark, sf_dir: str) -> DataFrame:
    told = panel(spark, sf_dir)
    return splits.pbo_splits(told, 6, periods_of(told)).withColumn("logit", r("logit"))


@BOOK.add("pbo", f"WITH {PBO} SELECT count(*) AS splits, round(avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0.0 END), 8) AS pbo FROM best")
def pbo(spark, sf_dir: str) -> DataFrame:
    told = panel(spark, sf_dir)
    return splits.pbo(splits.pbo_splits(told, 6, periods_of(told))).withColumn("pbo", r("pbo"))


PATHS = f"{RETURNS}, te(split, grp) AS (VALUES {TESTED}), pth AS (SELECT row_number() OVER (PARTITION BY grp ORDER BY split) - 1 AS path, grp, split FROM te), sr AS (SELECT te.split, te.grp, ret.id, ret.i, r * (1 + te.split % 3) + te.split * 0.0001 AS r FROM ret JOIN te ON te.grp = ret.i % 5 WHERE r IS NOT NULL), psh AS (SELECT path, count(r) AS n, avg(r) / stddev_samp(r) AS sharpe FROM sr JOIN pth USING (split, grp) GROUP BY path)"


def split_returns(spark, sf_dir: str) -> DataFrame:
    """What a strategy that was fitted on each split earns in the groups that the split tests: the returns, scaled by the split."""
    told = returns(spark, sf_dir).where("r IS NOT NULL").withColumn("grp", (F.col("i") % 5).cast("int"))
    tested = spark.createDataFrame([(s, g) for s, c in enumerate(combinations(range(5), 2)) for g in c], "split int, grp int")
    return told.join(F.broadcast(tested), "grp").select("split", "grp", F.col("i").alias("t"), (F.col("r") * (1 + F.col("split") % 3) + F.col("split") * 0.0001).alias("r"))


@BOOK.add("cpcv_path_sharpes", f"WITH {PATHS} SELECT path, n, round(sharpe, 8) AS sharpe FROM psh")
def cpcv_path_sharpes(spark, sf_dir: str) -> DataFrame:
    return splits.path_sharpes(split_returns(spark, sf_dir), splits.cpcv_paths(spark, 5, 2)).withColumn("sharpe", r("sharpe"))


@BOOK.add("cpcv_distribution", f"WITH {PATHS} SELECT count(*) AS n, round(avg(sharpe), 8) AS mean, round(quantile_cont(sharpe, 0.5), 8) AS median, round(stddev_samp(sharpe), 8) AS std, round(quantile_cont(sharpe, 0.025), 8) AS low, round(quantile_cont(sharpe, 0.975), 8) AS high, avg(CASE WHEN sharpe > 0 THEN 1.0 ELSE 0.0 END) AS positive FROM psh")
def cpcv_distribution(spark, sf_dir: str) -> DataFrame:
    told = splits.distribution(splits.path_sharpes(split_returns(spark, sf_dir), splits.cpcv_paths(spark, 5, 2)))
    return told.select("n", *[r(c).alias(c) for c in ("mean", "median", "std", "low", "high")], "positive")


@BOOK.add("deflated_sharpe")
def deflated_sharpe(spark, sf_dir: str) -> DataFrame:
    return splits.deflated_sharpe_of_trials(returns(spark, sf_dir).where("r IS NOT NULL").withColumnRenamed("id", "trial"))


@BOOK.add("pbo_total_return", f"WITH {PBO.split('v AS (SELECT')[0]}v AS (SELECT split, config, inside, s AS v FROM a), {PBO[PBO.index('p AS (SELECT split, config, max(v)'):]} SELECT split, best, rank, round(logit, 8) AS logit FROM best")
def pbo_total_return(spark, sf_dir: str) -> DataFrame:
    """With a performance of the caller's own, here the total return."""
    told = panel(spark, sf_dir)
    return splits.pbo_splits_by(told, 6, periods_of(told), lambda x: float(x.sum())).withColumn("logit", r("logit"))


TRADES = "tr AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_extendedprice AS notional, 1000000.0 + l_suppkey * 1000 AS adv, CASE WHEN l_linenumber % 2 = 0 THEN 150.0 + l_linenumber END AS volatility_bps, l_returnflag = 'R' AS is_short, l_quantity AS days FROM lineitem)"


@BOOK.add(
    "trade_cost",
    f"""WITH {TRADES} SELECT is_short, count(*) AS n, round(sum(notional * 5 / 10000), 2) AS spread, round(sum(notional / 10000), 2) AS commission, round(sum(coalesce(volatility_bps, 200) * sqrt(notional / adv) / 10000 * notional), 2) AS impact, round(sum(CASE WHEN is_short THEN 100 * days / 360 / 10000 * notional ELSE 0 END), 2) AS borrow FROM tr GROUP BY is_short""",
)
def trade_cost(spark, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    orders = line.select(F.col("l_extendedprice").alias("notional"), (1_000_000.0 + F.col("l_suppkey") * 1000).alias("adv"), F.when(F.col("l_linenumber") % 2 == 0, 150.0 + F.col("l_linenumber")).alias("volatility_bps"), (F.col("l_returnflag") == "R").alias("is_short"), F.col("l_quantity").alias("days"))
    told = costs.trade_costs(orders)
    return told.groupBy("is_short").agg(F.count("*").alias("n"), *[F.round(F.sum(f"{c}_usd"), 2).alias(c) for c in ("spread", "commission", "impact", "borrow")])


TARGETS = f"{RETURNS}, tg AS (SELECT id % 4 AS strategy, i AS t, id AS asset, CASE WHEN (id + i) % 7 < 5 THEN 0.04 ELSE -0.02 END AS w, least(0.2, greatest(-0.2, r)) AS r FROM ret WHERE i >= 1)"


def targets(spark, sf_dir: str) -> DataFrame:
    weight = F.when((F.col("id") + F.col("i")) % 7 < 5, 0.04).otherwise(-0.02)
    return returns(spark, sf_dir).where("i >= 1").select((F.col("id") % 4).alias("strategy"), F.col("i").alias("t"), F.col("id").alias("asset"), weight.alias("w"), F.least(F.lit(0.2), F.greatest(F.lit(-0.2), F.col("r"))).alias("r"))


NET = f"""{TARGETS}, pe AS (SELECT strategy, t, sum(w * r) AS gross, sum(CASE WHEN w < 0 THEN -w ELSE 0 END) AS short FROM tg GROUP BY 1, 2), dr AS (SELECT tg.strategy, asset, tg.t, w, lag(w * (1 + r) / (1 + gross)) OVER (PARTITION BY tg.strategy, asset ORDER BY tg.t) AS p FROM tg JOIN pe ON pe.strategy = tg.strategy AND pe.t = tg.t),
 tu AS (SELECT strategy, t, sum(abs(w - coalesce(p, 0))) AS turnover FROM dr GROUP BY 1, 2), net AS (SELECT pe.strategy, pe.t, turnover, turnover * 6 / 10000 AS cost, short * 100 / 10000 / 360 AS borrow, (1 - turnover * 6 / 10000) * (1 - short * 100 / 10000 / 360) * (1 + gross) - 1 AS net FROM pe JOIN tu ON pe.strategy = tu.strategy AND pe.t = tu.t),
 eq AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY strategy ORDER BY t)) AS equity FROM net)"""


@BOOK.add("backtest_equity", f"WITH {NET} SELECT strategy, t, round(turnover, 8) AS turnover, round(cost, 12) AS cost, round(borrow, 12) AS borrow, round(net, 8) AS net, round(equity, 7) AS equity FROM eq")
def backtest_equity(spark, sf_dir: str) -> DataFrame:
    told = costs.backtest(targets(spark, sf_dir), wiped="keep")
    return told.select("strategy", "t", r("turnover").alias("turnover"), r("cost", 12).alias("cost"), r("borrow", 12).alias("borrow"), r("net").alias("net"), r("equity", 7).alias("equity"))


@BOOK.add("max_drawdown", f"WITH {NET} SELECT strategy, round(max(1 - equity / greatest(1.0, peak)), 7) AS max_drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY t) AS peak FROM eq) GROUP BY strategy")
def max_drawdown(spark, sf_dir: str) -> DataFrame:
    return costs.drawdowns(costs.backtest(targets(spark, sf_dir), wiped="keep")).select("strategy", r("max_drawdown", 7).alias("max_drawdown"))


@BOOK.add("performance", f"WITH {NET} SELECT strategy, count(*) AS n, round(exp(sum(ln(1 + net))) - 1, 7) AS total, round(pow(exp(sum(ln(1 + net))), 252.0 / count(*)) - 1, 7) AS annual, round(stddev_samp(net) * sqrt(252), 7) AS volatility, round(avg(net) / stddev_samp(net) * sqrt(252), 6) AS sharpe FROM net GROUP BY strategy")
def performance(spark, sf_dir: str) -> DataFrame:
    told = costs.performance(costs.backtest(targets(spark, sf_dir), wiped="keep"))
    return told.select("strategy", "n", r("total", 7).alias("total"), r("annual", 7).alias("annual"), r("volatility", 7).alias("volatility"), r("sharpe", 6).alias("sharpe"))


@BOOK.add(
    "walk_forward",
    f"""WITH {NET}, k AS (SELECT unnest(range((SELECT max(t) - 105 FROM net) // 30)) AS k), w("window", role, a, b) AS (SELECT k, 'train', 30 * k, 30 * k + 100 FROM k UNION ALL SELECT k, 'test', 105 + 30 * k, 135 + 30 * k FROM k)
 SELECT strategy, CAST("window" AS INTEGER) AS "window", role, count(*) AS n, round(avg(net) / stddev_samp(net), 6) AS sharpe FROM net JOIN w ON t >= a AND t < b GROUP BY 1, 2, 3""",
)
def walk_forward(spark, sf_dir: str) -> DataFrame:
    rows = targets(spark, sf_dir)
    windows = costs.walk_forward(periods_of(rows) - 1, 100, 30, 5)
    told = costs.in_windows(costs.backtest(rows, wiped="keep"), windows)
    return told.groupBy("strategy", "window", "role").agg(F.count("*").alias("n"), r(splits.sharpe("net"), 6).alias("sharpe"))


@BOOK.add("bootstrap")
def bootstrap(spark, sf_dir: str) -> DataFrame:
    return costs.bootstrap(costs.backtest(targets(spark, sf_dir), wiped="keep"), 10, 500, 7)


@BOOK.add("drift_weights", f"WITH {TARGETS} SELECT strategy, t, asset, round(w * (1 + r) / (1 + sum(w * r) OVER (PARTITION BY strategy, t)), 9) AS drifted FROM tg")
def drift_weights(spark, sf_dir: str) -> DataFrame:
    return costs.drifted(targets(spark, sf_dir), ("strategy", "t"), wiped="keep").select("strategy", "t", "asset", r("drifted", 9).alias("drifted"))


@BOOK.add("sample_cov", f"WITH {PANEL} SELECT a.config AS a, b.config AS b, round(covar_pop(a.r, b.r), 8) AS cov FROM pan a JOIN pan b ON a.t = b.t AND a.config <= b.config GROUP BY 1, 2")
def sample_cov(spark, sf_dir: str) -> DataFrame:
    return costs.covariance(panel(spark, sf_dir).withColumnRenamed("config", "asset")).withColumn("cov", r("cov"))


@BOOK.add(
    "constraint_breaches",
    f"""WITH {TARGETS}, x AS (SELECT t, asset, strategy AS sector, w FROM tg) SELECT t, 'position' AS "limit", CAST(asset AS VARCHAR) AS what, round(abs(w), 8) AS value FROM x WHERE abs(w) > 0.03 + 1e-6 UNION ALL SELECT t, 'gross', '', round(sum(abs(w)), 8) FROM x GROUP BY t HAVING sum(abs(w)) > 3.3 + 1e-6 UNION ALL SELECT t, 'sector', CAST(sector AS VARCHAR), round(sum(abs(w)), 8) FROM x GROUP BY t, sector HAVING sum(abs(w)) > 0.85 + 1e-6""",
)
def constraint_breaches(spark, sf_dir: str) -> DataFrame:
    weights = targets(spark, sf_dir).withColumnRenamed("strategy", "sector")
    return costs.constraint_breaches(weights, 0.03, 3.3, 0.85).withColumn("value", r("value"))


FITTED = f"""{RETURNS}, rp AS (SELECT id, i, r, avg(r) OVER (PARTITION BY date) AS m, avg(r) OVER (PARTITION BY date, id % 5) AS s, row_number() OVER (PARTITION BY id ORDER BY i) AS rn FROM ret WHERE r IS NOT NULL), rw AS (SELECT id, i, rn, count(*) OVER w AS n, avg(r) OVER w AS ar, avg(m) OVER w AS am, avg(s) OVER w AS as_, var_pop(m) OVER w AS mm, var_pop(s) OVER w AS ss, var_pop(r) OVER w AS rr, covar_pop(m, s) OVER w AS ms, covar_pop(m, r) OVER w AS mr, covar_pop(s, r) OVER w AS sr FROM rp WINDOW w AS (PARTITION BY id ORDER BY i ROWS 59 PRECEDING)),
 rf AS (SELECT *, (mr * ss - sr * ms) / (mm * ss - ms * ms) AS market, (sr * mm - mr * ms) / (mm * ss - ms * ms) AS sector FROM rw WHERE n = 60)"""


def residual_paths(spark, sf_dir: str) -> DataFrame:
    """Returns beside the means of their day and of their sector on that day. A row a day and sector is what is broadcast, so bars stay where they are."""
    told = returns(spark, sf_dir).where("r IS NOT NULL").withColumn("sector", F.col("id") % 5)
    sums = told.groupBy("date", "sector").agg(F.sum("r").alias("total"), F.count("*").alias("n"))
    day = Window.partitionBy("date")
    means = sums.select(F.col("date").alias("_date"), F.col("sector").alias("_sector"), (F.sum("total").over(day) / F.sum("n").over(day)).alias("m"), (F.col("total") / F.col("n")).alias("s"))
    return told.join(F.broadcast(means), F.col("date").eqNullSafe(F.col("_date")) & F.col("sector").eqNullSafe(F.col("_sector"))).select("id", "i", "r", "m", "s")


@BOOK.add("residual_fit", f"WITH {FITTED} SELECT id, CAST(i AS INTEGER) AS i, round(ar - market * am - sector * as_, 6) AS alpha, round(market, 5) AS market, round(sector, 5) AS sector, round(sqrt(60 * (rr - market * mr - sector * sr) / 57), 6) AS sigma FROM rf")
def residual_fit(spark, sf_dir: str) -> DataFrame:
    """Each security's trailing regression on the means of its day and of its sector on that day."""
    fits = labels.residual_fit(residual_paths(spark, sf_dir), 60)
    return fits.select("id", "i", r("alpha", 6).alias("alpha"), r("market", 5).alias("market"), r("sector", 5).alias("sector"), r("sigma", 6).alias("sigma"))


@BOOK.add(
    "exposure_breaches",
    f"""WITH {TARGETS}, x AS (SELECT t, sum(w) AS net, sum(w * (asset % 17) / 10.0) AS beta FROM tg GROUP BY t) SELECT t, 'net' AS "limit", '' AS what, round(net, 8) AS value FROM x WHERE abs(net - 1) > 1e-6 UNION ALL SELECT t, 'beta', '', round(beta, 8) FROM x WHERE abs(beta - 1.2) > 0.1 + 1e-6""",
)
def exposure_breaches(spark, sf_dir: str) -> DataFrame:
    """Days on which all books together miss a net weight of 1 or a beta of 1.2."""
    weights = targets(spark, sf_dir).withColumnRenamed("strategy", "sector").withColumn("beta", F.col("asset") % 17 / 10.0)
    return costs.constraint_breaches(weights, math.inf, math.inf, math.inf, 1e-6, 1.0, 0.1, 1.2).withColumn("value", r("value"))


RESIDUAL = f"""{FITTED}, sg AS (SELECT *, sqrt(60 * (rr - market * mr - sector * sr) / 57) AS sigma FROM rf), rc AS (SELECT f.id, f.i, p.rn - f.rn AS k, sum(p.r - f.market * p.m - f.sector * p.s) OVER (PARTITION BY f.id, f.i ORDER BY p.rn) AS c, 0.5 * f.sigma * sqrt(10) AS width FROM sg f JOIN rp p ON p.id = f.id AND p.rn BETWEEN f.rn + 1 AND f.rn + 10),
 rh AS (SELECT id, i, count(*) AS n, min(k) FILTER (abs(c) >= width) AS bar, arg_min(sign(c), k) FILTER (abs(c) >= width) AS hit FROM rc GROUP BY 1, 2)"""


@BOOK.add("residual_labels", f"WITH {RESIDUAL} SELECT id, CAST(i AS INTEGER) AS i, CAST(coalesce(hit, 0) AS INTEGER) AS outcome, CAST(i + coalesce(bar, 10) AS BIGINT) AS i_end FROM rh WHERE n = 10")
def residual_labels(spark, sf_dir: str) -> DataFrame:
    """Barriers of what day and sector leave of each security's return."""
    return labels.residual_labels(residual_paths(spark, sf_dir), 60, 10, 0.5)


@BOOK.add(
    "buy_and_hold",
    f"WITH {TARGETS}, x AS (SELECT strategy, t, asset, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy, asset ORDER BY t)) AS g FROM tg), n AS (SELECT strategy, count(DISTINCT asset) * 0.04 AS gross FROM tg GROUP BY 1) SELECT x.strategy, t, round((1 - any_value(gross) * 6 / 10000) * (sum(0.04 * g) + 1 - any_value(gross)), 7) AS equity FROM x JOIN n ON n.strategy = x.strategy GROUP BY 1, 2",
)
def buy_and_hold(spark, sf_dir: str) -> DataFrame:
    rows = targets(spark, sf_dir)
    entry = rows.select("strategy", "asset").distinct().withColumn("w", F.lit(0.04))
    return costs.buy_and_hold(rows.drop("w"), entry).withColumn("equity", r("equity", 7))


@BOOK.add("seed_sweep")
def seed_sweep(spark, sf_dir: str) -> DataFrame:
    """By supplier the Sharpe ratio of noise over as many periods as it has bars: what a ratio of its own has to beat."""
    n = bars(spark, sf_dir).groupBy(F.col("id").alias("seed")).agg(F.count("*").alias("n"))
    noise = n.select("seed", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("t")).withColumn("net", 0.01 * backtests.normal(F.col("seed"), F.col("t")))
    s = F.stddev_samp("net")
    return noise.groupBy("seed").agg(F.count("*").alias("n"), F.when(s > 0, F.avg("net") / s).alias("sharpe"))
