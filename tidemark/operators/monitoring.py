"""Drift, expectation bands, alerts and coverage."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.facts import Refused, refuse
from tidemark.operators.transforms import quantiles

#: The floor of a share, the bands of the index, hours until an alert escalates.
FLOOR, MODERATE, MAJOR, ESCALATE_HOURS = 1e-6, 0.10, 0.25, 4


def reference_edges(df: DataFrame, bins: int, by: tuple[str, ...] = (), col: str = "x") -> DataFrame:
    """Distinct interior quantile edges (linear); refused with fewer than four bins or too few rows for them."""
    if bins < 4:
        raise Refused("four bins or more")
    cuts = [k / bins for k in range(1, bins)]
    least = math.ceil((bins - 1) / 0.025)
    told = quantiles(df.where(~F.isnan(col)), by, cuts, col).select(*by, "n", F.array_distinct("q").alias("edges"))
    short = F.when(F.col("n") < least, F.raise_error(F.lit(f"fewer than {least} rows"))).otherwise(F.col("edges"))
    return told.select(*by, "n", short.alias("edges"))


def bin_of(x: Column, edges: Column) -> Column:
    """Bins are closed on the left: how many edges are at most x."""
    return F.size(F.filter(edges, lambda e: e <= x))


def psi(reference: DataFrame, observed: DataFrame, bins: int, by: tuple[str, ...] = ("feature",), col: str = "x") -> DataFrame:
    """Population stability index by feature, over bins of the reference; shares are floored. Bands: stable, moderate, major."""
    edges = reference_edges(reference, bins, by, col)
    keys = list(by)

    def shares(df: DataFrame, name: str) -> DataFrame:
        put = df.where(F.col(col).isNotNull() & ~F.isnan(col)).join(F.broadcast(edges.select(*keys, "edges")), keys).select(*keys, bin_of(F.col(col), F.col("edges")).alias("bin"))
        counted = put.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
        total = counted.groupBy(*keys).agg(F.sum("n").alias("m"))
        return counted.join(total, keys).select(*keys, "bin", (F.col("n") / F.col("m")).alias(name))

    every = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    both = every.join(shares(reference, "p"), [*keys, "bin"], "left").join(shares(observed, "q"), [*keys, "bin"], "left")
    p, q = (F.greatest(F.lit(FLOOR), F.coalesce(c, F.lit(0.0))) for c in ("p", "q"))
    told = both.groupBy(*keys).agg(F.count("*").alias("bins"), F.sum((q - p) * F.log(q / p)).alias("psi"))
    return told.withColumn("band", band(F.col("psi")))


def band(value: Column) -> Column:
    return F.when(value < MODERATE, "stable").when(value < MAJOR, "moderate").otherwise("major")


def missing_rate_psi(reference: DataFrame, observed: DataFrame, by: tuple[str, ...] = ("feature",), col: str = "x") -> DataFrame:
    """The index of the two classes missing and present."""
    rate = F.avg((F.col(col).isNull() | F.isnan(col)).cast("double"))
    both = reference.groupBy(*by).agg(rate.alias("p")).join(observed.groupBy(*by).agg(rate.alias("q")), list(by))
    term = lambda p, q: (F.greatest(F.lit(FLOOR), q) - F.greatest(F.lit(FLOOR), p)) * F.log(F.greatest(F.lit(FLOOR), q) / F.greatest(F.lit(FLOOR), p))
    p, q = F.col("p"), F.col("q")
    return both.select(*by, "p", "q", (term(p, q) + term(1 - p, 1 - q)).alias("psi"))


def null_moments(bins: int, n: int) -> tuple[float, float]:
    """Mean and deviation of the index when nothing has drifted."""
    return (bins - 1) / n, math.sqrt(2 * (bins - 1)) / n


def expectation_band(paths: DataFrame, window: int, tail: float, col: str = "r") -> DataFrame:
    """Quantiles of the rolling mean over full windows of all paths (path, t, r): low, mid and high. Paths too short for such a tail are refused, see `enough_windows`."""
    paths = enough_windows(paths, window, tail)
    rows = Window.partitionBy("path").orderBy("t").rowsBetween(1 - window, 0)
    rolled = paths.withColumn("_v", F.when(F.count(col).over(rows) == window, F.avg(col).over(rows))).where("_v IS NOT NULL")
    told = quantiles(rolled.select(F.lit(0).alias("_one"), "_v"), ("_one",), [tail, 0.5, 1 - tail], "_v")
    return told.select(F.col("n").alias("windows"), *[F.col("q")[k].alias(n) for k, n in enumerate(("low", "mid", "high"))])


def tail_for(budget: float, evaluations: int) -> float:
    """The tail of one evaluation such that so many stay within the budget of false halts."""
    return 1 - (1 - budget) ** (1 / evaluations)


def detection_power(tail: float, shift: float) -> float:
    z = NormalDist()
    return z.cdf(z.inv_cdf(tail) + shift)


def position(value: Column, low: Column, mid: Column, high: Column, tail: float) -> Column:
    """Percentile of a value, piecewise linear between the band's points."""
    below = F.lit(tail) + (value - low) / (mid - low) * (0.5 - tail)
    above = F.lit(0.5) + (value - mid) / (high - mid) * (0.5 - tail)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(value <= mid, below).otherwise(above)))


def decide(value: Column, low: Column, high: Column, age_hours: Column, most_hours: float, net_of_cost: Column) -> Column:
    """continue only if everything is known and inside; anything else halts, and says why."""
    return (
        F.when(value.isNull() | low.isNull() | high.isNull(), "halt: missing")
        .when(age_hours.isNull() | (age_hours > most_hours), "halt: stale")
        .when(~F.coalesce(net_of_cost, F.lit(False)), "halt: gross of cost")
        .when(value < low, "halt: below")
        .when(value > high, "halt: above")
        .when((value >= low) & (value <= high), "continue")
        .otherwise("halt: missing")
    )


def alerts(drift: DataFrame, halts: DataFrame, least: str = "moderate") -> DataFrame:
    """drift (feature, psi, band; a null psi is unmeasurable) and halts (key, direction) to alerts, the first of each dedup key. With neither, silence itself is one."""
    bands = ["moderate", "major"] if least == "moderate" else ["major"]
    drifted = drift.where(F.col("psi").isNotNull() & F.col("band").isin(*bands)).select(F.concat(F.lit("drift:"), "feature").alias("dedup"), F.when(F.col("band") == "major", "CRITICAL").otherwise("WARNING").alias("severity"), F.col("band").alias("detail"))
    dark = drift.where("psi IS NULL").agg(F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("detail")).where("detail != ''").select(F.lit("drift:unmeasurable").alias("dedup"), F.lit("WARNING").alias("severity"), "detail")
    halted = halts.select(F.concat(F.lit("halt:"), F.col("key").cast("string")).alias("dedup"), F.when(F.col("direction") == "above", "WARNING").otherwise("CRITICAL").alias("severity"), F.col("direction").alias("detail"))
    spoke = drift.select(F.lit(1)).limit(1).unionAll(halts.select(F.lit(1)).limit(1)).agg(F.count("*").alias("n"))
    silent = spoke.where("n = 0").select(F.lit("silence").alias("dedup"), F.lit("CRITICAL").alias("severity"), F.lit("no input").alias("detail"))
    every = drifted.unionAll(dark).unionAll(halted).unionAll(silent)
    return every.groupBy("dedup").agg(F.min(F.struct(F.when(F.col("severity") == "CRITICAL", 0).otherwise(1).alias("k"), "severity", "detail")).alias("a")).select("dedup", "a.severity", "a.detail")


def pending(alerts_log: DataFrame, deliveries: DataFrame, acknowledged: DataFrame, now: Column) -> DataFrame:
    """Alerts (alert_id, raised_at) that nobody acknowledged: to deliver, or delivered and older than the limit, to escalate."""
    open_ = alerts_log.join(acknowledged.select("alert_id").distinct(), "alert_id", "left_anti")
    sent = deliveries.groupBy("alert_id").agg(F.max("delivered_at").alias("delivered_at"))
    joined = open_.join(sent, "alert_id", "left")
    late = F.col("raised_at") <= now - F.expr(f"INTERVAL {ESCALATE_HOURS} HOURS")
    return joined.withColumn("action", F.when(F.col("delivered_at").isNull(), "deliver").when(late, "escalate")).where("action IS NOT NULL").select("alert_id", "action")


def open_halts(halts: DataFrame, clearings: DataFrame) -> DataFrame:
    """Engaged halts without a clearing row; clearings that name no halt clear none."""
    return halts.join(clearings.where("halt_id IS NOT NULL").select("halt_id").distinct(), "halt_id", "left_anti")


def coverage(rows: DataFrame, day: str = "day") -> DataFrame:
    return rows.agg(F.countDistinct(day).alias("days"), F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def weekday_gaps(rows: DataFrame, day: str = "day", by: tuple[str, ...] = ()) -> DataFrame:
    """By source, maximal runs of missing weekdays between its first and its last day; a weekend ends a run."""
    keys = list(by)
    ends = rows.groupBy(*keys).agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a IS NOT NULL")
    every = ends.select(*keys, F.explode(F.sequence("a", "b")).alias("d")).where("dayofweek(d) BETWEEN 2 AND 6")
    gone = every.join(rows.select(*keys, F.col(day).alias("d")).distinct(), [*keys, "d"], "left_anti")
    # Weekdays of one week are consecutive; a week of a source is a partition, so a run never leaves it.
    week = F.date_trunc("week", "d")
    island = gone.select(*keys, "d", week.alias("w"), (F.datediff("d", F.lit("1970-01-01").cast("date")) - F.row_number().over(Window.partitionBy(*keys, week).orderBy("d"))).alias("g"))
    return island.groupBy(*keys, "w", "g").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("n_days")).select(*keys, "first_day", "last_day", "n_days")


def weekdays(first: Column, last: Column) -> Column:
    """Weekdays from first to last, both included, in arithmetic; none if last lies before first."""
    # Days since a Monday: whole weeks have five, and of a part of a week at most five count.
    upto = lambda n: F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))
    monday = F.lit("1970-01-05").cast("date")
    return F.greatest(F.lit(0), upto(F.datediff(last, monday) + 1) - upto(F.datediff(first, monday))).cast("long")


def staleness(runs_log: DataFrame) -> DataFrame:
    """runs (source, started_at, run_id, ok): by source the last success and the failures since."""
    last = runs_log.groupBy("source").agg(F.max(F.when(F.col("ok"), F.struct("started_at", "run_id"))).alias("last"))
    since = F.count_if(~F.col("ok") & (F.col("last").isNull() | (F.struct("started_at", "run_id") > F.col("last"))))
    return runs_log.join(last, "source").groupBy("source").agg(F.max("last.started_at").alias("last_success"), since.alias("failures_since"))


def knowledge_lag(rows: DataFrame, limit_seconds: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Largest delay from valid_from to knowledge_time, and whether it breaks the limit."""
    lag = F.unix_micros(F.col("knowledge_time").cast("timestamp")) - F.unix_micros(F.col("valid_from").cast("timestamp"))
    told = rows.groupBy(*by).agg(F.floor(F.max(lag) / 1_000_000).alias("max_lag_seconds"), F.count("*").alias("n"))
    return told.withColumn("breach", F.col("max_lag_seconds") > limit_seconds)


def drift_report(reference: DataFrame, observed: DataFrame, bins: int, by: tuple[str, ...] = ("feature",), col: str = "x") -> DataFrame:
    """feature, n_reference, n_observed, bins, psi, band and status of every feature of either side. What cannot be measured is a row that says why: a feature that one side lacks, or too few reference rows for the bins."""
    keys, least = list(by), math.ceil((bins - 1) / 0.025)
    some = F.count_if(F.col(col).isNotNull() & ~F.isnan(col))
    sizes = reference.groupBy(*keys).agg(some.alias("n_reference")).join(observed.groupBy(*keys).agg(some.alias("n_observed")), keys, "full_outer")
    status = F.when(F.coalesce("n_reference", F.lit(0)) == 0, "no reference").when(F.coalesce("n_observed", F.lit(0)) == 0, "nothing observed").when(F.col("n_reference") < least, "too few reference rows").otherwise("measured")
    told = sizes.withColumn("status", status)
    # One row a feature.
    fit = F.broadcast(told.where("status = 'measured'").select(*keys))
    found = psi(reference.join(fit, keys, "left_semi"), observed.join(fit, keys, "left_semi"), bins, by, col)
    joined = told.join(found, keys, "left")
    return joined.select(*keys, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_reference", "n_observed")], "bins", "psi", "band", "status")


def enough_windows(paths: DataFrame, window: int, tail: float) -> DataFrame:
    """paths (path, t, r), refused as a whole unless they hold 1 / tail windows that do not overlap, without which the tail is guesswork."""
    n = paths.groupBy("path").agg(F.floor(F.count("r") / window).alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))  # one row
    return refuse(paths.crossJoin(F.broadcast(n)), F.col("_n") < math.ceil(1 / tail), "too few independent windows for the tail").select(*paths.columns)


def recorded_alerts(raised: DataFrame, store: DataFrame) -> DataFrame:
    """The alerts (dedup, severity, detail, raised_at) of a batch that a store lacks: the earliest of each dedup key, unless one with that key is open there."""
    first = raised.groupBy("dedup").agg(F.min_by(F.struct("severity", "detail", "raised_at"), F.struct("raised_at", "severity", "detail")).alias("_a"))
    there = store.where("acknowledged_at IS NULL").select("dedup").distinct()
    return first.join(there, "dedup", "left_anti").select("dedup", "_a.severity", "_a.detail", "_a.raised_at")


def alert_states(alerts_log: DataFrame, attempts: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """alert_id, raised_at, attempts, delivered_at (the first delivery), acknowledged_at (the first) and state: acknowledged, delivered, failing or new. An acknowledgement or an attempt of an unknown alert is refused."""
    tried = attempts.groupBy("alert_id").agg(F.count("*").alias("attempts"), F.min(F.when(F.col("ok"), F.col("at"))).alias("delivered_at"))
    done = acknowledgements.groupBy("alert_id").agg(F.min("at").alias("acknowledged_at"))
    every = alerts_log.join(tried, "alert_id", "full_outer").join(done, "alert_id", "full_outer")
    every = refuse(every, F.col("raised_at").isNull(), "an unknown alert")
    state = F.when(F.col("acknowledged_at").isNotNull(), "acknowledged").when(F.col("delivered_at").isNotNull(), "delivered").when(F.col("attempts") > 0, "failing").otherwise("new")
    return every.select("alert_id", "raised_at", F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), "delivered_at", "acknowledged_at", state.alias("state"))


def page_of_history(rows: DataFrame, limit: int, at: str = "at", id_col: str = "id", after: tuple | None = None) -> DataFrame:
    """The newest `limit` rows, ties by the larger id first; `after`, the (at, id) of the last row of the page before, goes on from there without counting rows."""
    if limit < 1:
        raise Refused("a page holds one row or more")
    if after is not None:
        a, i = (F.lit(x) for x in after)
        rows = rows.where((F.col(at) < a) | ((F.col(at) == a) & (F.col(id_col) < i)))
    return rows.orderBy(F.desc(at), F.desc(id_col)).limit(limit)
