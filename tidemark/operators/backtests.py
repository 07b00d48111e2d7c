"""Backtests whose targets depend on what happened, walk-forward chains, reports and synthetic markets."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.costs import YEAR_DAYS, _over, _wiped, grown_log, in_windows
from tidemark.operators.facts import Refused, refuse
from tidemark.operators.intervals import interval_join


def checked_weights(weights: DataFrame, gross_cap: float, assets: DataFrame | None = None, by: tuple[str, ...] = ("strategy", "t"), tolerance: float = 1e-9) -> DataFrame:
    """weights (…, asset, w), which fail as a whole if one is no number, is of an asset that is not listed in `assets`, stands twice, or if a gross exposure is above the cap."""
    weights = refuse(weights, F.col("w").isNull() | F.isnan("w") | (F.abs("w") == math.inf), "a weight that is no number")
    if assets is not None:
        known = weights.join(assets.select("asset").distinct().withColumn("_known", F.lit(True)), "asset", "left")
        weights = refuse(known, F.col("_known").isNull(), "a weight of an unknown asset").select(*weights.columns)
    told = weights.groupBy(*by).agg(F.sum(F.abs("w")).alias("_g"), F.count("*").alias("_n"), F.countDistinct("asset").alias("_m"))
    told = refuse(told, F.col("_g") > gross_cap + tolerance, "gross exposure above the cap")
    told = refuse(told, F.col("_n") > F.col("_m"), "an asset with two weights")
    return weights.join(told.select(*by), list(by)).select(*weights.columns)


def visible_at(rows: DataFrame, decisions: DataFrame, at: str = "at", known: str = "knowledge_time") -> DataFrame:
    """rows with the decision each is first visible at: the earliest decision time that is no earlier than its knowledge time; null if it is never seen.

    decisions has one row a decision, whose times are in microseconds at the finest: what was learned after the decision before it and until its own time is first seen at it, which is a join by interval.
    """
    told = decisions.where(F.col(at).isNotNull()).groupBy(at).agg(F.count("*").alias("_n"))
    told = refuse(told, F.col("_n") > 1, "two decisions at one time")
    kind, step = rows.schema[known].dataType, F.expr("INTERVAL 1 MICROSECOND")
    before = F.lag(at).over(Window.orderBy(at))
    spans = told.select(F.col(at).cast(kind).alias("visible_at"), F.coalesce(before + step, F.lit("0001-01-01 00:00:00")).cast(kind).alias("_from"), (F.col(at) + step).cast(kind).alias("_to"))
    return interval_join(rows, spans, (), known, "_from", "_to", "left").drop("_from", "_to")


#: A strategy: from its name, the period, what was seen so far (t, asset, r) and its drifted weights, to its new weights.
Decide = Callable[[object, object, pd.DataFrame, dict], dict]


def run(returns: DataFrame, decide: Decide, fee_bps: float = 6.0, borrow_rate_bps: float = 100.0, days: int = 1, gross_cap: float = 10.0, wiped: str = "refuse") -> DataFrame:
    """strategy, t, turnover, cost, borrow, net and equity of strategies that decide period by period.

    returns (strategy, t, asset, r). Before each period `decide` sees the returns of earlier periods only. It pays for the change from
    the drifted weights, then borrow on what is short, then earns. A weight of an asset without a return in the period, gross exposure
    above the cap and a wiped out portfolio are refused; the latter is told to its last period, without an equity, if wiped is "keep". Decisions follow from each other, so a strategy is one group, all its
    assets and periods in one task; strategies run side by side. Where an asset's weight follows from its own past, `ruled` needs no group.
    """
    strict = _wiped(wiped)
    kind = returns.schema["strategy"].dataType.simpleString()
    time = returns.schema["t"].dataType.simpleString()

    def one(group: pd.DataFrame) -> pd.DataFrame:
        name, out, held, equity = group["strategy"].iloc[0], [], {}, 1.0
        group, seen = group.sort_values(["t", "asset"], ignore_index=True), 0
        for t, now in group.groupby("t", sort=True):
            if now["asset"].duplicated().any():
                raise Refused(f"an asset with two returns at {t}")
            earned = dict(zip(now["asset"], now["r"], strict=True))
            target = decide(name, t, group.iloc[:seen], dict(held))  # rows are in order, so the past is what lies before
            seen += len(now)
            if bad := [a for a, w in target.items() if not math.isfinite(w) or w and not math.isfinite(earned.get(a, math.nan))]:
                raise Refused(f"weights without a return at {t}: {bad[:3]}")
            if sum(map(abs, target.values())) > gross_cap + 1e-9:
                raise Refused(f"gross exposure above the cap at {t}")
            turnover = math.fsum(abs(target.get(a, 0.0) - held.get(a, 0.0)) for a in {*target, *held})
            cost, borrow = turnover * fee_bps / 10_000, math.fsum(-w for w in target.values() if w < 0) * borrow_rate_bps / 10_000 * days / YEAR_DAYS
            gross = math.fsum(w * earned[a] for a, w in target.items() if w)
            net = (1 - cost) * (1 - borrow) * (1 + gross) - 1
            if strict and (gross <= -1 or net <= -1):
                raise Refused(f"the portfolio is wiped out at {t}")
            equity *= 1 + net if net >= -1 else math.nan
            held = {a: float(np.divide(w * (1 + earned[a]), 1 + gross)) for a, w in target.items() if w} if gross == -1 else {a: w * (1 + earned[a]) / (1 + gross) for a, w in target.items() if w}
            out.append((name, t, turnover, cost, borrow, net, equity))
        return pd.DataFrame(out, columns=["strategy", "t", "turnover", "cost", "borrow", "net", "equity"])

    told = returns.select("strategy", "t", "asset", "r").groupBy("strategy").applyInPandas(one, f"strategy {kind}, t {time}, turnover double, cost double, borrow double, net double, equity double")
    # pandas hands over a number that is none as a null.
    return told if strict else told.withColumns({c: F.coalesce(c, F.lit(math.nan)) for c in ("turnover", "cost", "net", "equity")})


#: A rule: from the window of an asset's past to its new weight, by strategy, t, asset and r, which is the asset's return in its period before.
Rule = Callable[[WindowSpec], Column]


def ruled(returns: DataFrame, rule: Rule, fee_bps: float = 6.0, borrow_rate_bps: float = 100.0, days: int = 1, gross_cap: float = 10.0, wiped: str = "refuse") -> DataFrame:
    """What `run` tells, of strategies that are asked before each period for one asset at a time: books of any width, none of them in one task.

    returns (strategy, t, asset, r). The return of the period that is decided on is not in the rule's sight: `r` is the one before, null in an asset's first period, and F.avg("r").over(past)
    is the mean of all before. A strategy's calendar has the periods of any of its assets; what is held and has no return in the next one is sold then. `run`'s refusals hold.
    The panel moves once, by asset, or not at all if it lies so; gross returns, a row a strategy and period, are what is broadcast, and sums by period leave a task as a row each.
    """
    strict = _wiped(wiped)
    path = Window.partitionBy("strategy", "asset").orderBy("t")
    returns = refuse(returns, F.expr("strategy IS NULL OR t IS NULL OR asset IS NULL"), "a return of no strategy, period or asset")
    rows = returns.select("strategy", "t", "asset", F.lag("r").over(path).alias("r"), F.col("r").alias("_r"))
    rows = rows.select("strategy", "t", "asset", "_r", rule(path.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("_w"))
    finite = lambda c: F.coalesce(F.abs(F.col(c)) < math.inf, F.lit(False))
    rows = refuse(rows, ~finite("_w") | (F.col("_w") != 0) & ~finite("_r"), "a weight that is no number, or without a return")
    earned = F.when(F.col("_w") != 0, F.col("_w") * F.col("_r")).otherwise(0.0)
    short = F.sum(F.when(F.col("_w") < 0, -F.col("_w")).otherwise(0.0))
    period = rows.groupBy("strategy", "t").agg(F.sum(earned).alias("_gross"), short.alias("_short"), F.sum(F.abs("_w")).alias("_book"))
    period = refuse(period, F.col("_book") > gross_cap + 1e-9, "gross exposure above the cap")
    if strict:
        period = refuse(period, F.col("_gross") <= -1, "the portfolio is wiped out")
    calendar = Window.partitionBy("strategy").orderBy("t")
    spans = period.select("strategy", "t", "_gross", F.lag("t").over(calendar).alias("_before"), F.lead("t").over(calendar).alias("_next"))
    drift = F.when(F.col("_w") != 0, _over(F.col("_w") * (1 + F.col("_r")), 1 + F.col("_gross"))).otherwise(0.0)
    held = rows.join(F.broadcast(spans), ["strategy", "t"]).withColumn("_d", drift)
    held = held.withColumns({"_last": F.lag("t").over(path), "_had": F.lag("_d").over(path), "_then": F.lead("t").over(path)})
    held = refuse(held, F.col("_last") == F.col("t"), "an asset with two returns in a period")
    traded = F.abs(F.col("_w") - F.when(F.col("_last") == F.col("_before"), F.col("_had")).otherwise(0.0))
    left = F.when(F.col("_then") == F.col("_next"), 0.0).otherwise(F.abs("_d"))
    moved = held.groupBy("strategy", "t").agg(F.sum(traded).alias("_traded"), F.sum(left).alias("_left"))
    told = period.join(moved, ["strategy", "t"]).withColumn("turnover", F.col("_traded") + F.coalesce(F.lag("_left").over(calendar), F.lit(0.0)))
    told = told.withColumns({"cost": F.col("turnover") * fee_bps / 10_000, "borrow": F.col("_short") * borrow_rate_bps / 10_000 * days / YEAR_DAYS})
    told = told.withColumn("net", (1 - F.col("cost")) * (1 - F.col("borrow")) * (1 + F.col("_gross")) - 1)
    if strict:
        told = refuse(told, F.col("net") <= -1, "the portfolio is wiped out")
    equity = F.exp(F.sum(grown_log(F.col("net"))).over(calendar.rowsBetween(Window.unboundedPreceding, 0)))
    return told.select("strategy", "t", "turnover", "cost", "borrow", "net", equity.alias("equity"))


def chained(tested: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """tested (strategy, window, t, turnover, cost, borrow, net), the test rows of a walk-forward, with equity along all windows; two windows that test one period are refused."""
    twice = tested.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "t")))
    told = refuse(twice, F.col("_n") > 1, "two windows test one period").drop("_n")
    return told.withColumn("equity", F.exp(F.sum(grown_log(F.col("net"))).over(Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0))))


def window_spread(net: DataFrame, benchmark: DataFrame, windows: list[tuple[int, int, int, int, int]], periods: float = 252.0, tail: float = 0.05, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """by, side, windows, mean, deviation, least, low, median, high, most and positive: how the Sharpe ratios of the test windows of a walk-forward vary, for the strategy and for the benchmark over the same periods; ahead: in how many windows the strategy's is the higher one.

    net (by, t, net), benchmark (t, net) with one return a period, windows as from `costs.walk_forward`. A test period of a strategy without a return of the
    benchmark is refused, so one side never stands without the other; a window without dispersion on a side has no ratio there and is left out of that side.
    The benchmark is as long as the calendar; it is joined by period and not broadcast by us. One shuffle by period, one by strategy.
    """
    if not 0 < tail < 0.5:
        raise Refused("a tail lies between 0 and a half")
    base = benchmark.groupBy("t").agg(F.max("net").alias("_b"), F.count("*").alias("_n"))
    base = refuse(base, F.col("_n") > 1, "two returns of the benchmark in one period").drop("_n")
    told = in_windows(net.select(*by, "t", "net"), windows).where("role = 'test'").join(base, "t", "left")
    told = refuse(told, F.col("_b").isNull(), "a period without a return of the benchmark")
    ratio = lambda c: F.when(F.stddev_samp(c) > 0, F.avg(c) / F.stddev_samp(c) * math.sqrt(periods))
    each = told.groupBy(*by, "window").agg(ratio("net").alias("_s"), ratio("_b").alias("_b"))
    ahead = F.count_if(F.col("_s") > F.col("_b")).alias("ahead")

    def side(name: str, c: str) -> Column:
        ends = F.percentile(c, [tail, 0.5, 1 - tail])
        return F.struct(F.lit(name).alias("side"), F.count(c).alias("windows"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("deviation"), F.min(c).alias("least"), ends[0].alias("low"), ends[1].alias("median"), ends[2].alias("high"), F.max(c).alias("most"), F.count_if(F.col(c) > 0).alias("positive"), ahead).alias(f"_{name}")

    return each.groupBy(*by).agg(side("strategy", "_s"), side("benchmark", "_b")).select(*by, F.inline(F.array("_strategy", "_benchmark")))


def aggregated(chain: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """By strategy over all windows: windows, periods, the sums of turnover, cost and borrow, the total return, and the least and the largest return of a window."""
    each = chain.groupBy(*by, "window").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("turnover", "cost", "borrow")], F.sum(grown_log(F.col("net"))).alias("_log"))
    return each.groupBy(*by).agg(F.count("*").alias("windows"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("turnover", "cost", "borrow")], F.expm1(F.sum("_log")).alias("total"), F.expm1(F.min("_log")).alias("worst_window"), F.expm1(F.max("_log")).alias("best_window"))


def summary(net: DataFrame, periods: float = 252.0, z: float = 1.959963984540054, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """strategy, metric, value, low and high: mean, volatility, Sharpe ratio, total return and hit rate, each with its normal interval where it has one.

    Standard errors: of the mean s / sqrt(n); of the volatility s / sqrt(2 (n - 1)); of the ratio by its skewness and kurtosis; of the hit rate as a share.
    One aggregation.
    """
    n, m, s = F.count("net").cast("double"), F.avg("net"), F.stddev_samp("net")
    told = net.groupBy(*by).agg(n.alias("n"), m.alias("m"), s.alias("s"), F.skewness("net").alias("g"), (F.kurtosis("net") + 3).alias("k"), F.expm1(F.sum(grown_log(F.col("net")))).alias("total"), F.avg((F.col("net") > 0).cast("double")).alias("p"))
    told = refuse(told, (F.col("n") < 3) | ~F.coalesce(F.col("s") > 0, F.lit(False)), "three returns or more, with dispersion")
    root = math.sqrt(periods)
    ratio = F.col("m") / F.col("s")
    error = {
        "mean": (F.col("m"), F.col("s") / F.sqrt("n")),
        "volatility": (F.col("s") * root, F.col("s") * root / F.sqrt(2 * (F.col("n") - 1))),
        "sharpe": (ratio * root, F.sqrt((1 - F.col("g") * ratio + (F.col("k") - 1) / 4 * ratio * ratio) / (F.col("n") - 1)) * root),
        "total": (F.col("total"), F.lit(None).cast("double")),
        "hit_rate": (F.col("p"), F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))),
    }
    rows = [F.struct(F.lit(name).alias("metric"), value.alias("value"), (value - z * e).alias("low"), (value + z * e).alias("high")) for name, (value, e) in error.items()]
    return told.select(*by, F.inline(F.array(*rows)))


def compared(summaries: DataFrame, base: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """summaries against one of them (metric, value): each metric with the base's value, the difference, and whether the base lies outside its interval. A metric that one side lacks is kept, with nulls."""
    told = summaries.join(F.broadcast(base.select("metric", F.col("value").alias("base"))), "metric", "left")  # a row a metric
    outside = (F.col("base") < F.col("low")) | (F.col("base") > F.col("high"))
    return told.select(*by, "metric", "value", "base", (F.col("value") - F.col("base")).alias("difference"), outside.alias("outside"))


def digests(net: DataFrame, scale: int = 12, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """strategy, n and the SHA-256 of its periods and net returns, rounded and in order: the same runs have the same digest wherever they ran. A strategy's rows are one array, as long as its calendar."""
    line = F.struct("t", F.concat_ws(":", F.col("t").cast("string"), F.col("net").cast(f"decimal(38,{scale})").cast("string")).alias("x"))
    return net.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda v: v["x"]), "\n"), 256).alias("digest"))


def normal(*parts: Column) -> Column:
    """A standard normal number that is a function of the parts alone, so it does not depend on how rows are dealt out."""
    unit = lambda k: (F.shiftrightunsigned(F.xxhash64(*parts, F.lit(k)), 11) + 1) / F.lit(float(1 << 53))
    return F.sqrt(-2.0 * F.log(unit(1))) * F.cos(2 * math.pi * unit(2))


def market(spark: SparkSession, seeds: int, periods: int, assets: int, alpha: float = 0.0, sigma: float = 0.01, edge: float = 0.0) -> DataFrame:
    """seed, t, asset and r = alpha + sigma e, with `edge` more for asset 0, all made in tasks from the seed."""
    if min(seeds, periods, assets) < 1 or sigma <= 0:
        raise Refused("seeds, periods and assets must be positive, and so must sigma")
    rows = spark.range(seeds * periods * assets)
    place = rows.select(F.floor(F.col("id") / (periods * assets)).cast("int").alias("seed"), F.floor(F.col("id") / assets % periods).cast("int").alias("t"), (F.col("id") % assets).cast("int").alias("asset"))
    return place.withColumn("r", F.lit(alpha) + F.when(F.col("asset") == 0, edge).otherwise(0.0) + sigma * normal(F.col("seed"), F.col("t"), F.col("asset")))


def true_sharpe(alpha: float, sigma: float, assets: int, periods: float = 1.0) -> float:
    """Of the equally weighted book of independent assets."""
    return alpha / sigma * math.sqrt(assets * periods)


def sweep(returns: DataFrame, configs: DataFrame) -> DataFrame:
    """seed, config, n and sharpe of every configuration (config, asset, w) on every market; configs is small and is what is broadcast."""
    book = returns.join(F.broadcast(configs), "asset").groupBy("seed", "config", "t").agg(F.sum(F.col("w") * F.col("r")).alias("net"))
    s = F.stddev_samp("net")
    return book.groupBy("seed", "config").agg(F.count("*").alias("n"), F.when(s > 0, F.avg("net") / s).alias("sharpe"))


def best_of(swept: DataFrame) -> DataFrame:
    """By seed the configuration of the largest ratio (ties: the smallest), that ratio, and the mean over all: what choosing among trials adds."""
    return swept.groupBy("seed").agg(F.max_by("config", F.struct("sharpe", -F.col("config"))).alias("config"), F.max("sharpe").alias("sharpe"), F.avg("sharpe").alias("mean_sharpe"))
