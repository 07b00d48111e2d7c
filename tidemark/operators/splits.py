"""Cross-validation splits without leakage, and what their paths say about overfitting."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.facts import Refused, refuse

EULER = 0.5772156649015329


def purged_kfold(events: DataFrame, k: int, embargo: float = 0.0) -> DataFrame:
    """events (id, start, end) by fold and role: test, train, purged or embargoed.

    Folds are contiguous in start time (ties by id), earlier ones a row longer. A training row is
    purged if its span meets the test span, ends included, and embargoed if it starts in
    (end, end + embargo]. The k spans are aggregated first, and k is the size of what is broadcast.
    """
    if k < 2 or embargo < 0:
        raise Refused("two folds or more, and an embargo of zero or more")
    numbered = with_fold(events, k)
    tests = numbered.groupBy("fold").agg(F.min("start").alias("t0"), F.max("end").alias("t1"))
    return with_training(_roles(numbered, tests, embargo))


def with_training(roles: DataFrame) -> DataFrame:
    """roles (id, split, role), which fail as a whole if purge and embargo leave a split nothing to train on."""
    left = roles.groupBy("split").agg(F.count_if(F.col("role") == "train").alias("_n"))
    # One row a split.
    return refuse(roles.join(F.broadcast(left), "split"), F.col("_n") == 0, "a split without training rows").select(*roles.columns)


def embargo_of(events: DataFrame, duration: float | None = None, fraction: float | None = None) -> float:
    """The embargo in units of the events' time: a duration as it is, or a fraction of the time from the first start to the last end; just one of the two."""
    if (duration is None) == (fraction is None):
        raise Refused("give a duration or a fraction")
    if duration is not None:
        if duration < 0:
            raise Refused("an embargo of zero or more")
        return float(duration)
    if not 0 <= fraction < 1:
        raise Refused("a fraction from 0 up to 1")
    span = events.agg(F.min("start").alias("a"), F.max("end").alias("b")).first()
    return 0.0 if span["a"] is None else float(fraction) * float(span["b"] - span["a"])


def with_fold(events: DataFrame, k: int) -> DataFrame:
    """events with their fold from 0. Global ranks come from counts of distinct start times, not from one task's sort."""
    totals = events.groupBy("start").agg(F.count("*").alias("_m"))
    before = running_total(totals, "start", "_m")
    inside = F.row_number().over(Window.partitionBy("start").orderBy("id")) - 1
    ranked = events.join(before.select("start", "_before"), "start").withColumn("_i", F.col("_before") + inside).drop("_before")
    n = F.broadcast(totals.agg(F.sum("_m").alias("_n")))
    size, more = F.floor(F.col("_n") / k), F.col("_n") % k
    first = more * (size + 1)
    fold = F.when(F.col("_i") < first, F.floor(F.col("_i") / (size + 1))).otherwise(more + F.floor((F.col("_i") - first) / size))
    return ranked.join(n).withColumn("fold", fold.cast("int")).drop("_i", "_n")


def running_total(df: DataFrame, order: str, value: str, buckets: int = 128) -> DataFrame:
    """df with _before: the sum of `value` over all rows of smaller `order`. Sums of ranges are combined first, so no task holds all rows.

    The ranges are cut at approximate quantiles of `order`, so they hold about as many rows each however the times lie; where exactly they are cut changes no result.
    """
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(10_000)).alias("_cuts"))  # one row
    put = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda e: e <= F.col(order).cast("double")))
    cut = df.crossJoin(F.broadcast(cuts)).withColumn("_b", put).drop("_cuts")
    sums = cut.groupBy("_b").agg(F.sum(value).alias("_s"))
    offsets = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # at most `buckets` rows
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.join(F.broadcast(offsets), "_b").withColumn("_before", F.col("_o") + inside).drop("_b", "_o")


def _roles(numbered: DataFrame, tests: DataFrame, embargo: float) -> DataFrame:
    spans = F.broadcast(tests.withColumnRenamed("fold", "split"))
    meets = (F.col("start") <= F.col("t1")) & (F.col("end") >= F.col("t0"))
    waits = (F.col("start") > F.col("t1")) & (F.col("start") <= F.col("t1") + F.lit(embargo))
    role = F.when(F.col("fold") == F.col("split"), "test").when(meets, "purged").when(waits, "embargoed").otherwise("train")
    return numbered.join(spans).select("id", "split", role.alias("role"))


def runs(groups: tuple[int, ...]) -> list[tuple[int, int]]:
    """Contiguous runs of group numbers."""
    out: list[tuple[int, int]] = []
    for g in groups:
        if out and out[-1][1] == g - 1:
            out[-1] = out[-1][0], g
        else:
            out.append((g, g))
    return out


def cpcv(events: DataFrame, n: int, k: int, embargo: float = 0.0) -> DataFrame:
    """events (id, start, end) by split and role, one split for every choice of k test groups of n; purge and embargo go by contiguous run."""
    if not 1 <= k < n:
        raise Refused(f"1 <= {k} < {n} must hold")
    numbered = with_fold(events, n)
    spark, choices = events.sparkSession, list(combinations(range(n), k))
    told = spark.createDataFrame([(s, a, b, list(c)) for s, c in enumerate(choices) for a, b in runs(c)], "split int, a int, b int, groups array<int>")
    folds = numbered.groupBy("fold").agg(F.min("start").alias("t0"), F.max("end").alias("t1"))
    tests = told.join(folds, F.col("fold").between(F.col("a"), F.col("b"))).groupBy("split", "a").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.first("groups").alias("groups"))
    spans = tests.groupBy("split").agg(F.first("groups").alias("groups"), F.collect_list(F.struct("t0", "t1")).alias("spans"))
    meets = F.exists("spans", lambda s: (F.col("start") <= s["t1"]) & (F.col("end") >= s["t0"]))
    waits = F.exists("spans", lambda s: (F.col("start") > s["t1"]) & (F.col("start") <= s["t1"] + F.lit(embargo)))
    role = F.when(F.array_contains("groups", F.col("fold")), "test").when(meets, "purged").when(waits, "embargoed").otherwise("train")
    return with_training(numbered.join(F.broadcast(spans)).select("id", "split", "fold", role.alias("role")))


def cpcv_paths(spark, n: int, k: int) -> DataFrame:
    """(path, grp, split): the i-th split that tests a group gives the group's part of path i."""
    told = spark.createDataFrame([(s, g) for s, c in enumerate(combinations(range(n), k)) for g in c], "split int, grp int")
    return told.select((F.row_number().over(Window.partitionBy("grp").orderBy("split")) - 1).alias("path"), "grp", "split")


def path_sharpes(returns: DataFrame, paths: DataFrame, periods: float = 1.0) -> DataFrame:
    """path, n and sharpe of the returns (split, grp, t, r) put together along each path (path, grp, split); a path without dispersion is refused.

    paths has one row a path and group and is what is broadcast.
    """
    told = returns.join(F.broadcast(paths), ["split", "grp"]).groupBy("path").agg(F.count("r").alias("n"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"))
    told = refuse(told, ~F.coalesce(F.col("_s") > 0, F.lit(False)), "a path without dispersion")
    return told.select("path", "n", (F.col("_m") / F.col("_s") * math.sqrt(periods)).alias("sharpe"))


def distribution(values: DataFrame, col: str = "sharpe", level: float = 0.95) -> DataFrame:
    """One row over the paths: n, mean, median, std (sample), low and high of the percentile interval, and the share above zero."""
    if not 0 < level < 1:
        raise Refused("a level between 0 and 1")
    quantile = lambda q: F.percentile(col, F.lit(q))
    return values.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), quantile(0.5).alias("median"), F.stddev_samp(col).alias("std"), quantile((1 - level) / 2).alias("low"), quantile((1 + level) / 2).alias("high"), F.avg((F.col(col) > 0).cast("double")).alias("positive"))


def sharpe(excess: Column | str, periods: float = 1.0) -> Column:
    """Mean over sample deviation; missing without dispersion."""
    s = F.stddev_samp(excess)
    return F.when(s > 0, F.avg(excess) / s * math.sqrt(periods))


def moments(df: DataFrame, col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, Sharpe ratio, population skewness and (not excess) kurtosis."""
    return df.groupBy(*by).agg(F.count(col).alias("n"), sharpe(col).alias("sharpe"), F.skewness(col).alias("skew"), (F.kurtosis(col) + 3).alias("kurtosis"))


def average_rank(by: list[str], order: Column) -> Column:
    """Rank from 1 within `by`; ties share their mean rank."""
    w = Window.partitionBy(*by).orderBy(order)
    return F.rank().over(w) + (F.count("*").over(w.rangeBetween(0, 0)) - 1) / F.lit(2.0)


def probabilistic_sharpe(observed: float, benchmark: float, n: int, skew: float, kurtosis: float) -> float:
    """Probability that the true ratio exceeds the benchmark."""
    spread = 1 - skew * observed + (kurtosis - 1) / 4 * observed**2
    if n < 2 or spread <= 0:
        raise Refused("two observations or more, and a positive variance")
    return NormalDist().cdf((observed - benchmark) * math.sqrt(n - 1) / math.sqrt(spread))


def expected_max_sharpe(trials: int, variance: float) -> float:
    """What the best of so many trials without skill is expected to show."""
    if trials < 1 or variance < 0:
        raise Refused("one trial or more, and a variance of zero or more")
    if trials == 1 or variance == 0:
        return 0.0
    z = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * z(1 - 1 / trials) + EULER * z(1 - 1 / (trials * math.e)))


def deflated_sharpe(observed: float, n: int, skew: float, kurtosis: float, trials: int, variance: float) -> float:
    return probabilistic_sharpe(observed, expected_max_sharpe(trials, variance), n, skew, kurtosis)


def deflated_sharpe_of_returns(returns: list[float], trials: int, variance: float) -> float:
    """From the returns themselves, which one strategy's calendar bounds; refused without dispersion."""
    n = len(returns)
    if n < 3:
        raise Refused("three returns or more")
    mean = math.fsum(returns) / n
    central = lambda k: math.fsum((x - mean) ** k for x in returns) / n
    v = central(2)
    if v <= 0:
        raise Refused("returns without dispersion")
    return deflated_sharpe(mean / math.sqrt(v * n / (n - 1)), n, central(3) / v**1.5, central(4) / v**2, trials, variance)


def normal_cdf(z: Column) -> Column:
    """Of the standard normal distribution, by a rational approximation whose error is below 1.2e-7 of the tail."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * x)
    # Coefficients of the public Chebyshev fit of the complementary error function.
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    tail = 0.5 * t * F.exp(-x * x + poly)
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def deflated_sharpe_of_trials(trials: DataFrame, by: str = "trial", col: str = "r") -> DataFrame:
    """trials (trial, r) to trial, n, sharpe, benchmark and dsr: each trial against the best that so many trials of this spread of ratios are expected to show without skill.

    One aggregation over the returns; what returns to the driver is the number and the variance of the ratios.
    """
    told = moments(trials, col, (by,))
    told = refuse(told, F.col("sharpe").isNull(), "a trial without dispersion")
    spread = told.agg(F.count("*").alias("k"), F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("v")).first()
    best = expected_max_sharpe(spread["k"], spread["v"]) if spread["k"] else 0.0
    s = F.col("sharpe")
    told = told.withColumn("_width", 1 - F.col("skew") * s + (F.col("kurtosis") - 1) / 4 * s * s)
    told = refuse(told, (F.col("n") < 2) | (F.col("_width") <= 0), "two returns or more, and a positive variance")
    told = told.withColumn("_z", (s - best) * F.sqrt(F.col("n") - 1.0) / F.sqrt("_width"))
    return told.select(by, "n", "sharpe", F.lit(best).alias("benchmark"), normal_cdf(F.col("_z")).alias("dsr"))


def block_sums(panel: DataFrame, blocks: int, periods: int) -> DataFrame:
    """panel (t, config, r) to n, sum and sum of squares by block and config; earlier blocks are a period longer."""
    size, more = divmod(periods, blocks)
    first = more * (size + 1)
    block = F.when(F.col("t") < first, F.floor(F.col("t") / (size + 1))).otherwise(more + F.floor((F.col("t") - first) / max(size, 1)))
    return panel.groupBy(block.cast("int").alias("block"), "config").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))


def pbo_splits(panel: DataFrame, blocks: int, periods: int) -> DataFrame:
    """For every choice of half the blocks: the configuration that is best inside, its rank outside, and its logit.

    Sharpe ratios come from block sums: one pass over the returns, then tables of blocks times configurations.
    """
    if blocks % 2 or blocks < 2 or blocks > periods:
        raise Refused("an even number of blocks, at most one a period")
    sums, spark = block_sums(panel, blocks, periods), panel.sparkSession
    told = [(i, b, b in c) for i, c in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    sides = spark.createDataFrame(told, "split int, block int, inside boolean")
    by = sums.join(F.broadcast(sides), "block").groupBy("split", "config", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    variance = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    ratio = F.when(variance > 0, F.col("s") / F.col("n") / F.sqrt(variance))
    scored = by.select("split", "config", "inside", ratio.alias("v")).groupBy("split", "config").agg(F.max(F.when(F.col("inside"), F.col("v"))).alias("inside"), F.max(F.when(~F.col("inside"), F.col("v"))).alias("outside"))
    return _best(scored)


def pbo_splits_by(panel: DataFrame, blocks: int, periods: int, performance: Callable[[np.ndarray], float]) -> DataFrame:
    """pbo_splits with a performance of the caller's own: from the returns of a configuration on one side of a split, in order of time, to a number; more is better.

    A configuration's returns are one group, as long as its calendar; what it gives is one row a split.
    """
    if blocks % 2 or blocks < 2 or blocks > periods:
        raise Refused("an even number of blocks, at most one a period")
    choices = list(combinations(range(blocks), blocks // 2))
    cuts = np.array_split(np.arange(periods), blocks)
    kind = panel.schema["config"].dataType.simpleString()

    def score(group: pd.DataFrame) -> pd.DataFrame:
        r = group.set_index("t")["r"].reindex(range(periods)).to_numpy(float)
        out = []
        for i, c in enumerate(choices):
            sides = [np.concatenate([cuts[b] for b in range(blocks) if (b in c) == inside]) for inside in (True, False)]
            inside, outside = (float(performance(x[np.isfinite(x)])) for x in (r[s] for s in sides))
            if not (math.isfinite(inside) and math.isfinite(outside)):
                raise Refused("a performance that is no number")
            out.append((i, group["config"].iloc[0], inside, outside))
        return pd.DataFrame(out, columns=["split", "config", "inside", "outside"])

    scored = panel.select("t", "config", "r").groupBy("config").applyInPandas(score, f"split int, config {kind}, inside double, outside double")
    return _best(scored)


def _best(scored: DataFrame) -> DataFrame:
    """Of (split, config, inside, outside): the best inside, its rank outside and the logit of that."""
    ranked = scored.withColumn("rank", average_rank(["split"], F.col("outside")))
    best = ranked.groupBy("split").agg(F.max_by(F.struct("config", "rank"), F.struct(F.col("inside"), -F.col("config"))).alias("b"), F.count("*").alias("n"))
    omega = F.col("b.rank") / (F.col("n") + 1)
    return best.select("split", F.col("b.config").alias("best"), F.col("b.rank").alias("rank"), F.log(omega / (1 - omega)).alias("logit"))


def pbo(splits: DataFrame) -> DataFrame:
    """Share of splits whose best configuration ranks in the lower half outside."""
    return splits.agg(F.count("*").alias("splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"))
