"""Intervals of every metric of a return series by circular blocks that a hash draws, the same however rows are dealt out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.costs import _wiped, grown_log
from tidemark.operators.facts import Refused, refuse

METRICS = ("mean", "volatility", "sharpe", "total", "annual", "max_drawdown", "hit_rate")


def block_length(n: int) -> int:
    """The cube root of the number of periods, which is a usual length of a block."""
    return max(1, min(n, round(n ** (1 / 3))))


def _path(x: Column) -> Column:
    """What a stretch of centred returns with their logarithms (c, l, up) adds to a path: its sums, its highest and lowest point above its start, and its largest fall, in logarithms."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("total"), F.lit(-math.inf).alias("high"), F.lit(math.inf).alias("low"), zero.alias("fall"), zero.alias("s"), zero.alias("q"), zero.alias("up"))
    one = lambda v: F.struct(v["l"].alias("total"), v["l"].alias("high"), v["l"].alias("low"), zero.alias("fall"), v["c"].alias("s"), (v["c"] * v["c"]).alias("q"), v["up"].alias("up"))
    return F.aggregate(F.transform(x, one), start, _after)


def _after(a: Column, b: Column) -> Column:
    """The stretch a followed by the stretch b."""
    below = F.when((a["total"] == -math.inf) | (b["low"] == -math.inf), math.inf).otherwise(a["high"] - a["total"] - b["low"])  # after a loss of all
    return F.struct(
        (a["total"] + b["total"]).alias("total"),
        F.greatest(a["high"], a["total"] + b["high"]).alias("high"),
        F.least(a["low"], a["total"] + b["low"]).alias("low"),
        F.greatest(a["fall"], b["fall"], below).alias("fall"),
        (a["s"] + b["s"]).alias("s"),
        (a["q"] + b["q"]).alias("q"),
        (a["up"] + b["up"]).alias("up"),
    )


def paths(net: DataFrame, block: int, draws: int, seed: int, periods: float = 252.0, by: tuple[str, ...] = ("strategy",), wiped: str = "refuse") -> DataFrame:
    """by, draw and the metrics of each drawn path; draw 0 is the path itself.

    Draw d of n returns joins ceil(n / block) blocks, the last cut to fit; block k starts at the first eight hex digits of
    md5(`seed:d:k`) modulo n and goes on at the first return when the last is reached. So a draw is a function of its number alone, and
    series of one length are drawn alike, which pairs them. The drawdown counts the start at 1; the Sharpe ratio is null without dispersion.
    What a block adds to a path is told once for each start, so a draw costs as many steps as it has blocks. A series is
    one row of an array as long as its calendar; all work on it needs the one shuffle by series. Ties in t are ordered by return.
    Nulls, numbers that are none, returns of -1 or less and series shorter than two or than a block are refused; with wiped "keep"
    returns of -1 or less are not, and total, annual and drawdown of a path with a loss of more than all are no number.
    """
    if block < 1 or draws < 2:
        raise Refused("a block of a period or more, and two draws or more")
    strict, each = _wiped(wiped), Window.partitionBy(*by)
    in_order = each.orderBy("t", "_x")  # sums in one order, so that they do not depend on how rows arrive
    x = F.col("net").cast("double")
    rows = refuse(net.select(*by, "t", x.alias("_x")), F.col("_x").isNull() | F.isnan("_x") | (F.abs("_x") == math.inf) | (F.lit(strict) & (F.col("_x") <= -1)), "a return that is no number above -1")
    rows = rows.select(*by, "_x", F.count("*").over(each).alias("_n"), F.avg("_x").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_m"), (F.row_number().over(in_order) - 1).alias("_i"))
    rows = refuse(rows, F.col("_n") < max(2, block), "fewer returns than a block, or than two")
    one = F.struct((F.col("_x") - F.col("_m")).alias("c"), grown_log(F.col("_x")).alias("l"), (F.col("_x") > 0).cast("double").alias("up"))
    # The first returns stand behind the last once more, so that a block that goes round is a frame.
    round_ = rows.select(*by, "_n", "_m", one.alias("_v"), F.explode(F.when(F.col("_i") < block - 1, F.array("_i", F.col("_i") + F.col("_n"))).otherwise(F.array("_i"))).alias("_i"))
    framed = round_.withColumn("_a", F.collect_list("_v").over(each.orderBy("_i").rowsBetween(0, block - 1))).where("_i < _n")
    rest = (F.col("_n") - (F.ceil(F.col("_n") / block) - 1) * block).cast("int")
    starts = framed.select(*by, "_n", "_m", F.struct(F.col("_i").alias("i"), _path(F.col("_a")).alias("full"), _path(F.slice("_a", F.lit(1), rest)).alias("rest")).alias("_s"))
    series = starts.groupBy(*by).agg(F.first("_n").alias("_n"), F.first("_m").alias("_m"), F.array_sort(F.collect_list("_s")).alias("_s"))
    last = (F.ceil(F.col("_n") / block) - 1).cast("int")

    def drawn(d: Column) -> Column:
        def picked(k: Column) -> Column:
            hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), d.cast("string"), k.cast("string"))), 1, 8), 16, 10).cast("long")
            at = F.get("_s", F.when(d == 0, k * block).otherwise(F.pmod(hashed, F.col("_n"))).cast("int"))
            return F.when(k == last, at["rest"]).otherwise(at["full"])

        zero = F.lit(0.0)
        none = F.struct(*[zero.alias(c) for c in ("total", "high", "low", "fall", "s", "q", "up")])
        return F.struct(d.alias("draw"), F.aggregate(F.transform(F.sequence(F.lit(0), last), picked), none, _after).alias("p"))

    told = series.select(*by, "_n", "_m", F.explode(F.transform(F.sequence(F.lit(0), F.lit(draws)), drawn)).alias("_d")).select(*by, "_n", "_m", "_d.draw", "_d.p.*")
    n, root = F.col("_n").cast("double"), math.sqrt(periods)
    spread = F.col("q") - F.col("s") * F.col("s") / n
    told = told.withColumn("_mean", F.col("_m") + F.col("s") / n).withColumn("_sd", F.when(spread > 1e-12 * F.col("q"), F.sqrt(spread / (n - 1))).otherwise(0.0))
    return told.select(
        *by,
        "draw",
        F.col("_mean").alias("mean"),
        (F.col("_sd") * root).alias("volatility"),
        F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * root).alias("sharpe"),
        F.expm1("total").alias("total"),
        F.expm1(F.col("total") * periods / n).alias("annual"),
        (-F.expm1(-F.col("fall"))).alias("max_drawdown"),
        (F.col("up") / n).alias("hit_rate"),
    )


def resampled(net: DataFrame, block: int, draws: int, seed: int, periods: float = 252.0, level: float = 0.95, by: tuple[str, ...] = ("strategy",), wiped: str = "refuse") -> DataFrame:
    """by, metric, value, low and high: METRICS of every series with the interval that `level` of the drawn paths fall in.

    Draws in which a metric has no number are left out of its interval; a metric with fewer than two that have one is refused.
    """
    if not 0 < level < 1:
        raise Refused("the level lies between 0 and 1")
    ends, taken = [(1 - level) / 2, (1 + level) / 2], F.col("draw") > 0
    each = paths(net, block, draws, seed, periods, by, wiped).groupBy(*by)
    told = each.agg(*[F.struct(F.lit(m).alias("metric"), F.max(F.when(~taken, F.col(m))).alias("value"), F.percentile(F.when(taken, F.col(m)), ends).alias("ends"), F.count(F.when(taken, F.col(m))).alias("n")).alias(m) for m in METRICS])
    rows = told.select(*by, F.inline(F.array(*METRICS)))
    return refuse(rows, F.col("n") < 2, "a metric without two draws that have a number").select(*by, "metric", "value", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))
