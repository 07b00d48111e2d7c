"""Resampled intervals against draws made one by one."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tidemark.operators import backtests, draws
from tidemark.operators.facts import Refused

NET = "strategy string, t int, net double"


def series(n, seed, name="a"):
    return [(name, t, float(x)) for t, x in enumerate(np.random.default_rng(seed).normal(0.001, 0.02, n))]


def told(x, periods=252.0):
    """The metrics of one path, by their definitions."""
    path = np.concatenate([[1.0], np.cumprod(1 + x)])
    sd = x.std(ddof=1)
    return {
        "mean": x.mean(),
        "volatility": sd * math.sqrt(periods),
        "sharpe": x.mean() / sd * math.sqrt(periods),
        "total": path[-1] - 1,
        "annual": path[-1] ** (periods / len(x)) - 1,
        "max_drawdown": (1 - path / np.maximum.accumulate(path)).max(),
        "hit_rate": (x > 0).mean(),
    }


def drawn(x, block, seed, d):
    n = len(x)
    starts = [int(hashlib.md5(f"{seed}:{d}:{k}".encode()).hexdigest()[:8], 16) % n for k in range(-(-n // block))]
    return np.array([x[(s + j) % n] for s in starts for j in range(block)][:n])


@pytest.mark.parametrize("n,block", [(23, 5), (20, 5), (2, 1), (7, 7), (9, 8)])
def test_intervals_equal_draws_made_one_by_one(spark, n, block):
    rows = series(n, n) + series(n + 4, 1, "b")
    got = {(r.strategy, r.metric): r for r in draws.resampled(spark.createDataFrame(rows, NET).repartition(5), block, 60, 9).collect()}
    for name in "ab":
        x = np.array([v for s, _, v in rows if s == name])
        own, many = told(x), [told(y) for d in range(1, 61) if (y := drawn(x, block, 9, d)).std() > 0]
        for m in draws.METRICS:
            r = got[name, m]
            assert r.value == pytest.approx(own[m])
            if m != "sharpe" and len(many) < 60:
                continue
            assert (r.low, r.high) == pytest.approx(tuple(np.quantile([z[m] for z in many], [0.025, 0.975])))


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([r for k in range(6) for r in series(40, k, f"s{k}")], NET)
    key = lambda d: sorted(map(tuple, draws.resampled(d, 4, 30, 1).collect()))
    assert key(df) == key(df.repartition(9, "t")) and key(df) != sorted(map(tuple, draws.resampled(df, 4, 30, 2).collect()))


def test_bad_series_are_refused(spark):
    good = spark.createDataFrame(series(10, 1), NET)
    for bad in ([("a", 10, None)], [("a", 10, math.nan)], [("a", 10, -1.0)], [("a", 10, math.inf)], [("b", 0, 0.1)]):
        with pytest.raises(PySparkException):
            draws.resampled(good.unionAll(spark.createDataFrame(bad, NET)), 3, 10, 1).collect()
    with pytest.raises(PySparkException, match="two draws"):
        draws.resampled(spark.createDataFrame([("a", t, 0.01) for t in range(10)], NET), 3, 10, 1).collect()
    with pytest.raises(Refused):
        draws.resampled(good, 0, 10, 1)
    assert draws.resampled(good.where("false"), 3, 10, 1).count() == 0 and draws.block_length(1000) == 10


def test_a_benchmark_lies_within_or_outside_the_intervals(spark):
    found = draws.resampled(spark.createDataFrame(series(60, 4), NET), 4, 200, 3)
    base = spark.createDataFrame([("mean", 0.5), ("hit_rate", 0.5)], "metric string, value double")
    got = {r.metric: r.outside for r in backtests.compared(found, base).collect()}
    assert got["mean"] and not got["hit_rate"] and got["annual"] is None
