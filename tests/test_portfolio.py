"""Strategies that decide, portfolios within limits, orders, slices and budgets: refusals and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import backtests, costs, execution, portfolio
from tidemark.operators.facts import Refused

RETURNS = "strategy string, t int, asset string, r double"


def test_a_strategy_sees_the_past_only(spark):
    rows = [("s", t, a, 0.01 * (t + 1) * (1 if a == "x" else -1)) for t in range(4) for a in "xy"]
    told = spark.createDataFrame(rows, RETURNS)

    def decide(name, t, seen, held):
        assert (seen["t"] < t).all()
        return {"x": 0.5} if len(seen) else {}

    got = {r.t: r for r in backtests.run(told, decide, fee_bps=10.0).collect()}
    assert got[0].net == 0 and got[1].turnover == 0.5 and got[1].net == pytest.approx((1 - 0.0005) * 1.01 - 1)
    drifted = 0.5 * 1.02 / 1.01
    assert got[2].turnover == pytest.approx(drifted - 0.5) and got[3].equity == pytest.approx(math.prod(1 + got[t].net for t in range(4)))
    leave = backtests.run(spark.createDataFrame([("s", 0, "x", 0.1), ("s", 1, "y", 0.1)], RETURNS), lambda n, t, s, h: {"x": 1.0} if t == 0 else {})
    assert {r.t: r.turnover for r in leave.collect()} == {0: 1.0, 1: pytest.approx(1.0)}


@pytest.mark.parametrize("target,r", [({"x": 1.0}, -1.0), ({"z": 1.0}, 0.1), ({"x": float("nan")}, 0.1), ({"x": 99.0}, 0.001), ({"x": 1.0}, None)])
def test_bad_periods_are_refused(spark, target, r):
    with pytest.raises(PySparkException):
        backtests.run(spark.createDataFrame([("s", 0, "x", r)], RETURNS), lambda *a: target).collect()


def test_weights_are_checked(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "strategy string, t int, asset string, w double")
    known = spark.createDataFrame([("x",), ("y",)], "asset string")
    assert backtests.checked_weights(df(("s", 0, "x", 0.5), ("s", 0, "y", -0.5)), 1.0, known).count() == 2
    for bad in ([("s", 0, "z", 0.1)], [("s", 0, "x", 0.7), ("s", 0, "y", -0.7)], [("s", 0, "x", 0.1), ("s", 0, "x", 0.1)], [("s", 0, "x", None)], [("s", 0, "x", math.inf)]):
        with pytest.raises((PySparkException, Py4JJavaError)):
            backtests.checked_weights(df(*bad), 1.0, known).collect()


def test_chains_refuse_two_windows_of_one_period(spark):
    rows = spark.createDataFrame([("s", 0, 1, 0.0, 0.0, 0.0, 0.1), ("s", 1, 1, 0.0, 0.0, 0.0, 0.1)], "strategy string, window int, t int, turnover double, cost double, borrow double, net double")
    with pytest.raises(PySparkException, match="one period"):
        backtests.chained(rows).collect()


def test_markets_depend_on_their_seed_alone(spark):
    a = backtests.market(spark, 20, 200, 5, 0.001, 0.01)
    b = backtests.market(spark, 20, 200, 5, 0.001, 0.01).repartition(7)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(a) == key(b)
    x = np.array([r.r for r in a.collect()])
    assert abs(x.mean() - 0.001) < 4 * 0.01 / math.sqrt(len(x)) and abs(x.std() / 0.01 - 1) < 0.03
    configs = spark.createDataFrame([(0, k, 0.2) for k in range(5)] + [(1, 0, 1.0)], "config int, asset int, w double")
    swept = backtests.sweep(a, configs)
    mean = swept.where("config = 0").agg(F.avg("sharpe")).first()[0]
    assert abs(mean - backtests.true_sharpe(0.001, 0.01, 5)) < 0.08
    best = backtests.best_of(swept).collect()
    assert len(best) == 20 and all(r.sharpe >= r.mean_sharpe for r in best)


def test_summary_and_digest(spark):
    rng = np.random.default_rng(1)
    rows = [("a", t, float(x)) for t, x in enumerate(rng.normal(0.001, 0.01, 100))]
    df = spark.createDataFrame(rows, "strategy string, t int, net double")
    told = {r.metric: r for r in backtests.summary(df).collect()}
    x = np.array([r[2] for r in rows])
    assert told["mean"].value == pytest.approx(x.mean()) and told["mean"].low < x.mean() < told["mean"].high and told["total"].low is None
    assert backtests.digests(df).first()["digest"] == backtests.digests(df.repartition(5).orderBy(F.rand(1))).first()["digest"]
    assert backtests.digests(df).first()["digest"] != backtests.digests(df.withColumn("net", F.when(F.col("t") == 5, 0.5).otherwise(F.col("net")))).first()["digest"]
    with pytest.raises(PySparkException):
        backtests.summary(df.withColumn("net", F.lit(0.1))).collect()


def test_optimum_meets_sector_and_beta_limits():
    rng = np.random.default_rng(2)
    n = 14
    alpha, betas, sectors = rng.normal(size=n) * 0.02, rng.uniform(0.2, 1.8, n), np.arange(n) % 3
    cov = np.outer(betas, betas) * 0.01 + np.diag(rng.uniform(0.01, 0.03, n))
    limits = portfolio.Limits(0.0, 0.2, 1.0, 0.1, 0.05)
    w = portfolio.optimum(alpha, cov, np.zeros(n), sectors, betas, limits)
    assert abs(w.sum()) < 1e-5 and np.abs(w).max() <= 0.2 + 1e-6 and np.abs(w).sum() <= 1 + 1e-6 and abs(w @ betas) <= 0.05 + 1e-5
    assert all(abs(w[sectors == s].sum()) <= 0.1 + 1e-5 for s in range(3))
    value = lambda x: alpha @ x - x @ cov @ x
    for _ in range(2000):
        step = rng.normal(size=n) * 0.01
        step -= step.mean()
        y = w + step
        if np.abs(y).max() <= 0.2 and np.abs(y).sum() <= 1 and abs(y @ betas) <= 0.05 and all(abs(y[sectors == s].sum()) <= 0.1 for s in range(3)):
            assert value(y) <= value(w) + 1e-6
    with pytest.raises(Refused, match="sectors"):
        portfolio.optimum(alpha, cov, np.zeros(n), sectors, betas, portfolio.Limits(0.9, 0.2, 1.0, 0.1))
    with pytest.raises(Refused, match="beta"):
        portfolio.optimum(alpha, cov, np.zeros(n), sectors, betas, portfolio.Limits(1.0, 0.2, 1.0, None, 0.01))


def test_reachable_exposure(spark):
    rng = random.Random(3)
    e = [rng.uniform(-2, 2) for _ in range(6)]
    df = spark.createDataFrame([(0, k, x) for k, x in enumerate(e)], "t int, asset int, beta double")
    got = portfolio.reachable_exposure(df, 0.3, 1.0).first()
    best = max(sum(w * x for w, x in zip(ws, e, strict=True)) for ws in itertools.product([-0.3, -0.1, 0.0, 0.1, 0.3], repeat=6) if sum(map(abs, ws)) <= 1.0 + 1e-9)
    assert got.reachable == pytest.approx(best) == pytest.approx(portfolio.reachable(np.array(e), 0.3, 1.0))


def test_ladder_and_infeasible_dates(spark):
    rows = [(t, a, 0.01 * a, 0.02, 1.0, 0, 0.0) for t in (0, 1) for a in range(2 if t else 8)]
    df = spark.createDataFrame(rows, "t int, asset int, alpha double, variance double, beta double, sector int, current double")
    got = portfolio.optimized(df, portfolio.Limits(0.8, 0.1, 1.0), ladder=(portfolio.Limits(0.8, 0.2, 1.0),)).collect()
    assert {r.rung for r in got if r.t == 0} == {0} and all(r.w is None and r.rung is None for r in got if r.t == 1)


def test_slices_sum_and_fall_back(spark):
    parents = spark.createDataFrame([(1, 7, 100), (2, 7, 3), (3, 7, 0), (4, 8, 25)], "parent int, security int, quantity long")
    profile = spark.createDataFrame([(7, 0, 5), (7, 1, 1), (8, 0, 0), (8, 1, 0)], "security int, bucket int, volume long")
    for df in (execution.vwap(parents, profile, 5), execution.twap(parents, 2, 5)):
        assert {r.parent: r.s for r in df.groupBy("parent").agg(F.sum("shares").alias("s")).collect()} == {1: 100, 2: 3, 3: 0, 4: 25}
    assert sorted(r.shares for r in execution.vwap(parents.where("parent = 4"), profile, 5).collect()) == [12, 13]
    with pytest.raises(PySparkException, match="without weights"):
        execution.vwap(parents.withColumn("security", F.lit(9)), profile).collect()


def test_order_logs(spark):
    o = spark.createDataFrame([("k", 1), ("k", 1), ("l", 2)], "idempotency_key string, x int")
    none = o.where("false")
    assert execution.record_orders(o, none).count() == 2 and execution.record_orders(o, o.where("x = 2")).count() == 1
    for batch, store in ((o.unionAll(spark.createDataFrame([("k", 3)], o.schema)), none), (o, spark.createDataFrame([("l", 9)], o.schema))):
        with pytest.raises(PySparkException):
            execution.record_orders(batch, store).collect()
    log = spark.createDataFrame([("o", 1, "filled"), ("p", 1, "draft")], "order_id string, sequence int, to_state string")
    event = lambda *rows: spark.createDataFrame(list(rows), "order_id string, event string")
    assert execution.appended_transitions(log, event(("p", "release"))).first()["to_state"] == "pending_new"
    for bad in ([("o", "expire")], [("q", "release")], [("p", "release"), ("p", "abandon")]):
        with pytest.raises(PySparkException):
            execution.appended_transitions(log, event(*bad)).collect()
    fills = spark.createDataFrame([("p", 1, 3), ("p", 2, 4)], "order_id string, sequence int, quantity int")
    ordered = lambda n: spark.createDataFrame([("p", n)], "order_id string, ordered int")
    assert [r.event for r in execution.fill_events(fills, ordered(7)).orderBy("sequence").collect()] == ["partial_fill", "fill_complete"]
    with pytest.raises(PySparkException, match="overfill"):
        execution.fill_events(fills, ordered(6)).collect()


def test_matches_and_settlements(spark):
    rows = spark.createDataFrame([("match",), ("quantity",)], "kind string")
    assert execution.require_matched(rows.where("kind = 'match'")).count() == 1
    with pytest.raises(PySparkException):
        execution.require_matched(rows).collect()
    money = "decimal(20,4)"
    reserved = spark.createDataFrame([(1, "p", 1)], "call_id int, provider string, window int").withColumn("amount", F.lit(5).cast(money))
    out = lambda *v: spark.createDataFrame(list(v), "call_id int, a int").select("call_id", F.col("a").cast(money).alias("actual"))
    assert [(float(r.delta), r.kind) for r in execution.settlements(reserved, out((1, 2))).collect()] == [(-3.0, "settled")]
    assert [(float(r.delta), r.kind) for r in execution.settlements(reserved, out((1, None))).collect()] == [(-5.0, "released")]
    for bad in ([(2, 1)], [(1, 6)], [(1, 1), (1, 2)]):
        with pytest.raises(PySparkException):
            execution.settlements(reserved, out(*bad)).collect()
    with pytest.raises(PySparkException, match="capacity"):
        execution.throughput(reserved, spark.createDataFrame([("q", "m", 1)], "provider string, model string, per_window int")).collect()
    assert costs.parameters()["borrow_bps"] == 100.0
