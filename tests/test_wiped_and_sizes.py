"""Books that are wiped out and told to the end as SQL tells them."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import backtests, costs, draws, execution, ledger
from tidemark.plans import tables

#: Strategy 0 loses more than all in its third period, strategy 1 never does.
ROWS = [(s, t, a, 1.5, (-0.8 if s == 0 and t == 2 else 0.01 * (1 + (t * 7 + a + s) % 5))) for s in range(2) for t in range(12) for a in range(2)]
BOOKS = "strategy int, t int, asset int, w double, r double"


def test_a_book_that_is_wiped_out_is_told_to_its_end(spark):
    targets = spark.createDataFrame(ROWS, BOOKS)
    with pytest.raises(PySparkException, match="wiped out"):
        costs.backtest(targets).collect()
    net = costs.backtest(targets, wiped="keep")
    got = {(r.strategy, r.t): r for r in net.collect()}
    assert len(got) == 24 and got[0, 2].net < -1
    assert all(math.isnan(got[0, t].equity) for t in range(2, 12)) and got[0, 1].equity > 1 and got[1, 11].equity > 1
    rows = pd.DataFrame([(r.strategy, r.t, r.net) for r in got.values()], columns=["strategy", "t", "net"])
    want = duckdb.sql("SELECT strategy, exp(sum(ln(1 + net))) - 1 AS total FROM rows GROUP BY 1 ORDER BY 1").fetchall()
    told = dict(costs.performance(net).select("strategy", "total").collect())
    assert math.isnan(want[0][1]) and math.isnan(told[0]) and told[1] == pytest.approx(want[1][1])
    assert math.isnan(dict(costs.drawdowns(net).collect())[0])
    values = {(r.strategy, r.metric): r.value for r in backtests.summary(net).collect()}
    assert math.isnan(values[0, "total"]) and values[0, "mean"] == pytest.approx(rows[rows.strategy == 0].net.mean())
    with pytest.raises(PySparkException, match="above -1"):
        draws.resampled(net, 3, 20, 7).collect()
    drawn = {(r.strategy, r.metric): r for r in draws.resampled(net, 3, 20, 7, wiped="keep").collect()}
    assert math.isnan(drawn[0, "max_drawdown"].value) and math.isnan(drawn[0, "total"].value) and drawn[0, "hit_rate"].value == pytest.approx(11 / 12)
    assert drawn[1, "total"].value == pytest.approx(told[1])


def test_a_loss_of_exactly_all_is_minus_infinity(spark):
    net = spark.createDataFrame([(0, t, -1.0 if t == 1 else 0.5) for t in range(4)], "strategy int, t int, net double")
    assert dict(costs.performance(net).select("strategy", "total").collect()) == {0: -1.0}
    drawn = {r.metric: r.value for r in draws.paths(net, 1, 2, 7, wiped="keep").where("draw = 0").select(F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in draws.METRICS]), F.array(*draws.METRICS))).alias("metric", "value")).collect()}
    assert drawn["max_drawdown"] == 1.0 and drawn["total"] == -1.0


def test_drift_of_a_book_that_is_wiped_out(spark):
    rows = spark.createDataFrame([(0, "x", 2.0, -0.75), (0, "y", 0.5, 0.1), (1, "x", 2.0, -0.5)], "t int, asset string, w double, r double")
    got = {(r.t, r.asset): r.drifted for r in costs.drifted(rows, wiped="keep").collect()}
    assert got[0, "x"] == pytest.approx(0.5 / -0.45) and got[0, "y"] == pytest.approx(0.55 / -0.45) and got[1, "x"] == math.inf


def test_decisions_go_on_after_a_book_is_wiped_out(spark):
    returns = spark.createDataFrame([(s, t, a, r) for s, t, a, w, r in ROWS], "strategy int, t int, asset int, r double")
    decide = lambda strategy, t, seen, held: {0: 1.5, 1: 1.5}
    with pytest.raises(PySparkException):
        backtests.run(returns, decide).collect()
    got = {(r.strategy, r.t): r for r in backtests.run(returns, decide, wiped="keep").collect()}
    want = {(r.strategy, r.t): r for r in costs.backtest(spark.createDataFrame(ROWS, BOOKS), wiped="keep").collect()}
    assert len(got) == 24 and all(got[k].net == pytest.approx(want[k].net) and got[k].equity == pytest.approx(want[k].equity, nan_ok=True) for k in want)


def test_slices_move_no_parents(spark):
    """Slices are told within a parent's row: neither its parents nor their slices are shuffled or sorted."""
    parents = spark.createDataFrame([(1, 25), (2, 7), (3, 100)], "parent long, quantity long")
    curve = spark.createDataFrame([(2, 3), (0, 2), (1, 1)], "idx int, weight long")
    told = ledger.apportion(parents, curve, 1)
    assert sorted(map(tuple, told.collect())) == [(1, 0, 8), (1, 1, 5), (1, 2, 12), (2, 0, 2), (2, 1, 2), (2, 2, 3), (3, 0, 33), (3, 1, 17), (3, 2, 50)]
    for df in (told, execution.twap(parents, 3, 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning" not in plan


def test_tasks_of_bars_grow_in_number(spark, monkeypatch):
    """Rows of a task stay the same as the table grows, and bars and all that goes by security need one shuffle."""
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    monkeypatch.setattr(tables, "WORTH", 10)
    assert [tables.spread(spark.range(n), "id").rdd.getNumPartitions() for n in (5, 35, 350, 3000)] == [1, 4, 4, 30]
    plan = tables.bars(spark, "/root/testdata/sf0.001").groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1
