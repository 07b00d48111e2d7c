"""Books whose weights follow from each asset's own past, told without a group a strategy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtests
from tidemark.plans import portfolio_queries

RETURNS = "strategy int, t int, asset int, r double"


def market(spark, share=0.7):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(s, t, a, float(rng.normal(0, 0.05))) for s in range(3) for t in range(0, 40, s + 1) for a in range(9) if rng.random() < share], RETURNS)


def test_a_rule_is_told_as_by_asking_period_by_period(spark):
    """Assets come and go, so some are sold in a period without a return of theirs."""
    returns = market(spark)

    def decide(strategy, t, seen, held):
        past = seen.groupby("asset")["r"].agg(["last", "mean"]) if len(seen) else {}
        return {a: (0.1 if past["last"].get(a, 0.0) > past["mean"].get(a, 0.0) else -0.05) if len(past) else -0.05 for a in present[strategy, t]}

    present = {}
    for x in returns.collect():
        present.setdefault((x.strategy, x.t), []).append(x.asset)
    rule = lambda past: F.when(F.coalesce("r", F.lit(0.0)) > F.coalesce(F.avg("r").over(past), F.lit(0.0)), 0.1).otherwise(-0.05)
    want = {(x.strategy, x.t): x for x in backtests.run(returns, decide).collect()}
    got = {(x.strategy, x.t): x for x in backtests.ruled(returns, rule).collect()}
    assert want.keys() == got.keys() and len({round(x.turnover, 9) for x in want.values()}) > 40
    assert all(tuple(got[k])[2:] == pytest.approx(tuple(want[k])[2:], abs=1e-12) for k in want)


def test_rules_are_refused_as_decisions_are(spark):
    flat = lambda w: lambda past: F.lit(w)
    book = lambda *rows: spark.createDataFrame(rows, RETURNS)
    for returns, w in ((book((0, 0, 0, None)), 1.0), (book((0, 0, 0, math.nan)), 1.0), (book((0, 0, 0, 0.1)), math.nan), (book((0, 0, 0, 0.1)), None), (book((0, 0, 0, 0.1)), 11.0), (book((0, 0, 0, -1.0)), 1.0), (book((0, 0, 0, 0.1), (0, 0, 0, 0.2)), 1.0), (book((0, 0, None, 0.1)), 1.0)):
        with pytest.raises(Exception, match="a weight that is no number|above the cap|wiped out|two returns|of no strategy"):
            backtests.ruled(returns, flat(w)).collect()
    assert backtests.ruled(book((0, 0, 0, None)), flat(0.0)).first().net == 0.0
    lost = [x.equity for x in backtests.ruled(book((0, 0, 0, 0.1), (0, 1, 0, -2.0), (0, 2, 0, 0.1)), flat(1.0), wiped="keep").orderBy("t").collect()]
    assert lost[0] > 1 and math.isnan(lost[1]) and math.isnan(lost[2])


def test_no_strategy_of_the_query_is_a_group(spark):
    """Before, all assets and periods of a strategy were one group of pandas."""
    plan = portfolio_queries.backtest_run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Python" not in plan and "BroadcastHashJoin" in plan
