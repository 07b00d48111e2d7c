"""Spreads over test windows beside the benchmark's, breaches of whole books, weights that sum to their labels, and a ledger that only grows."""

import datetime as dt

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from tidemark.operators import backtests, costs, execution, labels
from tidemark.operators.facts import Refused
from tidemark.sources import trials

FAILS = (PySparkException, Py4JJavaError)


def test_spread_of_both_sides(spark):
    rng = np.random.default_rng(21)
    net = {s: rng.normal(0.001 * k, 0.01, 60) for k, s in enumerate("ab")}
    base = rng.normal(0.0005, 0.01, 60)
    base[40:50] = 0.001  # a window without dispersion
    df = spark.createDataFrame([(s, t, float(x)) for s, v in net.items() for t, x in enumerate(v)], "strategy string, t int, net double")
    bench = spark.createDataFrame([(t, float(x)) for t, x in enumerate(base)], "t int, net double")
    windows = costs.walk_forward(60, 20, 10)
    got = {(r.strategy, r.side): r for r in backtests.window_spread(df, bench, windows).collect()}
    ratio = lambda x: x.mean() / x.std(ddof=1) * np.sqrt(252)
    for s, v in net.items():
        own, other = [ratio(v[a:b]) for *_, a, b in windows], [ratio(base[a:b]) for *_, a, b in windows if a != 40]
        for side, x in (("strategy", own), ("benchmark", other)):
            r = got[s, side]
            assert (r.windows, r.positive) == (len(x), sum(v > 0 for v in x))
            assert (r.mean, r.deviation, r.least, r.most) == pytest.approx((np.mean(x), np.std(x, ddof=1), min(x), max(x)))
            assert (r.low, r.median, r.high) == pytest.approx(tuple(np.quantile(x, [0.05, 0.5, 0.95])))
            assert r.ahead == sum(p > q for p, q in zip([ratio(v[a:b]) for *_, a, b in windows if a != 40], other, strict=True))
    for bad in (bench.where("t <> 25"), bench.unionAll(bench.where("t = 3"))):
        with pytest.raises(FAILS):
            backtests.window_spread(df, bad, windows).collect()
    with pytest.raises(Refused):
        backtests.window_spread(df, bench, windows, tail=0.5)
    assert backtests.window_spread(df.where("false"), bench, windows).count() == 0


def test_breaches_of_net_and_beta(spark):
    rows = [(0, "x", 1, 0.6, 1.5), (0, "y", 1, -0.1, 1.0), (1, "x", 1, 0.5, 1.0), (1, "y", 2, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "t int, asset string, sector int, w double, beta double")
    got = {(r.t, r.limit, r.what): r.value for r in costs.constraint_breaches(df, 0.55, 0.9, 0.65, net=1.0, beta=0.1, beta_target=1.0).collect()}
    want = {(0, "position", "x"): 0.6, (0, "net", ""): 0.5, (0, "beta", ""): 0.8, (0, "sector", "1"): 0.7, (1, "gross", ""): 1.0}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {r.limit for r in costs.constraint_breaches(df.drop("beta"), 0.55, 0.9, 0.65).collect()} == {"position", "gross", "sector"}


def test_normalized_weights_sum_to_the_labels(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 0.25), (2, 0.1)], "id int, weight double")
    got = labels.normalized(df).groupBy("id").sum("normalized").collect()
    assert {r[0]: pytest.approx(r[1]) for r in got} == {1: 3.0, 2: 1.0}


def test_a_ledger_only_grows(spark, tmp_path):
    path = tmp_path / "ledger"
    path.mkdir()
    heading = "| run_id | strategy | started | sharpe | note |\n|---|---|---|---|---|\n" + trials.row(run_id="a", strategy="s", sharpe=1.5) + "\n"
    (path / "trials.txt").write_text(heading)
    batch = lambda *rows: spark.createDataFrame(list(rows), "run_id string, strategy string, started string, sharpe double, note string")
    assert trials.append(batch(("b", "s", None, 0.25, " x "), ("c", None, "2024-01-01", None, None)), str(path)) == 3
    got = {r.run_id: (r.strategy, r.started, r.sharpe, r.note) for r in trials.read(spark, str(path)).collect()}
    assert got == {"a": ("s", None, 1.5, None), "b": ("s", None, 0.25, "x"), "c": (None, "2024-01-01", None, None)}
    for bad in ([("a", "s", None, 1.0, None)], [("d", "s", None, 1.0, None)] * 2, [("", "s", None, 1.0, None)], [(None, "s", None, 1.0, None)], [("d", "s|t", None, 1.0, None)], [("d", "s", None, 1.0, "x\ny")]):
        with pytest.raises(FAILS):
            trials.append(batch(*bad), str(path))
    assert trials.count(trials.read(spark, str(path))) == 3 and (path / "trials.txt").read_text() == heading
    assert trials.append(batch(("d", "s", None, 1.0, None)).where("false"), str(path)) == 3
    with pytest.raises(FAILS):
        trials.append(batch(("d", "s", None, 1.0, None)), str(tmp_path / "none"))
    with pytest.raises(Refused):
        trials.append(batch(("d", "s", None, 1.0, None)).drop("note"), str(path))


def test_slices_know_no_later_session(spark):
    day = lambda k: dt.date(2024, 1, k)
    sessions = spark.createDataFrame([(1, day(2), 0, 10), (1, day(2), 1, 30), (1, day(4), 0, 1000), (1, day(4), 1, 0), (1, day(2), 7, 99), (2, day(9), 0, 5), (3, day(1), 1, 4)], "security int, session_date date, bucket int, volume long")
    parents = spark.createDataFrame([(1, 1, day(2), 40), (2, 1, day(3), 40), (3, 1, day(4), 40), (4, 1, day(5), 1040), (5, 2, day(9), 40), (6, 9, day(9), 40), (7, 3, day(2), 40)], "parent int, security int, session_date date, quantity long")
    got = {}
    for r in execution.vwap_asof(parents, sessions, (0, 1), (3, 1), 0).collect():
        got.setdefault(r.parent, {})[r.idx] = r.shares
    assert got == {1: {0: 30, 1: 10}, 2: {0: 10, 1: 30}, 3: {0: 10, 1: 30}, 4: {0: 1010, 1: 30}, 5: {0: 30, 1: 10}, 6: {0: 30, 1: 10}, 7: {0: 0, 1: 40}}
    with pytest.raises(FAILS):
        execution.vwap_asof(parents, sessions, (0, 1)).collect()
    assert execution.vwap_asof(parents.where("parent IN (2, 4)"), sessions, (0, 1)).count() == 4
    for bad in (((), None), ((0, 0), None), ((0, 1), (1,)), ((0, 1), (1, 0))):
        with pytest.raises(Refused):
            execution.vwap_asof(parents, sessions, *bad)
    assert execution.vwap_asof(parents.where("false"), sessions, (0, 1)).count() == 0 and execution.vwap_asof(parents, sessions.where("false"), (0, 1), (1, 1)).count() == 14
