"""Panels move once, however many pairs they have, and are told as by matrices."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from tidemark.operators import costs, risk


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def panel(spark, x, name=int, kind="int"):
    return spark.createDataFrame([(t, name(a), float(x[t, a])) for t in range(x.shape[0]) for a in range(x.shape[1])], f"t int, asset {kind}, r double")


def test_covariances_do_not_copy_the_panel(spark):
    x = np.random.default_rng(6).normal(size=(12, 11))
    want = np.cov(x.T, bias=True)
    for block in (2, 5, None):
        told = costs.covariance(panel(spark, x, lambda a: f"{a:02}", "string"), block)
        # Blocks meet where they lie; before, a row was copied for each block and dealt by pair.
        assert "CartesianProduct" in plan(told) and "Generate" not in plan(told) and plan(told).count("hashpartitioning(p") == 0
        got = {(r.a, r.b): r["cov"] for r in told.collect()}
        assert len(got) == 66 and all(a <= b and v == pytest.approx(want[int(a), int(b)]) for (a, b), v in got.items())


def test_assets_of_the_same_periods_have_a_covariance(spark):
    """Two assets that lack the same period have a number, in whatever block; two that differ have none."""
    x = np.random.default_rng(7).normal(size=(9, 4))
    part = np.cov(np.delete(x, 3, axis=0).T, bias=True)
    for block in (1, 64):
        got = {(r.a, r.b): r["cov"] for r in costs.covariance(panel(spark, x).where("NOT (t = 3 AND asset IN (1, 2))"), block).collect()}
        assert len(got) == 10 and {k for k, v in got.items() if v is None} == {(0, 1), (0, 2), (1, 3), (2, 3)}
        assert got[1, 2] == pytest.approx(part[1, 2]) and got[1, 1] == pytest.approx(part[1, 1])
    lacks = {(r.a, r.b): r["cov"] for r in costs.covariance(panel(spark, x).selectExpr("t", "asset", "CASE WHEN t <> 3 OR asset <> 1 THEN r END AS r")).collect()}
    assert {k for k, v in lacks.items() if v is None} == {(0, 1), (1, 1), (1, 2), (1, 3)}
    with pytest.raises(PySparkException):
        costs.covariance(panel(spark, x).unionAll(panel(spark, x).limit(1)))
    assert costs.covariance(panel(spark, x).where("false")).count() == 0


@pytest.mark.parametrize("t,n", [(7, 40), (40, 7), (9, 9)])
def test_shrinkage_does_not_copy_the_panel(spark, monkeypatch, t, n):
    """Products of periods are sums of each task's assets and those of assets are told by strips, both without a copy of the panel; they agree."""
    x = np.random.default_rng(n).normal(size=(t, n)) * 0.02
    want, weight = costs.ledoit_wolf(x)
    for most in (4096, 2):
        monkeypatch.setattr(risk, "PERIODS", most)
        told = risk.shrinkage(panel(spark, x), 3)
        assert "Generate" not in plan(told) and ("CartesianProduct" in plan(told)) == (t >= n or most == 2)
        got = told.first()
        assert got.weight == pytest.approx(weight, abs=1e-9) and got.mu == pytest.approx(np.trace(want) / n)
    pairs = risk.shrunk(panel(spark, x), 3)
    assert "Generate" not in plan(pairs)
    assert {(r.a, r.b): pytest.approx(r["cov"], abs=1e-12) for r in pairs.collect()} == {(a, b): want[a, b] for a in range(n) for b in range(a, n)}


def test_pairs_are_whole_in_whatever_order_assets_arrive(spark):
    """Each side of the product fetches its strips by itself; before, pairs of a strip were told by place, so some came twice and others never."""
    x = np.random.default_rng(8).normal(size=(6, 30))
    want = np.cov(x.T, bias=True)

    def shuffled(batches):
        for batch in batches:
            yield batch.take(pa.array(np.random.default_rng().permutation(batch.num_rows)))

    told = costs.vectors(panel(spark, x))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        for _ in range(2):
            got = [(r.a, r.b, r["cov"]) for r in costs.covariances(told.coalesce(1).mapInArrow(shuffled, told.schema)).collect()]
            assert sorted(g[:2] for g in got) == [(a, b) for a in range(30) for b in range(a, 30)]
            assert all(v == pytest.approx(want[a, b]) for a, b, v in got)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
