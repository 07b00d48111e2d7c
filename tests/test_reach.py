"""Ranges and last rungs against all vertices and their proofs; shrinkage against the matrices."""

import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import costs, portfolio, reach, risk
from tidemark.operators.facts import Refused


def corners(n, net, cap, gross):
    """All books of a net weight in which all but two weights are 0 or at their cap, a superset of the vertices."""
    for i, j in itertools.combinations(range(n), 2):
        rest = [k for k in range(n) if k not in (i, j)]
        for ws in itertools.product((-cap, 0.0, cap), repeat=n - 2):
            left, used = net - sum(ws), sum(map(abs, ws))
            for wi in (-cap, 0.0, cap, left, (left + gross - used) / 2, (left - gross + used) / 2):
                w = np.zeros(n)
                w[rest], w[i], w[j] = ws, wi, left - wi
                if np.abs(w).max() <= cap + 1e-9 and np.abs(w).sum() <= gross + 1e-9:
                    yield w


@pytest.mark.parametrize("net,cap,gross", [(0.0, 0.3, 1.0), (0.5, 0.3, 1.0), (1.0, 0.3, 1.0), (-0.4, 0.25, 0.9), (0.2, 0.1, 5.0), (0.65, 0.2, 1.1)])
def test_range_equals_all_vertices(spark, net, cap, gross):
    rng = np.random.default_rng(6)
    betas = {t: rng.choice([rng.uniform(-1, 2), 0.5, 1.5], 6) + rng.integers(0, 2, 6) for t in range(3)}
    df = spark.createDataFrame([(t, a, float(b)) for t, v in betas.items() for a, b in enumerate(v)] + [(9, 0, 1.0)], "t int, asset int, beta double")
    for r in reach.exposure_range(df, net, cap, gross).collect():
        if r.t == 9:
            assert (r.low is None) == (abs(net) > cap)
            continue
        values = [float(w @ betas[r.t]) for w in corners(6, net, cap, gross)]
        want = (min(values), max(values))
        assert (r.low, r.high) == pytest.approx(want, abs=1e-9) and (r.low_bound, r.high_bound) == pytest.approx(want, abs=1e-9)
        assert reach.range_of(betas[r.t], net, cap, gross) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("seed", range(25))
def test_most_net_is_feasible_and_proved(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 40))
    sectors, betas = rng.integers(0, 4, n), rng.uniform(-0.5, 2, n).round(1)
    targets = tuple((s, float(rng.uniform(0, 0.4))) for s in range(4)) if seed % 3 else ()
    limits = portfolio.Limits(1.0, 0.1, 1.2, [None, 0.0, 0.05, 0.2][seed % 4], [None, 0.0, 0.1][seed % 3], targets=targets, beta_target=float(seed % 2))
    net, w, bound = reach.most_net(sectors, betas, limits)
    assert net == pytest.approx(bound, abs=1e-8) and w.sum() == pytest.approx(net, abs=1e-8)
    assert np.abs(w).max() <= 0.1 + 1e-8 and np.abs(w).sum() <= 1.2 + 1e-8
    if limits.sector is not None:
        told = dict(targets)
        assert all(abs(w[sectors == s].sum() - told.get(s, 0.0) * net) <= limits.sector + 1e-8 for s in range(4))
    if limits.beta is not None:
        assert abs(w @ betas - limits.beta_target * net) <= limits.beta + 1e-8


def test_most_net_equals_all_vertices():
    """A vertex has as many binding limits as weights; the limits are those of signs and caps, gross, both sectors and beta."""
    sectors, betas = np.array([0, 0, 0, 1, 1, 1]), np.random.default_rng(8).uniform(-1, 2, 6)
    limits = portfolio.Limits(1.0, 0.3, 1.0, 0.35, 0.2)
    extra = [(np.where(sectors == 0, 1.0, 0.0), limits.sector), (np.where(sectors == 1, 1.0, 0.0), limits.sector), (betas, limits.beta)]
    best = 0.0
    for signs in itertools.product((-1.0, 1.0), repeat=6):
        s = np.array(signs)
        rows = [(np.eye(6)[i], v) for i in range(6) for v in (0.0, 0.3 * s[i])] + [(s, 1.0)] + [(e, v) for e, b in extra for v in (b, -b)]
        a, b = np.array([r for r, _ in rows]), np.array([v for _, v in rows])
        for free in range(5):
            for fixed in itertools.combinations(range(6), 6 - free):
                picks = [[2 * i + e for i, e in zip(fixed, ends, strict=True)] + [12 + c for c in chosen] for ends in itertools.product((0, 1), repeat=6 - free) for chosen in itertools.combinations(range(7), free)]
                square, right = a[picks], b[picks]
                whole = np.abs(np.linalg.det(square)) > 1e-9
                w = np.linalg.solve(square[whole], right[whole][..., None])[..., 0]
                good = (w * s >= -1e-9).all(axis=1) & (np.abs(w).max(axis=1) <= 0.3 + 1e-9) & (np.abs(w).sum(axis=1) <= 1 + 1e-9)
                for e, v in extra:
                    good &= np.abs(w @ e) <= v + 1e-9
                best = max([best, *w[good].sum(axis=1)])
    assert 0 < best < 1 and reach.most_net(sectors, betas, limits)[0] == pytest.approx(best, abs=1e-8)


def test_last_rung(spark):
    rows = [(t, a, 0.01 * a, 0.02, 1.0, a % 2, 0.0) for t, n in ((0, 12), (1, 6), (2, 1)) for a in range(n)]
    df = spark.createDataFrame(rows, "t int, asset int, alpha double, variance double, beta double, sector int, current double")
    limits = portfolio.Limits(1.0, 0.1, 1.0, 0.05, 0.1, targets=((0, 0.5), (1, 0.5)), beta_target=1.0)
    got = portfolio.optimized(df, limits, floor=0.3).toPandas()
    nets = got.groupby("t")["w"].sum().to_dict()
    assert nets[0] == pytest.approx(1.0, abs=1e-4) and nets[1] == pytest.approx(0.6, abs=1e-4)
    assert dict(zip(got["t"], got["rung"], strict=True))[1] == 1 and got[got["t"] == 2]["w"].isna().all()
    assert portfolio.optimized(df.where("t = 1"), limits).where("w IS NOT NULL").count() == 0
    with pytest.raises(Refused, match="no net weight"):
        reach.most_net(np.array([0]), np.array([1.0]), portfolio.Limits(0.0))


@pytest.mark.parametrize("t,n,block", [(30, 9, 4), (8, 21, 3), (5, 5, 64), (3, 1, 2)])
def test_shrinkage_equals_the_matrices(spark, t, n, block):
    x = np.random.default_rng(t).normal(size=(t, n)) * 0.02 + 0.01
    df = spark.createDataFrame([(i, a, float(x[i, a])) for i in range(t) for a in range(n)], "t int, asset int, r double")
    want, weight = costs.ledoit_wolf(x)
    weight = weight if n > 1 else 0.0
    got = risk.shrinkage(df, block).first()
    assert got.weight == pytest.approx(weight, abs=1e-9) and got.mu == pytest.approx(np.trace(want) / n) and (got.assets, got.periods) == (n, t)
    pairs = risk.shrunk(df, block).collect()
    assert len(pairs) == n * (n + 1) // 2 and all(r["cov"] == pytest.approx(want[r.a, r.b], abs=1e-12) for r in pairs)
    held = risk.shrunk_factors(x)
    assert np.allclose(held.matrix(), want) and held.trace() == pytest.approx(np.trace(want))
    v, rows = np.arange(n, dtype=float), np.ones((1, n))
    assert np.allclose(held.solver(2.0, 0.3, rows)(v), np.linalg.solve(2 * want + 0.3 * np.eye(n) + rows.T @ rows, v)) and held.of(v) == pytest.approx(v @ want @ v)


def test_panels_that_cannot_be_shrunk_are_refused(spark):
    df = spark.createDataFrame([(t, a, 0.01 * t * (a + 1)) for t in range(4) for a in range(3)], "t int, asset int, r double")
    for bad in (df.where("t < 2"), df.where("NOT (t = 1 AND asset = 1)"), df.unionAll(df.limit(1)), df.where("false"), df.withColumn("r", F.lit(0.1)), df.withColumn("r", F.lit(None).cast("double"))):
        with pytest.raises((PySparkException, Refused)):
            risk.shrinkage(bad).collect()


def test_optimum_by_factors_equals_that_by_the_matrix(spark):
    rng = np.random.default_rng(12)
    for n, t in ((20, 8), (6, 30)):
        x = rng.normal(size=(t, n)) * 0.05
        held = risk.shrunk_factors(x)
        alpha, betas, sectors = rng.normal(size=n) * 0.02, rng.uniform(0.5, 1.5, n), np.arange(n) % 3
        limits = portfolio.Limits(0.0, 0.2, 1.0, 0.1, 0.05)
        one, two = (portfolio.optimum(alpha, c, np.zeros(n), sectors, betas, limits, 5.0) for c in (held, held.matrix()))
        assert np.allclose(one, two, atol=1e-6)
        rows = [(0, a, float(alpha[a]), x[:, a].tolist(), float(betas[a]), int(sectors[a]), 0.0) for a in range(n)]
        df = spark.createDataFrame(rows, "t int, asset int, alpha double, past array<double>, beta double, sector int, current double")
        got = {r.asset: r.w for r in portfolio.optimized(df, limits, 5.0, history="past").collect()}
        assert np.allclose([got[a] for a in range(n)], one, atol=1e-6)
