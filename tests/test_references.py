"""Operators without SQL against slow references on small tables, and texts at table level."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import costs, labels, ledger, text
from tidemark.operators.facts import Refused


def paths(n=3, bars=14, seed=1):
    rng = np.random.default_rng(seed)
    return [(k, i, float(rng.normal(0, 0.02)), float(rng.normal(0, 0.01)), float(rng.normal(0, 0.01))) for k in range(n) for i in range(bars)]


def slow_fit(rows, window):
    """Normal equations in exact order, window by window."""
    out = {}
    for k in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == k)
        for e in range(window - 1, len(mine)):
            part = mine[e - window + 1 : e + 1]
            x = np.array([[1.0, m, s] for _, _, _, m, s in part])
            y = np.array([r for _, _, r, _, _ in part])
            w = np.linalg.solve(x.T @ x, x.T @ y)
            out[k, mine[e][1]] = (*w, math.sqrt(((y - x @ w) ** 2).sum() / (window - 3)))
    return out


def test_residual_fit(spark):
    rows = paths()
    df = spark.createDataFrame(rows, "id long, i int, r double, m double, s double")
    got = {(r.id, r.i): (r.alpha, r.market, r.sector, r.sigma) for r in labels.residual_fit(df, 6).collect()}
    want = slow_fit(rows, 6)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-8, abs=1e-10)
    assert labels.residual_fit(df.withColumn("s", F.col("m")), 6).count() == 0 and labels.residual_fit(df.where("false"), 6).count() == 0
    with pytest.raises(Refused):
        labels.residual_fit(df, 4)


def test_residual_barriers(spark):
    rows = paths(2, 20, 2)
    df = spark.createDataFrame(rows, "id long, i int, r double, m double, s double")
    fits = labels.residual_fit(df, 6)
    told = {(r.id, r.i): (r.outcome, r.i_end) for r in labels.residual_barrier(df, fits, 4, 0.6).collect()}
    path = {(k, i): (r, m, s) for k, i, r, m, s in rows}
    want = {}
    for f in fits.collect():
        ahead = [path.get((f.id, f.i + j)) for j in range(1, 5)]
        if None in ahead:
            continue
        width, c, hit = 0.6 * f.sigma * 2.0, 0.0, (labels.NEITHER, f.i + 4)
        for j, (r, m, s) in enumerate(ahead, 1):
            c += r - f.market * m - f.sector * s
            if abs(c) >= width:
                hit = (labels.UP if c > 0 else labels.DOWN, f.i + j)
                break
        want[f.id, f.i] = hit
    assert told == want and {o for o, _ in told.values()} >= {labels.UP, labels.DOWN}


def test_bootstrap(spark):
    rng = np.random.default_rng(3)
    rows = [(s, t, float(rng.normal(0.001, 0.01))) for s in "ab" for t in range(23)]
    got = {r.strategy: r for r in costs.bootstrap(spark.createDataFrame(rows, "strategy string, t int, net double"), 5, 200, 11).collect()}
    for s in "ab":
        x = [v for q, _, v in rows if q == s]
        starts = np.random.Generator(np.random.PCG64(11)).integers(0, 23, size=(200, 5))
        means = sorted(np.mean([x[(int(a) + k) % 23] for a in row for k in range(5)][:23]) for row in starts)
        assert got[s].mean == pytest.approx(np.mean(x)) and (got[s].low, got[s].high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_admission_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(f"p{rng.integers(3)}", int(rng.integers(2)), i, int(rng.integers(1, 50))) for i in range(300)] + [("p0", 0, 300, None)]
    df = spark.createDataFrame(rows, "provider string, window int, seq int, a int").select("provider", "window", "seq", F.col("a").cast("decimal(20,4)").alias("amount"))
    got = {r.seq: r.admitted for r in ledger.admitted(df, F.lit(200)).collect()}
    spent = {}
    for p, w, i, a in rows:
        fits = a is not None and spent.get((p, w), 0) + a <= 200
        spent[p, w] = spent.get((p, w), 0) + (a if fits else 0)
        assert got[i] == fits
    assert ledger.admitted(df.where("false"), F.lit(1)).count() == 0


def test_covariance_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 9))
    df = spark.createDataFrame([(t, a, float(x[t, a])) for t in range(30) for a in range(9)], "t int, asset int, r double")
    want = np.cov(x.T, bias=True)
    for block in (2, 64):
        got = costs.covariance(df, block).collect()
        assert len(got) == 45 and all(r.a <= r.b and r["cov"] == pytest.approx(want[r.a, r.b]) for r in got)
    holes = {(r.a, r.b): r["cov"] for r in costs.covariance(df.where("NOT (t = 3 AND asset = 1)")).collect()}
    assert holes[0, 1] is None and holes[0, 2] == pytest.approx(want[0, 2])


def test_idempotency_keys(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "x", "y")], "a int, b string, c string")
    k = [tuple(r) for r in df.select(ledger.idempotency_key(F.col("a"), F.col("b"), F.col("c")), ledger.idempotency_key(F.col("c"), F.col("a"), F.col("b"))).collect()]
    assert k[0][0] == k[0][1] != k[1][0] == k[1][1]


def test_texts_of_a_table(spark):
    df = spark.createDataFrame([(1, "In March 2024, Jane Doe. " * 40), (2, None), (3, ""), (4, "x" * 5000)], "doc_id long, text string")
    cut = {}
    for r in text.chunks(df, 100).orderBy("doc_id", "chunk").collect():
        assert 0 < len(r.text) <= 100
        cut[r.doc_id] = cut.get(r.doc_id, "") + r.text
    assert cut == {1: "In March 2024, Jane Doe. " * 40, 4: "x" * 5000}
    told = {r.doc_id: (r.text, r.n_masked) for r in text.masked(df, [("PERSON", "Jane Doe")]).collect()}
    assert told == {1: ("In [DATE_1], [PERSON_1]. " * 40, 80), 2: (None, 0), 3: ("", 0), 4: ("x" * 5000, 0)}
