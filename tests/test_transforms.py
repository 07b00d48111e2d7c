"""Order statistics in two levels, and the fused transform against its steps."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import transforms as t


def test_shelves_never_fall(spark):
    x = sorted([0.0, -0.0, 1e-300, -1e-300, 5e-324, 1e300, -1e300, 1.0, 1.0000001, 0.9999999, -1.0, *np.random.default_rng(1).normal(0, 100, 300).tolist()])
    got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", t.shelf(F.col("x")).alias("s")).orderBy("i").collect()]
    assert got == sorted(got) and len(set(got)) > 100


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    sections = {0: rng.normal(size=501), 1: np.full(40, 7.0), 2: np.array([3.0]), 3: np.repeat(rng.normal(size=9), 11), 4: np.exp(rng.normal(0, 9, 200)) * rng.choice([-1, 1], 200)}
    df = spark.createDataFrame(pd.DataFrame([(k, v) for k, s in sections.items() for v in s], columns=["date", "x"]))
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.date: r for r in t.quantiles(df, ("date",), at).collect()}
    for k, s in sections.items():
        assert got[k].n == len(s) and np.allclose(got[k].q, np.quantile(s, at), rtol=1e-12, atol=0)
    assert t.quantiles(df.where("false"), ("date",), at).count() == 0


def test_fused_transform_equals_its_steps(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(6):
        for i in range((60, 2, 1, 25, 40, 3)[d]):
            x = None if rng.random() < 0.1 else 5.0 if d == 3 else float(rng.normal(0, 3))
            rows.append((d, int(rng.integers(0, 5)) if rng.random() > 0.05 else None, i, x, None if rng.random() < 0.15 else 1.0 if d == 4 else float(rng.normal(1, 0.3))))
    df = spark.createDataFrame(rows, "date int, grp int, id int, x double, beta double")
    for beta in (None, "beta"):
        want = t.neutralize(t.zscore(t.winsorize(df)), "grp")
        want = t.beta_neutralize(want, beta) if beta else want
        a, b = ({(r.date, r.id): r.x for r in f.collect()} for f in (t.transform(df, "grp", beta), want))
        assert a.keys() == b.keys() and any(v is not None for v in a.values())
        for k in a:
            assert (a[k] is None) == (b[k] is None), (k, a[k], b[k])
            assert a[k] is None or math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-9)
    assert t.transform(df, "grp", "beta").columns == df.columns


def test_sections_without_values(spark):
    df = spark.createDataFrame([(0, 0, 0, None), (1, 0, 1, 2.0)], "date int, grp int, id int, x double")
    assert {r.id: r.x for r in t.winsorize(df).collect()} == {0: None, 1: 2.0}
    assert {r.id: r.x for r in t.transform(df).collect()} == {0: None, 1: None}
    with pytest.raises(t.Refused):
        t.winsorize(df, 0.5, 0.5)
