"""Embargoes, paths, deflated ratios and performances of the caller's own."""

import math
import random
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import splits
from tidemark.operators.facts import Refused


def test_embargo(spark):
    events = spark.createDataFrame([(1, 10, 20), (2, 15, 110)], "id int, start int, end int")
    assert splits.embargo_of(events, fraction=0.05) == 5.0 and splits.embargo_of(events, duration=3) == 3.0
    assert splits.embargo_of(events.where("false"), fraction=0.1) == 0.0
    for bad in ({}, {"duration": 1, "fraction": 0.1}, {"duration": -1}, {"fraction": 1.0}):
        with pytest.raises(Refused):
            splits.embargo_of(events, **bad)


def test_a_split_without_training_rows_is_refused(spark):
    events = spark.createDataFrame([(i, i, 100) for i in range(6)], "id int, start int, end int")
    with pytest.raises(PySparkException, match="without training"):
        splits.purged_kfold(events, 2).collect()


def test_paths_by_brute_force(spark):
    rng = random.Random(2)
    choices = list(combinations(range(4), 2))
    rows = [(s, g, t, rng.gauss(0.1, 1)) for s, c in enumerate(choices) for g in c for t in range(5)]
    got = {r.path: r.sharpe for r in splits.path_sharpes(spark.createDataFrame(rows, "split int, grp int, t int, r double"), splits.cpcv_paths(spark, 4, 2), 12.0).collect()}
    for path in range(3):
        r = [x for g in range(4) for s, h, _, x in rows if h == g and s == [k for k, c in enumerate(choices) if g in c][path]]
        assert got[path] == pytest.approx(np.mean(r) / np.std(r, ddof=1) * math.sqrt(12))
    told = splits.distribution(spark.createDataFrame(list(got.items()), "path int, sharpe double")).first()
    v = np.array(list(got.values()))
    assert (told.n, told.mean, told.median, told.low) == (3, pytest.approx(v.mean()), pytest.approx(np.median(v)), pytest.approx(np.percentile(v, 2.5)))
    with pytest.raises(PySparkException, match="dispersion"):
        splits.path_sharpes(spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 1.0)], "split int, grp int, t int, r double"), splits.cpcv_paths(spark, 4, 2)).collect()


def test_normal_columns(spark):
    z = [-6.0, -2.5, -0.3, 0.0, 0.7, 1.96, 5.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", splits.normal_cdf(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(NormalDist().cdf(r.z), rel=1e-6) for r in got)


def test_deflated_ratio_forms_agree(spark):
    rng = np.random.default_rng(3)
    trials = {k: (rng.normal(0.02 * k, 1, 200)).tolist() for k in range(8)}
    got = {r.trial: r for r in splits.deflated_sharpe_of_trials(spark.createDataFrame([(k, x) for k, v in trials.items() for x in v], "trial int, r double")).collect()}
    ratios = [np.mean(v) / np.std(v, ddof=1) for v in trials.values()]
    for k, v in trials.items():
        want = splits.deflated_sharpe_of_returns(v, 8, float(np.var(ratios, ddof=1)))
        assert got[k].dsr == pytest.approx(want, abs=1e-5) and got[k].benchmark == pytest.approx(splits.expected_max_sharpe(8, float(np.var(ratios, ddof=1))), abs=1e-5)
    with pytest.raises(Refused):
        splits.deflated_sharpe_of_returns([1.0, 1.0, 1.0], 2, 1.0)


def test_own_performance_equals_sharpe(spark):
    rng = np.random.default_rng(4)
    panel = spark.createDataFrame([(t, c, float(rng.normal(0.01 * c, 1))) for t in range(50) for c in range(5)], "t int, config int, r double")
    mine = splits.pbo_splits_by(panel, 4, 50, lambda x: x.mean() / x.std(ddof=1))
    assert sorted((r.split, r.best, r.rank) for r in mine.collect()) == sorted((r.split, r.best, r.rank) for r in splits.pbo_splits(panel, 4, 50).collect())
    with pytest.raises(PySparkException):
        splits.pbo_splits_by(panel, 4, 50, lambda x: float("nan")).collect()
