"""Interval joins against nested loops, with hot keys and bins, and their plans."""

import datetime as dt
import random

import pytest

from tidemark.operators import intervals as I
from tidemark.operators.facts import FactSpec, Refused
from tidemark.plans import asof_queries

SF = "/root/testdata/sf0.001"


def cases(rng, n, m, keys, span, wide):
    """Points and intervals with nulls, repeats, empty and open intervals; a third of all is of one key."""
    pick = lambda: rng.choice([0, *range(keys)]) if rng.random() > 0.3 else 0
    points = [(pick() if rng.random() > 0.03 else None, rng.randrange(-span, span) if rng.random() > 0.03 else None, i) for i in range(n)]
    spans = []
    for j in range(m):
        a = rng.randrange(-span - 5, span + 5)
        b = a + rng.choice([0, -3, 1, 2, wide, 10**15])
        spans.append((pick() if rng.random() > 0.03 else None, a if rng.random() > 0.03 else None, b if rng.random() > 0.03 else None, j))
    return points + points[:5], spans + spans[:5]


def slow(points, spans, how):
    out = []
    for k, t, i in points:
        met = [(i, j) for q, a, b, j in spans if None not in (k, t, q, a, b) and q == k and a <= t < b]
        out += met or ([(i, None)] if how == "left" else [])
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize(("per_bin", "hot"), [(256, 100_000), (1, 100_000), (3, 4), (10_000, 7)])
def test_join_by_nested_loops(spark, monkeypatch, how, per_bin, hot):
    monkeypatch.setattr(I, "PER_BIN", per_bin)
    monkeypatch.setattr(I, "HOT", hot)
    rng = random.Random(per_bin + hot)
    for span in (1, 40, 10**9):
        points, spans = cases(rng, 150, 40, 3, span, 7)
        p, s = spark.createDataFrame(points, "k int, t long, i int"), spark.createDataFrame(spans, "k int, a long, b long, j int")
        got = I.interval_join(p, s, ("k",), "t", "a", "b", how).select("i", "j").collect()
        assert sorted(map(tuple, got), key=repr) == slow(points, spans, how)


def test_without_rows_and_without_a_key(spark):
    p, s = spark.createDataFrame([(dt.date(2024, 1, 2), 1)], "t date, i int"), spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 3), 7), (dt.date(1, 1, 1), dt.date(9999, 12, 31), 8)], "a date, b date, j int")
    assert sorted(r.j for r in I.interval_join(p, s, (), "t", "a", "b").collect()) == [7, 8]
    assert I.interval_join(p.where("false"), s, (), "t", "a", "b").count() == 0
    assert [r.j for r in I.interval_join(p, s.where("false"), (), "t", "a", "b", "left").collect()] == [None]
    with pytest.raises(Refused, match="both sides"):
        I.interval_join(p, s.withColumnRenamed("j", "i"), (), "t", "a", "b")
    with pytest.raises(Refused, match="no instant"):
        I.interval_join(p.selectExpr("CAST(t AS string) t"), s.selectExpr("CAST(a AS string) a", "CAST(b AS string) b"), (), "t", "a", "b")


def test_versions_by_brute_force(spark):
    rng, day = random.Random(4), lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    facts = [(rng.randrange(3), day(v := rng.randrange(20)), day(v + rng.choice([5, 10, 10**5])), day(rng.randrange(40)), i, float(i), rng.random() < 0.2) for i in range(200)]
    points = [(rng.randrange(3), day(rng.randrange(-2, 40)), day(rng.randrange(-2, 45)), i) for i in range(150)]
    want = []
    for k, at, known, i in points:
        best = {}
        for f in sorted(facts, key=lambda f: (f[3], f[4])):
            if f[0] == k and f[3] <= known:
                best[f[1]] = f
        want += [(i, f[4]) for f in best.values() if not f[6] and f[1] <= at < f[2]]
    fs = spark.createDataFrame(facts, "id int, valid_from timestamp_ntz, valid_to timestamp_ntz, knowledge_time timestamp_ntz, seq int, x double, is_retraction boolean")
    ps = spark.createDataFrame(points, "id int, at timestamp_ntz, known timestamp_ntz, i int")
    got = I.versions_at(ps, fs, FactSpec("f", ("id",), ("x",), (), ("seq",)), columns=("seq",))
    assert sorted((r.i, r.seq) for r in got.collect()) == sorted(want) and len(want) > 50


@pytest.mark.parametrize("name", ["event_versions", "lines_in_transit"])
def test_no_nested_loops(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = asof_queries.BOOK.queries[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan
