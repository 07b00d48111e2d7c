import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import costs, factors, labels, ledger, monitoring, splits, text, transforms, universe
from tidemark.operators.facts import FactSpec, Refused
from tidemark.sources import filings, macro, runs


def test_winsorize_equals_numpy(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100):
        x = rng.normal(size=n)
        df = spark.createDataFrame(pd.DataFrame({"date": 0, "id": range(n), "x": x}))
        got = {r.id: r.x for r in transforms.winsorize(df, 0.01, 0.99).collect()}
        low, high = np.percentile(x, 1, method="lower"), np.percentile(x, 99, method="higher")
        assert [got[i] for i in range(n)] == np.clip(x, low, high).tolist()


def test_missing_stays_missing_and_infinity_is_refused(spark):
    df = spark.createDataFrame([(0, 1, 1, 1.0), (0, 2, 1, float("nan")), (0, 3, 1, 3.0), (0, 4, 2, 5.0)], "date int, id int, grp int, x double")
    assert {r.id: r.x for r in transforms.zscore(df).collect()}[2] is None
    assert {r.id: r.x for r in transforms.neutralize(df).collect()} == {1: -1.0, 2: None, 3: 1.0, 4: None}
    with pytest.raises(PySparkException):
        transforms.winsorize(df.withColumn("x", F.lit(float("inf")))).collect()


def test_uniqueness_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(k % 2, k, a := rng.randrange(50), a + rng.randrange(8)) for k in range(40)]
    got = {r.k: r.weight for r in labels.uniqueness(spark.createDataFrame(rows, "id int, k int, first int, last int")).collect()}
    for g, k, a, b in rows:
        cover = [sum(x <= t <= y for h, _, x, y in rows if h == g) for t in range(a, b + 1)]
        assert got[k] == pytest.approx(np.mean([1 / c for c in cover]))


def test_both_barriers_in_one_bar(spark):
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), i, r, h, low) for i, (r, h, low) in enumerate([(0.01, 0.01, 0.0), (-0.01, 0.0, -0.01), (0.012, 0.02, 0.0), (0.0, 0.5, -0.5), (0.0, 0.0, 0.0)])]
    df = spark.createDataFrame(rows, "id int, date date, i int, r double, hi double, lo double")
    assert [r.outcome for r in labels.triple_barrier(df, 2, 1, 1.0, ranges=True).where("i = 2").collect()] == [labels.AMBIGUOUS]
    assert [r.outcome for r in labels.triple_barrier(df, 2, 1, 1.0, "loss", True).where("i = 2").collect()] == [labels.DOWN]
    with pytest.raises(PySparkException):
        labels.class_labels(labels.triple_barrier(df, 2, 1, 1.0, ranges=True)).collect()


def test_purged_kfold_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, s := rng.randrange(30), s + rng.randrange(6)) for i in range(40)]
    got = {(r.id, r.split): r.role for r in splits.purged_kfold(spark.createDataFrame(rows, "id int, start int, end int"), 4, 2).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    for k, fold in enumerate(np.array_split(np.arange(40), 4)):
        test = [order[i] for i in fold]
        a, b = min(r[1] for r in test), max(r[2] for r in test)
        for r in rows:
            role = "test" if r in test else "purged" if r[1] <= b and r[2] >= a else "embargoed" if b < r[1] <= b + 2 else "train"
            assert got[r[0], k] == role


def test_sharpe_statistics():
    assert splits.expected_max_sharpe(1, 1.0) == 0 == splits.expected_max_sharpe(9, 0.0)
    assert splits.probabilistic_sharpe(0.1, 0.1, 100, 0.0, 3.0) == pytest.approx(0.5)
    assert splits.deflated_sharpe(0.1, 100, 0.0, 3.0, 50, 0.01) < splits.probabilistic_sharpe(0.1, 0.0, 100, 0.0, 3.0)
    assert len({(a, b) for a, b in splits.runs((0, 1, 3))}) == 2


def test_backtest_by_hand(spark):
    rows = [("s", 0, "a", 1.0, 0.1), ("s", 1, "a", 1.0, -0.05), ("s", 1, "b", 0.0, None)]
    out = sorted(costs.backtest(spark.createDataFrame(rows, "strategy string, t int, asset string, w double, r double"), 10.0).collect(), key=lambda r: r.t)
    assert out[0].net == pytest.approx((1 - 0.001) * 1.1 - 1) and out[1].turnover == pytest.approx(0.0)
    assert out[1].equity == pytest.approx((1 - 0.001) * 1.1 * 0.95)
    with pytest.raises(PySparkException):
        costs.backtest(spark.createDataFrame([("s", 0, "a", 1.0, None)], "strategy string, t int, asset string, w double, r double")).collect()


def test_portfolio_meets_its_constraints():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 12)) * 0.02
    cov, weight = costs.ledoit_wolf(x)
    assert 0 <= weight <= 1 and np.linalg.eigvalsh(cov).min() > 0
    w = costs.optimize(rng.normal(size=12) * 0.01, cov, np.zeros(12), 5.0, 0.001, 1.0, 0.2, 1.4)
    assert w.sum() == pytest.approx(1, abs=1e-6) and np.abs(w).max() <= 0.2 + 1e-6 and np.abs(w).sum() <= 1.4 + 1e-6
    with pytest.raises(Refused):
        costs.optimize(np.zeros(4), np.eye(4), np.zeros(4), cap=0.1)
    with pytest.raises(Refused):
        costs.parameters(half_spread_bps=1.0)


def test_universe_refusals_and_listing(spark):
    df = spark.createDataFrame([(1, "XNYS", 2.0, None)], "id int, exchange string, price double, adv double")
    assert universe.screen(df, ("XNYS",), 1.0, 1.0).first()["failed_filters"] == ["adv"]
    with pytest.raises(Refused):
        universe.screen(df, ("XNYS",), 1.0, 1.0, min_market_cap=1.0)
    listed = spark.createDataFrame([(1, None, dt.date(2024, 1, 5)), (2, dt.date(2024, 1, 6), None)], "id int, first_listed_on date, delisted_on date")
    assert [r.id for r in listed.where(universe.is_listed_on(F.lit(dt.date(2024, 1, 5)))).collect()] == [1]


def test_factor_refusals(spark):
    bars = spark.createDataFrame([(1, dt.date(2024, 1, 2), 1.0)], "id int, date date, close double")
    found = factors.baseline()
    assert len(found.factors) == 12
    with pytest.raises(Refused):
        found.compute("roic", bars, dt.date(2024, 1, 3))
    with pytest.raises(PySparkException):
        found.compute("momentum_12_1", bars, dt.date(2024, 1, 2)).collect()
    assert found.compute("momentum_12_1", bars, dt.date(2024, 1, 3)).first()["value"] is None


def test_drift(spark):
    rng = np.random.default_rng(4)
    a = spark.createDataFrame(pd.DataFrame({"feature": "f", "x": rng.normal(size=2000)}))
    same, moved = (monitoring.psi(a, spark.createDataFrame(pd.DataFrame({"feature": "f", "x": rng.normal(m, size=2000)})), 10).first() for m in (0, 1))
    assert same.band == "stable" and moved.band == "major"
    with pytest.raises((PySparkException, Py4JJavaError)):
        monitoring.psi(a.limit(50), a, 10).collect()
    assert monitoring.detection_power(0.05, 0.0) == pytest.approx(0.05)
    assert 1 - (1 - monitoring.tail_for(0.1, 10)) ** 10 == pytest.approx(0.1)


def test_silence_is_an_alert(spark):
    none = spark.createDataFrame([], "feature string, psi double, band string"), spark.createDataFrame([], "key long, direction string")
    assert [r.dedup for r in monitoring.alerts(*none).collect()] == ["silence"]


def test_apportion_sums(spark):
    parents = spark.createDataFrame([(1, 7), (2, 100), (3, 3)], "parent int, quantity long")
    out = ledger.apportion(parents, spark.createDataFrame(list(enumerate(ledger.u_curve(3))), "idx int, weight long"), 1).toPandas()
    assert out.groupby("parent").shares.sum().to_dict() == {1: 7, 2: 100, 3: 3} and out.shares.min() >= 1


def test_index_refuses_contradictions(spark):
    line = "7|ACME|8-K|20240311|edgar/data/7/0000000007-24-000001.txt"
    read = lambda *x: filings.parse_index(spark.createDataFrame([(v,) for v in x], "line string"))
    assert filings.distinct_filings(read("CIK|Company Name|Form Type|Date Filed|File Name", line, line)).first()["n_rows"] == 2
    for bad in (line.replace("8-K", "10-K"),):
        with pytest.raises(PySparkException):
            filings.distinct_filings(read(line, bad)).collect()
    for bad in (line.replace("20240311", "20241301"), line.replace("-24-", "/24/")):
        with pytest.raises(PySparkException):
            read(bad).collect()


def test_clock_changes(spark):
    df = spark.createDataFrame([("20240311160502",), ("20240310023000",), ("20241103013000",), ("20241103000000",)], "raw string")
    got = [r.utc for r in df.select(filings.eastern_to_utc(F.col("raw")).alias("utc")).collect()]
    assert got == [dt.datetime(2024, 3, 11, 20, 5, 2), None, None, dt.datetime(2024, 11, 3, 4)]


def test_headers(spark):
    body = "<ACCEPTANCE-DATETIME>20240207160502\n<ACCESSION-NUMBER>{}\n&lt;TYPE&gt;8-K\n<FILING-DATE>20240207\n<PUBLIC-DOCUMENT-COUNT>1\n<DOCUMENT>\n<TYPE>8-K\n<SEQUENCE>1\n<FILENAME>a.htm\n</DOCUMENT>"
    df = spark.createDataFrame([("a", body.format("a")), ("b", body.format("a")), ("c", None)], "accession string, body string")
    got = {r.accession: r for r in filings.parse_headers(df).collect()}
    assert got["a"].error is None and got["a"].documents[0].filename == "a.htm" and got["a"].declared == 1
    assert got["b"].error == "another accession" and got["c"].error == "no ACCEPTANCE-DATETIME"


def test_observations_refuse_what_is_no_number(spark):
    page = lambda v: spark.createDataFrame([("s", [("2024-03-11", "2024-03-11", "9999-12-31", v)])], "series_id string, observations array<struct<date: string, realtime_start: string, realtime_end: string, value: string>>")
    row = macro.observations(page(".")).first()
    assert row.is_missing and row.value is None and row.vintage_end is None and row.knowledge_time == dt.datetime(2024, 3, 12, 4)
    with pytest.raises(PySparkException):
        macro.observations(page("NaN")).collect()
    assert runs.checkpoint_text({"b": 1, "a": None}) == '{"a":null,"b":1}'
    with pytest.raises(Refused):
        runs.checkpoint_text({"a": []})


def test_chunks_tile():
    rng = random.Random(6)
    for _ in range(200):
        t = "".join(rng.choice(["a", "bc ", ". ", "\n\n", "\n \n", "! "]) for _ in range(rng.randrange(60)))
        for most in (1, 5, 20):
            spans = text.chunk(t, most)
            assert "".join(t[a:b] for a, b in spans) == t and all(0 < b - a <= most for a, b in spans)


def test_masking():
    told, n = text.mask("On March 11, 2024 ACME Corp beat Q1 2023; 2000 shares, $2024, acme  corp again.", [*text.entity_rules([("COMPANY", "ACME Corp")]), *text.RULES])
    assert told == "On [DATE_1] [COMPANY_1] beat [PERIOD_1]; 2000 shares, $2024, [COMPANY_1] again." and n == 4
    assert text.cache_key("ab", "c") != text.cache_key("a", "bc")
    assert text.diff("a\nb", "a\nc")[-2:] == ["-b", "+c"]


def test_stream_appends_once(spark, tmp_path):
    from tidemark.operators.facts import FactSpec
    from tidemark.streaming.ingest import ingest

    schema = "id long, valid_from timestamp, knowledge_time timestamp, x double"
    rows = spark.range(20).selectExpr("id", "timestamp'2024-01-01' AS valid_from", "timestamp'2024-01-02' AS knowledge_time", "1.0D AS x")
    for _ in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check"), FactSpec("f", ("id",), ("x",))).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_features_read_what_was_known(spark):
    day, spec = dt.date(2024, 3, 10), FactSpec("price", ("id",), ("close",), ("close",))
    at = lambda d, h=0: dt.datetime(2024, 3, d, h)
    kind = "id long, valid_from timestamp_ntz, valid_to timestamp_ntz, knowledge_time timestamp_ntz, close double, is_retraction boolean"
    rows = [(1, at(d), at(d + 1), at(d + 1), 100.0 + d, False) for d in range(1, 9)] + [(1, at(7), at(8), at(9), 50.0, False), (1, at(8), at(9), at(12), 999.0, False), (2, at(8), at(9), at(9), 5.0, False)]
    prices = spark.createDataFrame(rows, kind)
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    found = factors.baseline()
    got = {r.id: r for r in found.compute_asof("short_term_reversal", prices, spec, ids, day, far=2, days=9).collect()}
    assert got[1].value == pytest.approx(-math.log(108 / 50)) and got[1].as_of == at(10) and got[2].value is None and got[3].value is None and len(got) == 3
    early = found.compute_asof("short_term_reversal", prices, spec, ids, day, dt.datetime(2024, 3, 8, 12, tzinfo=dt.UTC), far=2, days=9).where("id = 1").first()
    assert early.value == pytest.approx(-math.log(107 / 106)) and early.as_of == at(8, 12)
    for requested in (dt.datetime(2024, 3, 10, 1, tzinfo=dt.UTC), dt.datetime(2024, 3, 9), dt.datetime(2024, 3, 9, tzinfo=dt.timezone(dt.timedelta(hours=1)))):
        with pytest.raises(Refused):
            found.compute_asof("short_term_reversal", prices, spec, ids, day, requested)
    with pytest.raises(Refused, match="not an instant"):
        found.compute_asof("short_term_reversal", prices, spec, ids, dt.datetime(2024, 3, 10))
    more = lambda *r: prices.unionAll(spark.createDataFrame(list(r), kind))
    for bad, who in ((prices, ids.unionAll(ids)), (more((1, at(8, 9), at(9), at(9), 1.0, False)), ids), (more((1, at(11), at(12), at(9), 1.0, False)), ids)):
        with pytest.raises(PySparkException):
            found.compute_asof("short_term_reversal", bad, spec, who, day, far=2).collect()
