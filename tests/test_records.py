"""Universes, stores, connectors, answers, prompts and ledgers: refusals, restarts and edges."""

import datetime as dt
import tempfile

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import canonical
from tidemark.operators import extraction, monitoring, universe
from tidemark.operators.facts import Refused
from tidemark.sources import connectors, trials

FAILS = (PySparkException, Py4JJavaError)


def test_criteria_digest():
    a = universe.Criteria(("XNYS", "XNAS"), 1.0, 2.0)
    assert a.digest() == universe.Criteria(("XNAS", "XNYS"), 1.0, 2.0).digest() != universe.Criteria(("XNYS",), 1.0, 2.0).digest()
    assert len({universe.Criteria(("X",), 1.0, 2.0, 20, m, b).digest() for m in (None, 1.0) for b in (False, True)}) == 4


def test_build_refuses_days_after_what_is_known(spark):
    listings = spark.createDataFrame([(1, "X", None, None)], "id int, exchange string, first_listed_on date, delisted_on date")
    bars = spark.createDataFrame([(1, dt.date(2024, 1, d), 5.0, 10) for d in range(1, 6)], "id int, date date, close double, volume long")
    criteria, days = universe.Criteria(("X",), 1.0, 1.0, 3), [dt.date(2024, 1, 3), dt.date(2024, 1, 5)]
    told = universe.build(listings, bars, days, criteria, days[-1])
    assert {(r.rebalance_date.day, r.adv) for r in told.collect()} == {(3, 50.0), (5, 50.0)} and universe.members_of(told).count() == 2
    for bad in ([], [days[0], days[0]], [dt.date(2024, 1, 6)]):
        with pytest.raises(Refused):
            universe.build(listings, bars, bad, criteria, days[-1])


def test_connector_goes_on_where_it_got_to(spark):
    folder = tempfile.mkdtemp(prefix="connector-")
    target, runs = f"{folder}/target", f"{folder}/runs"
    calls, broken = [], [True]

    def fetch(spark, at):
        calls.append(at)
        for k in range(0 if at is None else int(at[at.index(":") + 1 : -1]) + 1, 3):
            if k == 2 and broken[0]:
                raise OSError("the source is gone")
            yield spark.createDataFrame([(k, "x"), (k, "x"), (k + 10, "y")], "id int, v string"), {"page": k}

    registry = connectors.Registry()
    mine = registry.register(connectors.Connector("feed", fetch, ("id",)))
    assert registry.get("feed") is mine
    for bad in (lambda: registry.register(mine), lambda: registry.get("none"), lambda: registry.register(connectors.Connector("a b", fetch, ("id",)))):
        with pytest.raises(Refused):
            bad()
    first = connectors.run(spark, mine, target, runs)
    assert (first["status"], first["rows"], first["checkpoint"]) == ("failed", 4, '{"page":1}') and "gone" in first["error"]
    broken[0] = False
    second = connectors.run(spark, mine, target, runs)
    assert (second["status"], second["rows"], calls) == ("succeeded", 2, [None, '{"page":1}'])
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [0, 1, 2, 10, 11, 12]
    third = connectors.run(spark, mine, target, runs)
    assert (third["rows"], third["checkpoint"]) == (0, '{"page":2}') and spark.read.parquet(runs).count() == 3


def test_trials(spark):
    lines = ["# Trials", "| run_id | strategy | started | sharpe | note |", "|---|:--|---|---|---|", trials.row(run_id="a", strategy="s", sharpe=1.5), trials.row(run_id="b", note="x y"), "", "words"]
    read = lambda x: trials.parse(spark.createDataFrame([(v,) for v in x], "line string"))
    assert trials.count(read(lines)) == 2 and {r.run_id: r.sharpe for r in read(lines).collect()} == {"a": 1.5, "b": None}
    for bad in (lines + [lines[3]], lines + ["| a | b |"], lines + ["|  | s | d | 1 | n |"]):
        with pytest.raises(FAILS):
            read(bad).collect()
    for bad in ({"run_id": "a|b"}, {"strategy": "s"}, {"run_id": "a", "other": 1}):
        with pytest.raises(Refused):
            trials.row(**bad)


@pytest.mark.parametrize(
    "answer,status",
    [
        ('{"tone_shift": 0.5, "magnitude_direction": "raised", "magnitude_size": 1, "tone_magnitude_gap": -1, "evidence": [], "confidence": 0}', "ok"),
        ('{"tone_shift": 0.5, "magnitude_direction": "up", "magnitude_size": 1, "tone_magnitude_gap": -1, "evidence": [], "confidence": 0}', "out of range"),
        ('{"tone_shift": "0.5", "magnitude_direction": "raised", "magnitude_size": 1, "tone_magnitude_gap": -1, "evidence": [], "confidence": 0}', "wrong type"),
        ('{"tone_shift": 0.5, "magnitude_direction": "raised", "magnitude_size": 1, "tone_magnitude_gap": -1, "evidence": [1], "confidence": 0}', "wrong type"),
        ('{"tone_shift": 0.5, "magnitude_direction": "raised", "magnitude_size": 1, "tone_magnitude_gap": -1.5, "evidence": [], "confidence": 0}', "out of range"),
        ('{"tone_shift": 0.5, "magnitude_direction": "raised", "magnitude_size": 1, "tone_magnitude_gap": -1, "evidence": ["1","2","3","4","5","6","7","8","9"], "confidence": 0}', "out of range"),
        ('{"tone_shift": 0.5}', "missing value"),
        ("{}", "missing value"),
        ("7", "not an object"),
        ("{broken", "not an object"),
        ("", "not an object"),
        (None, "not an object"),
    ],
)
def test_answers(spark, answer, status):
    told = extraction.parsed(spark.createDataFrame([(1, answer)], "id int, answer string"), extraction.FORMS["guidance"]).first()
    assert told.status == status and (told.value is not None) == (status == "ok")


def test_extraction_asks_only_for_what_is_not_known(spark):
    docs = spark.createDataFrame([(1, "In March 2024 it rose."), (2, None), (3, ""), (4, "plain " * 50)], "doc_id int, text string")
    form = extraction.FORMS["risk_set"]
    said = lambda p: F.lit('{"added": [], "removed": [], "retained_count": 1, "confidence": 1}')
    first = extraction.extracted(docs, "Say: {text}", form, said, most=100)
    assert {r.doc_id for r in first.collect()} == {1, 4} and {r.status for r in first.collect()} == {"ok"} and not any(r.cached for r in first.collect())
    again = extraction.extracted(docs, "Say: {text}", form, lambda p: F.raise_error(F.lit("asked again")), first.select("key", "answer"), most=100)
    assert all(r.cached for r in again.collect())
    with pytest.raises(Refused):
        extraction.extracted(docs, "Say", form, said)


def test_deltas_refuse_another_pair(spark):
    filings = spark.createDataFrame([(1, 7, "10-K", 1, 1), (2, 7, "10-K", 2, 2)], "seq int, cik int, form string, valid_from int, knowledge_time int")
    good = '{"added": [], "removed": [], "retained_count": 1, "confidence": 1}'
    answers = lambda *rows: spark.createDataFrame(list(rows), "seq int, baseline int, answer string")
    form = extraction.FORMS["risk_set"]
    assert {r.seq: r.outcome for r in extraction.deltas(filings, answers((2, 1, good)), form).collect()} == {1: "no comparison", 2: "measured"}
    assert {r.seq: (r.outcome, r.reason) for r in extraction.deltas(filings, answers((2, 1, "{}")), form).collect()}[2] == ("rejected", "missing value")
    with pytest.raises(FAILS):
        extraction.deltas(filings, answers((2, 9, good)), form).collect()


def test_prompts(spark):
    saved = spark.createDataFrame([("p", 1, "a\nb"), ("p", 2, "a\nc"), ("p", 3, "a\nb")], "name string, saved_at int, body string")
    versions = extraction.prompt_versions(saved)
    assert sorted((r.version, r.body) for r in versions.collect()) == [(1, "a\nb"), (2, "a\nc")]
    assert [(r.added, r.removed) for r in extraction.prompt_diffs(versions).collect()] == [(["c"], ["b"])]
    log = lambda *rows: spark.createDataFrame(list(rows), "name string, version int, sequence int")
    assert extraction.active_prompts(versions, log(("p", 2, 1), ("p", 1, 2))).first()["version"] == 1
    with pytest.raises(FAILS):
        extraction.active_prompts(versions, log(("p", 9, 1))).collect()


def test_monitoring_records(spark):
    t = lambda n: dt.datetime(2024, 1, n)
    raised = spark.createDataFrame([("d", "W", "x", t(2)), ("d", "C", "y", t(1)), ("e", "W", "z", t(1))], "dedup string, severity string, detail string, raised_at timestamp")
    store = spark.createDataFrame([("e", None), ("d", t(1))], "dedup string, acknowledged_at timestamp")
    assert [tuple(r)[:3] for r in monitoring.recorded_alerts(raised, store).collect()] == [("d", "C", "y")]
    log = spark.createDataFrame([(1, t(1))], "alert_id int, raised_at timestamp")
    none = spark.createDataFrame([], "alert_id int, at timestamp, ok boolean")
    assert monitoring.alert_states(log, none, none.drop("ok")).first()["state"] == "new"
    with pytest.raises(FAILS):
        monitoring.alert_states(log, spark.createDataFrame([(2, t(1), True)], none.schema), none.drop("ok")).collect()
    paths = spark.createDataFrame([(p, k, 0.1) for p in range(3) for k in range(10)], "path int, t int, r double")
    assert monitoring.enough_windows(paths, 5, 0.2).count() == 30
    with pytest.raises(FAILS):
        monitoring.enough_windows(paths, 5, 0.05).collect()
    days = spark.createDataFrame([(dt.date(2024, 1, a), dt.date(2024, 1, b)) for a in range(1, 15) for b in range(1, 20)], "a date, b date")
    for r in days.select("a", "b", monitoring.weekdays(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == sum((r.a + dt.timedelta(days=k)).weekday() < 5 for k in range((r.b - r.a).days + 1))


def test_units_refuse_what_is_no_number(spark):
    one = lambda x: spark.createDataFrame([(x,)], "x double")
    assert one(None).select(canonical.bps(F.col("x")).alias("y")).first()["y"] is None
    for bad in (float("nan"), float("inf")):
        with pytest.raises(FAILS):
            one(bad).select(canonical.bps(F.col("x"))).collect()
    with pytest.raises(FAILS):
        one(1.0).select(canonical.bps_of_usd(F.col("x"), F.lit(0.0))).collect()
    assert one(0.0).select(canonical.bps_of_usd(F.col("x"), F.lit(0.0)).alias("y")).first()["y"] == 0.0
