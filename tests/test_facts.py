import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import facts as B

UTC = dt.UTC
SPEC = B.FactSpec("price", ("id",), ("x",), ("x",))
SCHEMA = "id long, valid_from timestamp_ntz, valid_to timestamp_ntz, knowledge_time timestamp_ntz, x double, is_retraction boolean"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def history(seed, n=300):
    rng, seen, rows = random.Random(seed), set(), []
    for _ in range(n):
        key = rng.randrange(5), rng.randrange(6), rng.randrange(200)
        if key not in seen:
            seen.add(key)
            gone = rng.random() < 0.3
            rows.append((key[0], day(key[1]), day(key[1] + 1), day(key[2] / 4), None if gone else rng.random(), gone))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_visible_equals_a_naive_reading(spark, seed):
    rows = history(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    for at in (0, 7, 20, 60):
        won = {}
        for r in rows:
            if r[3] <= day(at) and (r[:2] not in won or r[3] > won[r[:2]][3]):
                won[r[:2]] = r
        expected = sorted((r[0], r[1], r[4]) for r in won.values() if not r[5])
        got = B.visible(df, SPEC, day(at).replace(tzinfo=UTC), ("x",)).collect()
        assert sorted((r.id, r.valid_from, r.x) for r in got) == expected


def test_later_rows_change_nothing(spark):
    rows = history(9)
    at = day(20).replace(tzinfo=UTC)
    whole = B.visible(spark.createDataFrame(rows, SCHEMA), SPEC, at).collect()
    cut = B.visible(spark.createDataFrame([r for r in rows if r[3] <= day(20)], SCHEMA), SPEC, at).collect()
    assert sorted(whole) == sorted(cut)


def test_instants_are_refused():
    for bad in (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, tzinfo=dt.timezone(dt.timedelta(hours=1))), dt.datetime(2999, 1, 1, tzinfo=UTC)):
        with pytest.raises(B.Refused):
            B.instant(bad)


def test_sql_sees_versions_only(spark):
    df = spark.createDataFrame(history(1), SCHEMA)
    view = B.AsOf(spark, day(20).replace(tzinfo=UTC)).with_facts(df, SPEC)
    assert view.sql("SELECT count(*) AS n FROM price").first()["n"] == view.table("price").count()
    with pytest.raises(B.Refused):
        view.sql("SELECT 1")
    with pytest.raises(B.Refused):
        view.table("raw")
    with pytest.raises(B.Refused):
        view.with_plain("anchor", df)


def open_row(spark, **changes):
    row = {"id": 1, "valid_from": day(0), "valid_to": B.INFINITY.replace(tzinfo=None), "knowledge_time": day(1), "x": 1.0, "is_retraction": False} | changes
    return spark.createDataFrame([tuple(row.values())], SCHEMA)


def at(n):
    return F.lit(str(day(n))).cast("timestamp_ntz")


@pytest.mark.parametrize("changes,end,known", [({"valid_to": day(5)}, 3, 4), ({"is_retraction": True, "x": None}, 3, 4), ({}, 0, 4), ({}, 3, 1), ({}, 3, 10_000_0)])
def test_bad_closings_are_refused(spark, changes, end, known):
    with pytest.raises(PySparkException):
        B.close_interval(open_row(spark, **changes), SPEC, at(end), at(known)).collect()


def test_supersede_and_retract(spark):
    row = open_row(spark)
    out = {r.valid_from: r for r in B.supersede(row, SPEC, at(3), at(4), {"x": F.lit(2.0)}).collect()}
    assert out[day(0)].valid_to == day(3) and out[day(0)].x == 1.0
    assert out[day(3)].valid_to == B.INFINITY.replace(tzinfo=None) and out[day(3)].x == 2.0
    gone = B.retract(row, SPEC, at(4)).first()
    assert gone.is_retraction and gone.x is None
    with pytest.raises(PySparkException):
        B.retract(B.retract(row, SPEC, at(4)), SPEC, at(5)).collect()
