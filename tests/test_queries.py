"""Every query of the library against its SQL in DuckDB, on the tables of the driver's own comparison; the smallest ones are too short for the quantiles of `psi`, which refuses them."""

import math

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "").replace("+00:00", "")
    try:
        return repr(round(float(v), 9) + 0.0)
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    told = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in told.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() >= 0
