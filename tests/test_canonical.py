from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical
from tidemark.operators import costs, labels
from tidemark.operators.facts import Refused


def test_equal_values_have_equal_texts():
    assert canonical.canonical_decimal(Decimal("1.500")) == canonical.canonical_decimal(Decimal("15e-1")) == "1.5"
    assert canonical.canonical_decimal(Decimal("-0.00")) == "0" and canonical.canonical_decimal(Decimal("1E+3")) == "1000"
    assert canonical.digest({"b": [1, None], "a": Decimal("2.0")}) == canonical.digest({"a": Decimal("2"), "b": (1, None)})
    for bad in ({1: 2}, {"a": {1}}, Decimal("NaN")):
        with pytest.raises(Refused):
            canonical.canonical_json(bad)
    with pytest.raises(ValueError):
        canonical.canonical_json(float("nan"))


def test_row_digest_ignores_the_order_of_names(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    row = df.select(canonical.row_digest(b=F.col("b"), a=F.col("a")).alias("x"), canonical.row_digest(a=F.col("a"), b=F.col("b")).alias("y")).first()
    assert row.x == row.y


def test_residual_barrier_by_hand(spark):
    paths = spark.createDataFrame([(1, i, r, 0.01, 0.0) for i, r in enumerate([0.0, 0.02, 0.05, -0.2, 0.0])], "id int, i int, r double, m double, s double")
    fits = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.02), (1, 2, 0.0, 0.0, 0.02), (1, 4, 0.0, 0.0, 0.02)], "id int, i int, market double, sector double, sigma double")
    got = {r.i: (r.outcome, r.i_end) for r in labels.residual_barrier(paths, fits, 2).collect()}
    assert got == {0: (1, 2), 2: (-1, 3)}


def test_relaxation_takes_the_first_feasible_rung():
    w, rung = costs.relaxed(np.zeros(4), np.eye(4), np.zeros(4), [{"cap": 0.2}, {"cap": 0.3}], cap=0.1)
    assert rung == 2 and w.sum() == pytest.approx(1, abs=1e-6)
