"""Residual fits and labels as streams of bars: the same at every length of a batch, without frames and without a join."""

import numpy as np
import pytest

from tidemark.operators import labels


def paths(spark, sizes=(40, 3, 90, 7, 25)):
    rng = np.random.default_rng(8)
    rows = [(k or None, 2 * i, None if (k, i) == (2, 30) else float(rng.normal(0, 0.02)), float(rng.normal(0, 0.01)), float(rng.normal(0, 0.01))) for k, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "id long, i int, r double, m double, s double").repartition(3)


def test_fits_gather_no_frames(spark):
    for told in (labels.residual_fit(paths(spark), 6), labels.residual_labels(paths(spark), 6, 4)):
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "Join" not in plan and plan.count("hashpartitioning(id") == 1


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_streams_cut_anywhere_tell_the_same(spark, batch):
    """Batches of any length, with ids that end in them, ids shorter than a window, one that is null and a hole."""
    x = paths(spark).toPandas().sort_values(["id", "i"], na_position="first")
    x["n"] = x.groupby("id", dropna=False).cumcount() + 1
    want = {}
    for key, one in x.groupby("id", dropna=False):
        for e in range(5, len(one)):
            part = one.iloc[e - 5 : e + 1]
            if part["r"].notna().all():
                w, left, *_ = np.linalg.lstsq(np.column_stack([np.ones(6), part["m"], part["s"]]), part["r"], rcond=None)
                want[None if np.isnan(key) else int(key), int(one["i"].iloc[e])] = (*w, np.sqrt(left[0] / 3))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        fits = labels.residual_fit(paths(spark), 6)
        got = {(r.id, r.i): (r.alpha, r.market, r.sector, r.sigma) for r in fits.collect()}
        told = {(r.id, r.i): (r.outcome, r.i_end) for r in labels.residual_labels(paths(spark), 6, 4, 0.6).where("id IS NOT NULL").collect()}
        # Places here are even numbers, and an end is the place of the event and the bars after it.
        parted = {(r.id, r.i): (r.outcome, r.i_end) for r in labels.residual_barrier(paths(spark), fits, 4, 0.6).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-7, abs=1e-10) for k in want)
    assert told == parted and len(told) > 80


def test_little_is_held(monkeypatch):
    """What is kept between batches are the bars that windows and paths need."""
    import pyarrow as pa

    monkeypatch.setattr(labels, "LEAST_ROWS", 20)
    seen, n = [], np.arange(1, 1001)
    batches = (pa.RecordBatch.from_pydict({"_id": np.zeros(10, int), "_none": np.zeros(10, bool), "_i": n[k : k + 10], "_n": n[k : k + 10]}) for k in range(0, 1000, 10))
    for _ in labels.in_order(batches, "", 5, 3, lambda at, m, data: seen.append((m[at].tolist(), len(m)))):
        pass
    assert [x for part, _ in seen for x in part] == n.tolist() and max(size for _, size in seen) <= 40
