"""Folders of filings and vintages as batches and as streams that stop in the middle."""

import json
import os

import pytest

from tidemark.sources import flow

HEAD = "<ACCEPTANCE-DATETIME>20240{m}15120000\n<TYPE>{form}\n<FILING-DATE>20240{m}15\n<PERIOD>2023\n<DOCUMENT>\n<TYPE>{form}\n<SEQUENCE>1\n<FILENAME>a.htm\n</DOCUMENT>"


def write_days(folder, days):
    """A day's index of three filings, one of them twice; the second has no header."""
    for d in days:
        day, name = f"202401{d:02d}", [f"{d:010d}-24-00000{k}" for k in range(3)]
        os.makedirs(f"{folder}/index/day={day}")
        os.makedirs(f"{folder}/headers/day={day}")
        forms = ["10-K", "8-K", "10-K"]
        lines = ["CIK|Company Name|Form Type|Date Filed|File Name", *(f"{k + 1}|Company {k}|{forms[k]}|{day}|edgar/data/{name[k]}.txt" for k in (0, 1, 2, 2))]
        open(f"{folder}/index/day={day}/master.idx", "w").write("\n".join(lines))
        open(f"{folder}/headers/day={day}/h.json", "w").write("\n".join(json.dumps({"accession": name[k], "body": HEAD.format(m=1, form=forms[k])}) for k in (0, 2)))


def told(df):
    return sorted((r.accession, r.form, str(r.accepted), r.documents, r.error) for r in df.collect())


def test_a_stream_tells_what_a_batch_tells(spark, tmp_path):
    folder, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    write_days(folder, range(1, 13))
    query = flow.filing_stream(spark, folder, out, check)
    query.awaitTermination(120)
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(sizes) == 3 and sizes[0] == sizes[1] and 5 * sizes[2] == 2 * sizes[0]  # five days, five, two
    want = told(flow.filing_table(spark, folder))
    assert told(spark.read.parquet(out)) == want and len(want) == 36
    assert sum(r[4] == "no header" for r in want) == 12 and sum(r[2] == "2024-01-15 17:00:00" for r in want) == 24


def test_it_goes_on_after_a_stop(spark, tmp_path, monkeypatch):
    folder, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    write_days(folder, range(1, 13))
    real, calls = flow.append_new, []

    def stops(batch, target, key):
        calls.append(1)
        if len(calls) == 2:
            real(batch.where("cik = 1"), target, key)  # part of a batch is stored, and then the run ends
            raise RuntimeError("stop")
        real(batch, target, key)

    monkeypatch.setattr(flow, "append_new", stops)
    with pytest.raises(Exception, match="stop"):
        flow.filing_stream(spark, folder, out, check, ("10-K",)).awaitTermination(120)
    assert 0 < spark.read.parquet(out).count() < 24
    write_days(folder, range(13, 15))
    flow.filing_stream(spark, folder, out, check, ("10-K",)).awaitTermination(120)
    flow.filing_stream(spark, folder, out, check, ("10-K",)).awaitTermination(120)
    assert told(spark.read.parquet(out)) == told(flow.filing_table(spark, folder, ("10-K",))) and spark.read.parquet(out).count() == 28


def test_pages_of_series(spark, tmp_path):
    folder = f"{tmp_path}/in"

    def page(series, name, offset, values, count=4):
        os.makedirs(f"{folder}/pages/series_id={series}", exist_ok=True)
        rows = [{"date": f"2024-0{offset + k + 1}-01", "realtime_start": "2024-06-01", "realtime_end": "9999-12-31", "value": v} for k, v in enumerate(values)]
        open(f"{folder}/pages/series_id={series}/{name}.json", "w").write(json.dumps({"count": count, "offset": offset, "limit": 2, "observations": rows}, indent=1))

    page("GDP", "a", 0, ["1.5", "."])
    page("GDP", "b", 2, ["2", "3"])
    page("CPI", "a", 0, ["7", "8"])
    assert [tuple(r) for r in flow.page_gaps(flow.read_series(spark, folder)).collect()] == [("CPI", 4, 2)]
    run = lambda: flow.observation_stream(spark, folder, f"{tmp_path}/out", f"{tmp_path}/check", 1).awaitTermination(120)
    run()
    page("CPI", "b", 2, ["9", "."])
    page("CPI", "again", 0, ["7", "8"])
    run()
    got = sorted((r.series_id, str(r.observation_date), None if r.value is None else float(r.value)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("CPI", "2024-01-01", 7), ("CPI", "2024-02-01", 8), ("CPI", "2024-03-01", 9), ("CPI", "2024-04-01", None), ("GDP", "2024-01-01", 1.5), ("GDP", "2024-02-01", None), ("GDP", "2024-03-01", 2), ("GDP", "2024-04-01", 3)]
    assert flow.page_gaps(flow.read_series(spark, folder)).isEmpty()
