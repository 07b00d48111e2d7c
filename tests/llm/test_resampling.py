"""Importance resampling against a plain sort, and the radix sort by itself."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import resampling
from tidemark.llm.resampling import ordered, resample

SCHEMA = "doc_id long, text string, score string, place int, block string"


def plain(docs, target, runs=1, buckets=10_000, seed=2024, least=20, percent=10):
    def told(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        return len(words), [zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in range(1, runs + 1) for i in range(len(words) - n + 1)]

    s, t = (Counter(b for text in side for b in told(text)[1]) for side in ([x for _, x in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        n, at = told(text)
        weight = sum(gain[b] for b in at) // len(at) if at else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(at), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    drawn = [(*r[:1], *r[2:], k + 1 if k < percent * len(order) // 100 else None) for k, r in enumerate(order)]
    return sorted((*drawn, *[(r[0], *r[2:], None) for r in rows if r[1] < least]), key=repr)


def made(spark, docs, target, **kw):
    # Columns of the operator's own names are no matter.
    df = spark.createDataFrame([(i, x, "mine", 7, "mine") for i, x in docs], SCHEMA)
    out = resample(df, spark.createDataFrame([(x,) for x in target], "text string"), **kw)
    return sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def texts(n):
    return [" ".join(f"w{(i * j * j + j) % (7 + i % 90)}" for j in range(i % 70)) for i in range(n)]


@pytest.mark.parametrize(("runs", "buckets", "percent"), [(1, 10_000, 10), (2, 50, 100), (3, 1, 37)])
def test_resampling_by_a_plain_sort(spark, runs, buckets, percent):
    docs = list(enumerate(texts(400)))
    target = ["w1 w2 w3 w4 W5", None, "", "w3 w3 w3"]
    assert made(spark, docs, target, runs=runs, buckets=buckets, percent=percent) == plain(docs, target, runs, buckets, percent=percent)


def test_nulls_ties_repeats_and_long_texts(spark):
    long = "Über café " * 50_000
    docs = [(None, None), (None, texts(60)[50]), (3, ""), (4, " \n"), (5, long), (5, long), (5, texts(60)[59]), (-9, texts(60)[45]), (2**62, texts(60)[44]), (-(2**63), texts(60)[43])]
    assert made(spark, docs, ["w1"], percent=100) == plain(docs, ["w1"], percent=100)
    assert made(spark, docs, [], percent=100) == plain(docs, [], percent=100)
    assert made(spark, [], ["a b"]) == [] and made(spark, [], []) == []


def test_every_row_ties(spark):
    docs = [(1, texts(60)[40])] * 300
    assert made(spark, docs, ["w1"]) == plain(docs, ["w1"])


def test_radix_sort_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 64)
    monkeypatch.setattr(resampling, "COUNTS", 1 << 9)
    rows = spark.range(5000).select(((F.col("id") * 7919) % 1013 - 500).alias("a"), ((F.col("id") * 31) % 17).alias("b"), "id")
    got = [tuple(r) for r in ordered(rows, [F.col("a"), -F.col("b"), F.col("id")]).orderBy("place").select("a", "b", "id", "place").collect()]
    want = sorted((((i * 7919) % 1013 - 500, (i * 31) % 17, i) for i in range(5000)), key=lambda r: (r[0], -r[1], r[2]))
    assert got == [(*r, k) for k, r in enumerate(want)]
