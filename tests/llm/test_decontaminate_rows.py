"""Decontamination keeps to rows whatever the size of the benchmark, and removes by items without an id."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate


@pytest.mark.parametrize("block", [10**6, 10])
def test_rows_of_one_id_stay_rows(spark, block):
    rows = [(1, "a b c d x"), (1, "y a b"), (None, "e f g h i j"), (None, "k"), (None, None), (2, "x x a b c d e f g h"), (2, "x x a b c d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d"), (8, "e f g h"), (9, "zz zz zz zz")], "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench, window=4, block_bytes=block)
    got = sorted((r.doc_id or 0, r.n_words, sorted((m["item"], m["doc_word"], m["n_words"]) for m in r.matches)) for r in found.collect())
    assert found.columns == ["doc_id", "n_words", "matches"]
    assert got == [(0, 0, []), (0, 1, []), (0, 6, [("8", 0, 4)]), (1, 3, []), (1, 5, [("7", 0, 4)])] + [(2, 10, [("7", 2, 4), ("8", 6, 4)])] * 2


@pytest.mark.parametrize("block", [10**6, 10])
def test_items_without_an_id_remove_documents(spark, block):
    docs = spark.createDataFrame([(1, "x a b c d"), (2, "x e f g h"), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c d"), (8, "e f g h")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench, window=4, block_bytes=block).collect()] == [3]
    assert sorted(r.doc_id for r in decontaminate.find_contamination(docs, bench, window=4, block_bytes=block).collect() if r.matches) == [2]


def test_shards_and_bounded_search(spark, monkeypatch):
    """Small shards and few suffixes at once change nothing; long texts of known words stay within bounds."""
    rng = random.Random(3)
    bench = [(str(k), " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))) for k in range(12)]
    texts = [None, "", "zz"] + [" ".join(rng.choice("abcdz") for _ in range(rng.randrange(80))) for _ in range(40)]
    tests = decontaminate.Tests(bench, 5)
    want = [x for shard in decontaminate.shards(texts) for x in decontaminate.matches(shard, tests)]
    monkeypatch.setattr(decontaminate, "SOUGHT", 3)
    got = [x for shard in decontaminate.shards(texts, 50) for x in decontaminate.matches(shard, tests)]
    assert [sorted(x) for x in got] == [sorted(x) for x in want] and sum(map(len, want)) > 100
    assert [len(s) for s in decontaminate.shards(["a" * 9, "b" * 9, None, "c"], 10)] == [1, 3]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    assert decontaminate.find_contamination(docs.where("false"), bench).count() == 0 and decontaminate.decontaminate(docs.where("false"), bench).count() == 0
    clean = decontaminate.find_contamination(docs, bench.where("false")).collect()
    assert sorted(r.n_words for r in clean) == [0, 4] and all(r.matches == [] for r in clean)
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == 2


@pytest.mark.parametrize("block", [10**6, 10])
def test_words_of_items_without_an_id_are_hit(spark, block):
    docs = spark.createDataFrame([(1, "x a b c d"), (2, "x a b c d e f g h"), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c d"), (8, "d e f g"), (8, "e f g h")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench, window=4, block_bytes=block).withColumn("n_hit", decontaminate.covered_words(F.col("spans"))).collect()}
    assert got == {1: (5, 4, []), 2: (9, 8, ["8"]), 3: (1, 0, [])}


def test_covered_words_by_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        bench = [(rng.choice([None, "p", "q", str(k)]), " ".join(rng.choice("abc") for _ in range(rng.randrange(9)))) for k in range(6)]
        texts = [" ".join(rng.choice("abcz") for _ in range(rng.randrange(25))) for _ in range(5)]
        shard = [decontaminate.words_of(x) for x in texts]
        for words, (spans, items) in zip(shard, decontaminate.covered(shard, decontaminate.Tests(bench, 4)), strict=True):
            hit, told = set(), set()
            for item, text in bench:
                ws = decontaminate.words_of(text)
                n = min(4, len(ws))
                for i in range(len(ws) - n + 1 if n else 0):
                    for j in range(len(words) - n + 1):
                        if words[j : j + n] == ws[i : i + n]:
                            hit |= set(range(j, j + n))
                            told |= {item}
            assert {k for a, n in spans for k in range(a, a + n)} == hit and items == sorted(told - {None})


def test_many_items_of_a_window_that_a_text_repeats():
    """Items and occurrences, not their pairs, which are a hundred million here."""
    bench = [(str(k), f"x{k} a b c d y{k}") for k in range(10_000)]
    shard = [decontaminate.words_of("a b c d z " * 10_000)]
    began = time.process_time()
    [(spans, items)] = decontaminate.covered(shard, decontaminate.Tests(bench, 4))
    assert len(spans) == len(items) == 10_000 and time.process_time() - began < 20
