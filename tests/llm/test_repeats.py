"""Repeated passages against a count of all windows."""

import random
from collections import Counter

import pytest

from tidemark.llm import repeats
from tidemark.llm.repeats import without_repeats

SCHEMA = "doc_id long, text string, shard string, spans int, a string"


def plain(docs, window):
    told = [(i, (t or "").encode().split()) for i, t in docs]
    seen = Counter(tuple(w[i : i + window]) for _, w in told for i in range(len(w) - window + 1))
    out = []
    for i, w in told:
        gone = {k for j in range(len(w) - window + 1) if seen[tuple(w[j : j + window])] > 1 for k in range(j, j + window)}
        out.append((i, len(w), len(gone), " ".join(x.decode() for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def made(spark, docs, window):
    out = without_repeats(spark.createDataFrame([(i, t, "mine", 1, "mine") for i, t in docs], SCHEMA), window=window).collect()
    for r in out:
        assert all(x.start < y.start and x.end < y.start for x, y in zip(r.spans, r.spans[1:], strict=False))
    return sorted(((r.doc_id, r.n_words, sum(x.end - x.start for x in r.spans), r.kept) for r in out), key=repr)


@pytest.mark.parametrize("window", [1, 3, 9, 35])
def test_repeats_by_counting_windows(spark, monkeypatch, window):
    monkeypatch.setattr(repeats, "SHARD_CHARS", 3000)
    rng = random.Random(window)
    passages = [" ".join(rng.choice("abcdé") * rng.randint(1, 3) for _ in range(n)) for n in (20, 34, 35, 36, 60, 200)]
    docs = []
    for i in range(120):
        own = [" ".join(f"{i}x{rng.randint(0, 400)}" for _ in range(rng.randint(0, 50))) for _ in range(3)]
        cut = rng.choice(passages).split(" ")
        docs.append((i, own[0] + " " + " ".join(cut[rng.randint(0, 5) :]) + rng.choice([" ", "\n\t", "\x0b"]) + own[1] + " " + rng.choice(passages) + own[2]))
    assert made(spark, docs, window) == plain(docs, window)


def test_periodic_and_few_words(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("ab"[: 1 + i % 2]) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    for window in (2, 35):
        assert made(spark, docs, window) == plain(docs, window)


def test_nulls_repeated_rows_and_long_texts(spark):
    long = " ".join(f"n{i % 3001}" for i in range(60_000))
    docs = [(None, None), (None, "a b c"), (1, ""), (2, " \n\t "), (3, long), (4, "x " * 40), (5, " y z" * 3), (6, "q r s"), (6, "q r s"), (7, None)]
    assert made(spark, docs, 35) == plain(docs, 35)
    assert made(spark, docs, 3) == plain(docs, 3)
    assert made(spark, [], 35) == []


def test_words_beyond_two_digits(spark):
    words = [f"v{i}" for i in range(70_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[300:340])), (3, " ".join(words[69_000:69_036]))]
    assert made(spark, docs, 35) == plain(docs, 35)


def test_a_window_has_words(spark):
    with pytest.raises(ValueError, match="one word"):
        without_repeats(spark.createDataFrame([], "doc_id long, text string"), window=0)
