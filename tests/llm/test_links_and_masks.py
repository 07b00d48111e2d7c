"""Rows of one id are one document, and masks of very many secrets."""

import random
import time

from pyspark.sql import functions as F

from tidemark.llm import secret_scan, simhash


def test_texts_of_one_id_are_one_document(spark):
    words = lambda n: " ".join(f"{n}w{i}" for i in range(60))
    rows = [(3, words("a")), (5, words("a")), (5, words("b")), (7, words("b")), (7, words("c")), (1, words("c")), (9, words("d")), (None, words("d")), (None, words("a")), (11, None), (12, "")]
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 1), (5, 1), (7, 1), (1, 1), (9, 9), (None, 9), (None, 1), (11, 11), (12, 11)}


def plain(text, spans, mark):
    out, end = [], 0
    for a, b in sorted(spans):
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join(out) + text[end:]


def test_masks_by_brute_force(spark):
    rng = random.Random(2)
    part = lambda: rng.choice([" plain words é ", f" password={rng.randrange(10**9)}abc ", " AKIA" + "Z" * 16, f" {rng.getrandbits(128):032x}", " token: " + "AKIA" + "Q" * 20, "\n"])
    rows = [(i, "".join(part() for _ in range(rng.choice([0, 3, 40, 900])))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: [(s.start, s.end) for k in secret_scan.PATTERNS for s in r[k]] for r in secret_scan.secret_spans(df).collect()}
    got = {r.doc_id: r.text for r in secret_scan.without_secrets(df).collect()}
    assert max(map(len, spans.values())) > 2 * secret_scan.PIECE
    assert got == {i: plain(t, spans[i], "[SECRET]") for i, t in rows}


def test_a_text_of_very_many_secrets(spark):
    text = "".join(f"password = {'x' * 8}{i:06d} \n" for i in range(16_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secret_scan.without_secrets(df.where("doc_id > 1")).count()
    began = time.time()
    got = secret_scan.without_secrets(df).select(F.length("text").alias("n"), F.size(F.split("text", "SECRET")).alias("k")).first()
    assert got.k == 16_001 and time.time() - began < 60
