"""Tables with nulls, repeated rows, clashing names and no rows, through the operators and the whole pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, license_scan, quality_classifier, secret_scan, simhash, token_counts, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "The committee reviewed the annual report and found that most of the figures, as published, agree with the accounts kept by the office."


def rows():
    texts = [None, "", " \n", "a", GOOD, GOOD, GOOD + " password = hunter2hunter2", "word " * 20_000, "\x00\x1f", "<|endoftext|>", "AKIA" + "Z" * 16]
    out = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return out + [out[4], out[4], (None, GOOD, None, None, None), (None, None, None, None, None)]


@pytest.fixture
def folder(spark, tmp_path):
    def made(docs, labels=None, bench=None):
        at = f"file://{tmp_path}/in"
        spark.createDataFrame(docs, SCHEMA).write.mode("overwrite").parquet(f"{at}/documents.parquet")
        spark.createDataFrame(labels or [], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{at}/labels.parquet")
        spark.createDataFrame(bench or [], "item_id string, text string").write.mode("overwrite").parquet(f"{at}/benchmark.parquet")
        return at

    return made


def test_pipeline_with_nulls_and_repeated_rows(spark, folder):
    labels = [(4, 1, 0), (5, 1, 0), (0, None, None), (None, 1, 0), (4, 1, 1)]
    at = folder(rows(), labels, [("x", "zz yy xx"), (None, None), ("y", "")])
    out = corpus_pipeline.run(spark, at).collect()
    ids = [r.doc_id for r in out if r.doc_id is not None]
    # One label only: every score is its share, so nothing is rejected; of the copies the first stays.
    assert len(ids) == len(set(ids)) and 4 in ids and 5 not in ids and sum(r.doc_id is None for r in out) == 2
    assert {r.doc_id: r.n_tokens for r in out}[1] == 0 if 1 in ids else True


def test_pipeline_without_documents(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0


def test_stages_keep_clashing_columns(spark, folder):
    at = folder(rows(), [(4, 1, 0)])
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumns({c: F.lit("mine") for c in ("score", "_id", "_t", "keys", "fp", "node", "digest", "component", "_row", "_body", "_spans", "matches", "words", "_text", "kept")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, at)
        assert docs.where("score = 'mine' AND node = 'mine' AND _row = 'mine' AND _text = 'mine'").count() == docs.count() > 0


def test_operators_take_every_row(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows()], SCHEMA + ", spans string, assign int")
    none, n = df.where("false"), len(rows())
    path = bpe.vocabulary()
    made = {
        "bpe": lambda d: bpe.digests(bpe.bpe_decode(bpe.bpe_encode(d, path), path)),
        "licence": license_scan.license_scan,
        "fingerprints": simhash.simhash_components,
        "secrets": secret_scan.secret_spans,
        "masked": secret_scan.without_secrets,
        "lengths": lambda d: token_counts.token_lengths(d, path),
        "scores": lambda d: quality_classifier.score_quality(d, quality_classifier.train([])),
    }
    for name, f in made.items():
        assert f(df).count() == n and f(none).count() == 0, name


def test_repeated_rows_are_judged_alike(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    told = secret_scan.secret_spans(df).select("doc_id", secret_scan.span_list(tuple(secret_scan.PATTERNS)).alias("s")).where("doc_id = 4").distinct()
    assert told.count() == 1
    found = simhash.simhash_components(df).where("doc_id IN (4, 5)").select("component_id").distinct().collect()
    assert [r.component_id for r in found] == [4]


def test_pages_of_one_payload_and_id(spark):
    pages = spark.createDataFrame([(2, "u", "same", 1), (2, "u", "same", 2), (1, "v", "same", 3), (None, "w", "same", 4)], "page_id long, url string, html string, sha int")
    archives = warc.write_archives(pages, warc.new_path(spark, "edges"))
    got = sorted(((r.page_id or 0), r.record_type, r.refers_to) for r in warc.read_archives(archives, archives.count()).collect())
    assert got == [(0, "response", None), (1, "response", None), (2, "revisit", 1), (2, "revisit", 1)]
