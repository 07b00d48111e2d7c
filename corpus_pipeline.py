"""A training corpus from raw documents: bad, copied and benchmark documents go, secrets are masked, and the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import bpe_decode, bpe_encode, digests, vocabulary
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.quality_classifier import fit, keep_good
from tidemark.llm.secret_scan import without_secrets
from tidemark.llm.shared import written
from tidemark.llm.simhash import simhash_dedup


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of the documents it is given."""
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return simhash_dedup(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return without_secrets(docs, chars_col="n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and the digests of their round trip."""
    path = vocabulary()
    pairs = bpe_decode(bpe_encode(docs, path), path)
    return digests(pairs, keep=("ids",))


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", secrets_masked),
    ("BPE encoding and decoding", encoded),
]

#: Models, fingerprints and merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + "-".join(name.lower().split()))
    return docs
