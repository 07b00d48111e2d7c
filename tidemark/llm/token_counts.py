"""Token totals for every context limit from the exact histogram of encoded lengths.

Documents are encoded in tasks and reduced to one row per length before anything moves.
Suffix sums over that histogram answer every limit L: how many documents exceed it, how many
tokens remain if each document is cut at L, and which quantile L is; `at_limits` answers limits
that no document has as its length, and `quantiles` the lengths of given shares.  The sums run in two
levels (ranges of lengths, then lengths within a range), so no task holds the histogram whole.

Defined results: a null or empty text has length 0 and is counted there; repeated rows count
as often as they occur; an empty table gives an empty histogram.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_batches
from tidemark.llm.bpe import bpe, vocabulary
from tidemark.llm.shared import written

#: Lengths in one range of the two-level sums.
SPAN = 1024


def token_lengths(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """n_tokens of every row."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array([len(bpe(path).encode(t or "")) // 4 for t in batch.column(0).to_pylist()], pa.int64())], names=["n_tokens"])

    return map_batches(docs.select(text_col), rows, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, as a context limit: documents of just that length, at most it and beyond it,
    tokens of all documents within the limit, tokens kept if the others are cut at L, tokens cut off, and the share of documents within."""
    spans = histogram.withColumn("_span", F.floor(F.col("n_tokens") / SPAN))
    tokens = F.col("n_tokens") * F.col("n_docs")
    totals = spans.groupBy("_span").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    # One row per SPAN lengths: as many as the longest document has thousands of tokens.
    later = Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    above = totals.select("_span", F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_d"), F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_t"))
    # No row where there are no documents; the totals belong to every row.
    every = histogram.agg(F.sum("n_docs").alias("_docs"), F.sum(tokens).alias("_tokens"))
    inside = Window.partitionBy("_span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    joined = spans.join(above, "_span").join(F.broadcast(every))  # `every` is one row
    beyond = F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("_d")
    over = F.coalesce(F.sum(tokens).over(inside), F.lit(0)) + F.col("_t")
    told = joined.select("n_tokens", "n_docs", beyond.alias("n_longer"), over.alias("_over"), "_docs", "_tokens")
    kept = F.col("_tokens") - F.col("_over") + F.col("n_longer") * F.col("n_tokens")
    return told.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        (F.col("_docs") - F.col("n_longer")).alias("n_within"),
        "n_longer",
        (F.col("_tokens") - F.col("_over")).alias("tokens_within"),
        kept.alias("tokens_truncated"),
        (F.col("_tokens") - kept).alias("tokens_cut"),
        F.col("_tokens").alias("tokens_total"),
        ((F.col("_docs") - F.col("n_longer")) / F.col("_docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit of a list, whether a document has that length or not: the documents within and beyond it, the tokens kept if longer ones are cut, and those cut off.

    One aggregation whose rows are the caller's limits; an empty histogram has zeros. Repeated limits are one row.
    """
    wanted = sorted({int(x) for x in limits})
    n, d = F.col("n_tokens"), F.col("n_docs")
    parts = []
    for k, limit in enumerate(wanted):
        parts += [F.sum(F.when(n <= limit, d).otherwise(0)).alias(f"w{k}"), F.sum(F.when(n > limit, d).otherwise(0)).alias(f"l{k}"), F.sum(F.least(n, F.lit(limit)) * d).alias(f"t{k}"), F.sum(F.greatest(n - limit, F.lit(0)) * d).alias(f"c{k}")]
    if not wanted:
        return histogram.sparkSession.createDataFrame([], "context_limit long, n_within long, n_longer long, tokens_truncated long, tokens_cut long")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    rows = [F.struct(F.lit(x).cast("long").alias("context_limit"), *[zero(f"{c}{k}").alias(name) for c, name in zip("wltc", ("n_within", "n_longer", "tokens_truncated", "tokens_cut"), strict=True)]) for k, x in enumerate(wanted)]
    return histogram.agg(*parts).select(F.inline(F.array(*rows)))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share in (0, 1], the smallest length that at least that share of the documents does not exceed (quantile, n_tokens). sums: of suffix_sums; of an empty one every length is null."""
    wanted = sorted(set(shares))
    if any(not 0 < q <= 1 for q in wanted):
        raise ValueError(f"shares must lie in (0, 1]: {wanted}")
    if not wanted:
        return sums.sparkSession.createDataFrame([], "quantile double, n_tokens long")
    least = [F.min(F.when(F.col("quantile") >= q, F.col("context_limit"))).alias(f"q{k}") for k, q in enumerate(wanted)]
    rows = [F.struct(F.lit(float(q)).alias("quantile"), F.col(f"q{k}").cast("long").alias("n_tokens")) for k, q in enumerate(wanted)]
    return sums.agg(*least).select(F.inline(F.array(*rows)))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    lengths = token_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
    return suffix_sums(written(length_histogram(lengths), "histogram"))  # it is read three times
