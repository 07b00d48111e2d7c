"""Importance resampling towards a target distribution of hashed word runs.

Counts of both sides become an array of gains by bucket; a document's weight is the mean of
its features' gains, and a Gumbel number from its id turns the highest scores into a draw by weight.

The order comes from a distributed least-significant-digit radix sort. A pass takes one
digit of the composite key (score downwards, id, number of features): rows are counted by
block and digit, prefix sums over digits and blocks give each its first destination, and a row moves to the first
destination of its digit and block plus its number among its equals there, which keeps equal digits in order. A
block holds a bounded share of all places, whatever the keys are.

Defined results: a null or empty text has no features, weight 0 and is too short to be drawn; a null id is
hashed as an empty one and comes before other ids; rows of one id are drawn row by row, those with fewer features
first if they tie; an empty table gives an empty result, an empty target gains as if each bucket had been seen equally often;
columns other than ids and texts are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import BATCH_ROWS, map_batches
from tidemark.llm.shared import written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Rows of a block of the sort, until there are as many blocks as may be; then blocks grow.
BLOCK, BLOCKS = 4096, 1 << 13
#: First destinations of blocks and digits that one pass sends to the tasks, at most; digits are as narrow as that asks.
COUNTS, DIGIT_BITS = 1 << 20, 12


def features(text: str | None, runs: int) -> tuple[int, list[bytes]]:
    """The number of words, and all runs of 1 to `runs` words."""
    words = WORD.findall((text or "").encode().lower())
    out = list(words)
    for n in range(2, runs + 1):
        out += map(b" ".join, zip(*[words[i:] for i in range(n)], strict=False))
    return len(words), out


def bucket_counts(df: DataFrame, text_col: str, runs: int, buckets: int) -> np.ndarray:
    """Features by bucket over all texts. A task returns one array, so what comes back is as long as there are buckets."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            told: Counter[bytes] = Counter()
            for text in batch.column(0).to_pylist():
                told.update(features(text, runs)[1])
            at = np.fromiter(map(zlib.crc32, told), np.int64, len(told)) % buckets
            np.add.at(seen, at, np.fromiter(told.values(), np.int64, len(told)))
        held = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(held), pa.array(seen[held])], names=["bucket", "n"])

    found = df.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, floored."""
    of_source, of_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_source / ((s + 1.0) * of_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(seed: int, key) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, told: np.ndarray, id_col: str, text_col: str, runs: int, seed: int) -> DataFrame:
    """id, n_words, n_features, weight and score of each row."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n_words, runs_ = features(text, runs)
            at = np.fromiter(map(zlib.crc32, runs_), np.int64, len(runs_)) % len(told)
            weight = int(told[at].sum()) // len(at) if len(at) else 0
            out.append((n_words, len(runs_), weight, weight + gumbel(seed, key)))
        return pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in zip(*out, strict=True)]], names=["id", "n_words", "n_features", "weight", "score"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), text_col), rows, "id long, n_words long, n_features long, weight long, score long")


def digits(rows: DataFrame, keys: list[Column], bits: int) -> list[Column]:
    """The digits of the composite key, the least significant first; each key is a long, and its width is that of its range."""
    ranges = rows.agg(*[f(k).alias(f"{name}{i}") for i, k in enumerate(keys) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for i, key in reversed(list(enumerate(keys))):
        lo, hi = ranges[f"lo{i}"], ranges[f"hi{i}"]
        if lo is None or lo == hi:
            continue
        # A range wider than a long counts in unsigned longs.
        width = min((hi - lo).bit_length(), 64)
        value = key - F.lit(lo) if width < 64 else key.bitwiseXOR(F.lit(-(1 << 63)))
        each = -(-width // -(-width // bits))
        out += [F.shiftrightunsigned(value, s).bitwiseAND(F.lit((1 << each) - 1)).cast("int") for s in range(0, width, each)]
    return out


def ordered(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """rows with `place`, from zero, in ascending order of the keys, which are longs without nulls."""
    table = written(rows.withColumn("place", F.monotonically_increasing_id()), "unsorted")
    n = table.count()
    size = max(BLOCK, -(-n // BLOCKS))
    blocks = max(1, -(-n // size))
    bits = min(DIGIT_BITS, (COUNTS // blocks).bit_length() - 1)
    table = table.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int"))
    for digit in digits(table, keys, bits) or [F.lit(0)]:
        table = written(counting_pass(table, digit, size), "sorted")
    return table


def counting_pass(table: DataFrame, digit: Column, size: int) -> DataFrame:
    """The table in a stable order of the digit: a new place and block for each row."""
    table = table.withColumn("digit", digit)
    counts = table.groupBy("digit", "block").agg(F.count("*").alias("n"))
    # Prefix sums in two levels: over the digits, whose number is bounded, and over the blocks of each digit.
    base = counts.groupBy("digit").agg(F.sum("n").alias("n")).select(F.col("digit").alias("d"), (F.sum("n").over(Window.orderBy("digit")) - F.col("n")).alias("base"))
    within = counts.withColumn("within", F.sum("n").over(Window.partitionBy("digit").orderBy("block")) - F.col("n"))
    first = within.join(F.broadcast(base), F.col("digit") == F.col("d")).select("digit", "block", (F.col("base") + F.col("within")).alias("first"))
    among = F.row_number().over(Window.partitionBy("block", "digit").orderBy("place")) - 1
    moved = table.withColumn("among", among).join(F.broadcast(first), ["block", "digit"]).withColumn("place", F.col("first") + F.col("among"))
    return moved.withColumn("block", F.floor(F.col("place") / size).cast("int")).drop("digit", "among", "first")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """id (a long), n_features, weight, score and rank of each row; rank is null unless the row is among the `percent` of rows of at least `least_words` words that are drawn."""
    told = gains(bucket_counts(docs, text_col, runs, buckets), bucket_counts(target, text_col, runs, buckets))
    found = written(scores(docs, told, id_col, text_col, runs, seed), "scores")
    eligible = found.where(F.col("n_words") >= least_words)
    drawn = percent * eligible.count() // 100
    known = F.col("id").isNotNull().cast("long")
    place = ordered(eligible, [-F.col("score"), known, F.coalesce("id", F.lit(0)), F.col("n_features")]).select("id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    short = found.where(F.col("n_words") < least_words).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return place.union(short).withColumnRenamed("id", id_col)


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target)
