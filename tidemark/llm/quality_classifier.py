"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(bias + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all
pairs of features interact through low-rank vectors, in time linear in the features.

The model is trained on the driver, on features of at most SAMPLE labelled rows (chosen by a
hash of the id, so the same at every size) outside the held-out fold; texts stay in tasks.
Labels, language, source and id are no inputs of a score.

Defined results: a null text is an empty text and is scored as one; rows without a label, or
with several that disagree, train nothing; of several texts of an id the least in order trains; without any usable label, or with one class only,
every score is the share of label 1 (1 without labels); repeated rows are scored row by row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_batches

#: Labelled rows that train the model at most.
SAMPLE = 6000
BUCKETS, RANK = 1 << 12, 8
#: Score from which a document counts as good.
GOOD = 0.7
STATS = 14


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: word buckets by log count, scaled to length 1, then the statistics."""
    data = (text or "").encode()
    words = data.lower().split()
    n = max(len(words), 1)
    stats = np.zeros(STATS)
    if words:
        counts = np.bincount(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        value = np.log1p(counts[at])
        value = value / np.sqrt((value**2).sum())
        byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        size = len(data)
        lines = [x for x in data.split(b"\n") if x.strip()]
        distinct = len(set(words))
        runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
        capitals, small = byte[65:91].sum(), byte[97:123].sum()
        stats[:] = (
            1.0,
            np.log1p(n) / 8,
            np.log1p(size) / 10,
            min(1.0, byte[[35, 36, 37, 38, 42, 60, 62, 124, 126, 94]].sum() / n),
            min(1.0, byte[33] / n),
            capitals / max(capitals + small, 1),
            byte[48:58].sum() / size,
            (byte[128:].sum()) / size,
            min(1.0, byte[[44, 46, 59, 58]].sum() / n),
            distinct / n,
            min(1.0, runs / n),
            1 - len(set(lines)) / max(len(lines), 1),
            min(1.0, (size - byte[32] - byte[9:14].sum()) / n / 20),
            min(1.0, len(lines) / n),
        )
    else:
        at, value = np.empty(0, np.int64), np.empty(0)
        stats[0] = 1.0
    return np.concatenate([at, BUCKETS + np.arange(STATS)]).astype(np.int32), np.concatenate([value, stats]).astype(np.float32)


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, at: np.ndarray, value: np.ndarray) -> float:
        mixed = self.factors[at] * value[:, None]
        return float(self.bias + self.weights[at] @ value + 0.5 * ((mixed.sum(axis=0) ** 2).sum() - (mixed**2).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text)), -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, seed: int = 1) -> Machine:
    """Adam on the logistic loss, from a fixed seed."""
    rng, size = np.random.default_rng(seed), BUCKETS + STATS
    share = np.mean([y for _, _, y in rows]) if rows else 1.0
    if share in (0.0, 1.0):
        return Machine(30.0 if share else -30.0, np.zeros(size), np.zeros((size, RANK)))
    p = [np.array([np.log(share / (1 - share))]), np.zeros(size), rng.normal(0, 0.02, (size, RANK))]
    first, second, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), batch):
            part = [rows[i] for i in order[k : k + batch]]
            lengths = np.array([len(a) for a, _, _ in part])
            at, value, y = np.concatenate([a for a, _, _ in part]), np.concatenate([v for _, v, _ in part]).astype(float), np.array([y for _, _, y in part])
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            mixed = p[2][at] * value[:, None]
            sums = np.add.reduceat(mixed, begin, axis=0)
            margin = p[0][0] + np.add.reduceat(p[1][at] * value, begin) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((mixed**2).sum(axis=1), begin))
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(part)
            per = np.repeat(g, lengths) * value
            used, place = np.unique(at, return_inverse=True)
            gv = per[:, None] * (np.repeat(sums, lengths, axis=0) - mixed)
            grads = [np.array([g.sum()]), np.bincount(place, per), np.stack([np.bincount(place, gv[:, f]) for f in range(RANK)], axis=1)]
            step += 1
            for x, m, s, d, rows_of in zip(p, first, second, grads, (slice(None), used, used), strict=True):
                d = d + decay * x[rows_of]
                m[rows_of] = 0.9 * m[rows_of] + 0.1 * d
                s[rows_of] = 0.999 * s[rows_of] + 0.001 * d * d
                x[rows_of] -= rate * (m[rows_of] / (1 - 0.9**step)) / (np.sqrt(s[rows_of] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(p[0][0]), p[1], p[2])


def held_out(id_col: str) -> Column:
    """Rows that never train: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Machine:
    told = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
    chosen = told.where(~held_out("_id")).groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # At most `sample` ids, far below any size that a broadcast minds.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t")).select("_id", "_t", "_y")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = [features(t) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array([a for a, _ in told], pa.list_(pa.int32())), pa.array([v for _, v in told], pa.list_(pa.float32())), batch.column(2)], names=["_id", "at", "value", "y"])

    kind = texts.schema["_id"].dataType.simpleString()
    got = map_batches(texts, rows, f"_id {kind}, at array<int>, value array<float>, y int").toArrow().sort_by("_id")
    return train([(np.array(a, np.int64), np.array(v, np.float32), y) for a, v, y in zip(got["at"].to_pylist(), got["value"].to_pylist(), got["y"].to_pylist(), strict=True)])


def score_quality(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score, the probability of label 1."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # its size is fixed by BUCKETS and RANK

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([sent.value.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=[id_col, "score"])

    return map_batches(docs.select(id_col, text_col), rows, f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, machine: Machine, text_col: str = "text", least: float = GOOD) -> DataFrame:
    """docs without the documents that score below `least`; nothing moves."""
    sent, place, fields = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index(text_col), docs.schema

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([sent.value.score(t) >= least for t in batch.column(place).to_pylist()], pa.bool_()))

    return map_batches(docs, rows, fields)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, machine).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
