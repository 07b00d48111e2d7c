"""Removal of passages that repeat across or within documents, located by automata of repeated phrases.

A window is a run of consecutive words. Its anchor is the phrase of PHRASE words with the least hash
in it, so equal windows have equal anchors, and neighbouring windows mostly share one: their stretch is a
segment. Documents are dealt out to shards of bounded text.

1. Every shard counts its segments by anchor and content; only these counts are added up over the corpus. A segment found twice recurs whole.
   Where one anchor stands in different segments, the windows of one specimen of each are counted as well, which confirms the others that recur.
2. Every shard is told which of its own segments and windows recur. It compiles their anchors
   into an Aho-Corasick automaton of its own, so automata grow with the recurring phrases of a shard and not with the corpus.
3. All documents of the shard are streamed through the automaton; each window around a place where a phrase stands is removed
   if it is one of the confirmed ones.

Counts and lists travel, by shard, so a passage that stands in a third of all documents is one row a shard. Texts move once, into
a table that is bucketed by shard and that each step reads in place. Contents are compared by pairs of 64-bit hashes.

Defined results: a null or empty text has no words; a text of fewer words than a window loses nothing; overlapping
repeats within one document count; repeated rows are documents that repeat each other, so all lose those words; rows keep
their ids, null ones too; an empty table gives an empty result; columns other than ids and texts are ignored.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import new_table, written

#: Words of an anchor phrase, at most; a window holds at least one.
PHRASE = 8
#: Characters of documents that make one shard, on average; a longer document is a shard's by itself.
SHARD_CHARS = 1_000_000
#: Odd bases of the two rolling hashes, modulo 2 ** 64.
BASES = tuple(int(x) for x in np.random.default_rng(35).integers(1 << 62, 1 << 63, 2, np.uint64) * np.uint64(2) + np.uint64(1))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shard:
    """The words of some documents, and hashes of any of their runs."""

    def __init__(self, texts: list[str | None], window: int):
        self.window, self.phrase = window, min(PHRASE, window)
        self.documents = [(t or "").encode().split() for t in texts]
        self.ends = np.cumsum([len(d) for d in self.documents], dtype=np.int64)
        known: dict[bytes, int] = {}
        self.ids = np.fromiter((known.setdefault(w, len(known)) for d in self.documents for w in d), np.int64, sum(map(len, self.documents)))
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[self.ids]
        self.n_known, n = len(known), len(self.ids)
        self.sums, self.inverses = [], []
        for base in BASES:
            powers, inverses = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (base, pow(base, -1, 1 << 64)))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * powers[:n], dtype=np.uint64)]))
            self.inverses.append(inverses)
        starts = self.ends - np.array([len(d) for d in self.documents], np.int64)
        #: Where windows start: those that end in their document.
        self.starts = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(starts, self.ends, strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)

    def run(self, at: np.ndarray, length: np.ndarray | int, which: int = 0) -> np.ndarray:
        """The hash of `length` words from each place."""
        sums = self.sums[which]
        return mixed((sums[at + length] - sums[at]) * self.inverses[which][at])

    def anchors(self) -> np.ndarray:
        """Of each window, the place of its phrase with the least hash, the first such one."""
        n, width = len(self.ids), self.window - self.phrase + 1
        if not len(self.starts):
            return self.starts
        value = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        value[: n - self.phrase + 1] = self.run(np.arange(n - self.phrase + 1), self.phrase)
        place, span = np.arange(n), 1
        while span < width:
            step = min(span, width - span)
            right = value[place[np.minimum(np.arange(n) + step, n - 1)]] < value[place]
            place = np.where(right, place[np.minimum(np.arange(n) + step, n - 1)], place)
            span += step
        return place[self.starts]

    def segments(self) -> dict[str, np.ndarray]:
        """Runs of consecutive windows with one anchor: from, to (indexes of `starts`), at (the anchor's place), a and s (hashes of anchor and content)."""
        at = self.anchors()
        if not len(at):
            none = np.zeros(0, np.int64)
            return {"from": none, "to": none, "at": none, "a": none.astype(np.uint64), "s": none.astype(np.uint64)}
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (self.starts[1:] != self.starts[:-1] + 1)]))
        to = np.append(new[1:], len(at))
        first, last, at = self.starts[new], self.starts[to - 1], at[new]
        shape = mixed(((at - first) * (1 << 32) + (last - first)).astype(np.uint64))
        return {"from": new, "to": to, "at": at, "a": self.run(at, self.phrase), "s": mixed(self.run(first, last - first + self.window, 1) ^ shape)}

    def windows(self, segments: dict[str, np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of `starts` of all windows of some segments, and for each the segment."""
        sizes = segments["to"][which] - segments["from"][which]
        of = np.repeat(which, sizes)
        return segments["from"][of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes), of

    def automaton(self, places: np.ndarray) -> ahocorasick.Automaton:
        """Of the phrases at these places; a word is written as digits of its number, the first of them marked."""
        told = self.written_words()
        made, d = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), self.digits()
        for p in places.tolist():
            made.add_word(told[p * d : (p + self.phrase) * d])
        made.make_automaton()
        return made

    def digits(self) -> int:
        return max(1, -(-(max(self.n_known - 1, 1).bit_length()) // 8))

    def written_words(self) -> str:
        d = self.digits()
        codes = ((self.ids[:, None] >> (8 * np.arange(d)[::-1])) & 255).astype("<u4")
        codes[:, 0] += 256
        return codes.tobytes().decode("utf-32-le")

    def located(self, made: ahocorasick.Automaton) -> np.ndarray:
        """Places where a phrase of the automaton stands, in all documents."""
        d, told, out, start = self.digits(), self.written_words(), [], 0
        for end in self.ends.tolist():
            out += [end_ // d + start - self.phrase + 1 for end_, _ in made.iter(told[start * d : end * d])]
            start = end
        return np.array(out, np.int64)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def as_hash(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first index of each distinct pair, and for each row the number of its pair."""
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])[: len(a)]
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def among(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> np.ndarray:
    """For each pair the index of an equal one among the others, or -1."""
    out = np.full(len(a), -1, np.int64)
    if len(of_a) and len(a):
        _, number = unique_pairs(np.concatenate([of_a, a]), np.concatenate([of_b, b]))
        index = np.full(number.max() + 1, -1, np.int64)
        index[number[: len(of_a)]] = np.arange(len(of_a))
        out = index[number[len(of_a) :]]
    return out


def shards(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and shard, as a table that is bucketed by shard. Rows are dealt by number, so copies spread."""
    total = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    n = max(1, -(-total // SHARD_CHARS))
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).alias("shard"))
    return new_table(given, "shards", "shard")


def segment_counts(table: DataFrame, window: int) -> DataFrame:
    """(shard, a, s, n): how often each segment stands in each shard."""

    def count(rows: pa.Table) -> pa.Table:
        found = Shard(rows.column("text").to_pylist(), window).segments()
        first, number = unique_pairs(found["a"], found["s"])
        shard = pa.array(np.full(len(first), rows.column("shard")[0].as_py()), pa.int64())
        return pa.table([shard, as_long(found["a"][first]), as_long(found["s"][first]), pa.array(np.bincount(number, minlength=len(first)), pa.int64())], names=["shard", "a", "s", "n"])

    return table.groupBy("shard").applyInArrow(count, "shard long, a long, s long, n long")


def window_counts(table: DataFrame, specimens: DataFrame, window: int) -> DataFrame:
    """(shard, a, h, n, single): the windows of the specimens (shard, a, s, n), counted as often as their segments, at most twice each; single if one of these segments is found but once."""

    def count(rows: pa.Table, sought: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.bool_())], names=["shard", "a", "h", "n", "single"])
        if not sought.num_rows or not rows.num_rows:
            return none
        shard = Shard(rows.column("text").to_pylist(), window)
        found, (a, s) = shard.segments(), (as_hash(sought.column(c)) for c in "as")
        which = among(a, s, found["a"], found["s"])
        times = sought.column("n").to_numpy()
        at, of = shard.windows(found, which)
        weight = np.repeat(np.minimum(times, 2), found["to"][which] - found["from"][which])
        a, h = found["a"][of], shard.run(shard.starts[at], window, 1)
        first, number = unique_pairs(a, h)
        n, once = np.bincount(number, weight, len(first)).astype(np.int64), np.bincount(number, weight == 1, len(first)) > 0
        return pa.table([pa.array(np.full(len(first), rows.column("shard")[0].as_py()), pa.int64()), as_long(a[first]), as_long(h[first]), pa.array(n), pa.array(once)], names=none.schema.names)

    return table.groupBy("shard").cogroup(specimens.groupBy("shard")).applyInArrow(count, "shard long, a long, h long, n long, single boolean")


def recurring(table: DataFrame, window: int) -> DataFrame:
    """(shard, whole, a, h): the segments (whole) and the windows of each shard that stand in the corpus more than once."""
    counts = written(segment_counts(table, window), "segments")
    variants = written(counts.groupBy("a", "s").agg(F.sum("n").alias("n"), F.min("shard").alias("shard")), "variants")
    # Anchors of one segment only need no windows: the segment recurs whole or not at all.
    several = variants.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a")
    specimens = variants.join(several, "a").select("shard", "a", "s", "n")
    found = written(window_counts(table, specimens, window), "windows")
    again = found.groupBy("a", "h").agg(F.sum("n").alias("n")).where("n > 1").select("a", "h")
    windows = found.where("single").join(again, ["a", "h"]).select("shard", F.lit(False).alias("whole"), "a", "h")
    segments = counts.join(variants.where("n > 1").select("a", "s"), ["a", "s"]).select("shard", F.lit(True).alias("whole"), "a", F.col("s").alias("h"))
    return segments.union(windows)


def removed(shard: Shard, whole: np.ndarray, a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which words of the shard go, if these segments and windows recur."""
    gone = np.zeros(len(shard.ids) + 1, np.int64)
    if not len(whole):
        return gone[:-1] > 0
    # Compiled from one specimen of each segment and window that the corpus confirmed.
    found = shard.segments()
    at, of = shard.windows(found, among(a[whole], h[whole], found["a"], found["s"]))
    mine = np.flatnonzero(np.isin(found["a"], a[~whole]))
    at_, of_ = shard.windows(found, mine)
    told = among(found["a"][of_], shard.run(shard.starts[at_], shard.window, 1), a[~whole], h[~whole]) >= 0
    at, of = np.concatenate([at, at_[told]]), np.concatenate([of, of_[told]])
    confirmed = [shard.run(shard.starts[at], shard.window, which) for which in (0, 1)]
    first, _ = unique_pairs(*confirmed)
    confirmed = [x[first] for x in confirmed]
    phrases = np.unique(of[first])
    _, one = np.unique(found["a"][phrases], return_index=True)
    # Streamed: every place of a phrase, and every window around it.
    places = shard.located(shard.automaton(found["at"][phrases[one]]))
    near = np.zeros(len(shard.ids) + 1, np.int64)
    np.add.at(near, np.maximum(places - (shard.window - shard.phrase), 0), 1)
    np.add.at(near, places + 1, -1)
    starts = shard.starts[np.cumsum(near)[shard.starts] > 0]
    starts = starts[among(shard.run(starts, shard.window, 0), shard.run(starts, shard.window, 1), *confirmed) >= 0]
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + shard.window, -1)
    return np.cumsum(gone)[:-1] > 0


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """id, n_words, spans (array of [start, end) of words that go) and kept (the other words, joined by one space) of each row."""
    if window < 1:
        raise ValueError("a window has at least one word")
    table = shards(docs, id_col, text_col)
    kind = table.schema["id"].dataType.simpleString()
    told = written(recurring(table, window), "recurring")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def locate(rows: pa.Table, sought: pa.Table) -> pa.Table:
        shard = Shard(rows.column("text").to_pylist(), window)
        gone = removed(shard, sought.column("whole").to_numpy(), as_hash(sought.column("a")), as_hash(sought.column("h")))
        spans, kept, start = [], [], 0
        for words, end in zip(shard.documents, shard.ends.tolist(), strict=True):
            mine = gone[start:end]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
            spans.append([{"start": x, "end": y} for x, y in edges])
            kept.append(b" ".join([w for w, g in zip(words, mine.tolist(), strict=True) if not g] if edges else words).decode())
            start = end
        sizes = pa.array([len(d) for d in shard.documents], pa.int64())
        return pa.table([rows.column("id"), sizes, pa.array(spans, pa.list_(span)), pa.array(kept, pa.string())], names=["id", "n_words", "spans", "kept"])

    found = table.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(locate, f"id {kind}, n_words long, spans array<struct<start:long,end:long>>, kept string")
    return found.withColumnRenamed("id", id_col)


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
