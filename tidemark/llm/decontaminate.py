"""Benchmark decontamination with suffix arrays over the training text.

The documents of a batch are cut into shards of bounded size.  Words become numbers of the benchmark's vocabulary;
a word that it lacks ends every match, so only runs of known words as long as the shortest
window can hold one, and the shard's suffix array is built over those runs by prefix doubling.
Every test suffix, that is every benchmark position where a window starts, is looked up by
binary search in each shard.  Windows at consecutive positions of both texts join to the
longest verbatim matches, whose places are returned.

Defined results: a null text has no words; benchmark items without words have no windows;
words in windows of items without an id are hit and documents that hold them are removed, but such an
item cannot be named, so it is neither among the matches nor counted; repeated rows are judged row by row; an empty benchmark hits
nothing; columns other than ids and texts are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.arrow import map_batches
from tidemark.llm.shared import written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
#: Characters of documents that make one shard; a longer document is a shard by itself.
SHARD_CHARS = 2_000_000
#: Test suffixes that are searched for at once.
SOUGHT = 1 << 16
#: Bytes of benchmark text that are sent to the tasks at once; a larger benchmark goes in several blocks.
BLOCK_BYTES = 16_000_000


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


class Tests:
    """The windows of a block of benchmark items, by length, each once, with the items that hold it."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        told = [(item, words_of(text)) for item, text in items]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in told for w in ws}))}
        self.names = [item for item, _ in told]
        self.size = [min(window, len(ws)) for _, ws in told]
        held: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, ws) in enumerate(told):
            ids, n = [self.vocabulary[w] for w in ws], self.size[k]
            for i in range(len(ids) - n + 1) if n else ():
                held[n][tuple(ids[i : i + n])].append((k, i))
        self.windows = {n: (keys(np.array(sorted(x), dtype=np.int64)), [x[w] for w in sorted(x)]) for n, x in held.items()}
        self.shortest = min(held, default=0)


def keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as fixed-width byte strings of the same order."""
    n = rows.shape[1]
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * n}").ravel()


def bounds(windows: np.ndarray, order: np.ndarray, text: np.ndarray, n: int, after: bool) -> np.ndarray:
    """For each window the number of suffixes of `order` that sort before it, or with `after` before or with it, by their first n words; a binary search that spells out only the suffixes it probes."""
    out = np.empty(len(windows), np.int64)
    for at in range(0, len(windows), SOUGHT):
        sought = windows[at : at + SOUGHT]
        low, high = np.zeros(len(sought), np.int64), np.full(len(sought), len(order), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            probed = keys(text[order[np.minimum(mid, len(order) - 1)][:, None] + np.arange(n)])
            before = open_ & ((probed <= sought) if after else (probed < sought))
            low, high = np.where(before, mid + 1, low), np.where(open_ & ~before, mid, high)
        out[at : at + SOUGHT] = low
    return out


def shards(texts: list[str | None], most: int | None = None) -> Iterator[list[list[bytes]]]:
    """The words of the texts in shards of at most `most` characters, or of one text."""
    most, held, size = most or SHARD_CHARS, [], 0
    for text in texts:
        if held and size + len(text or "") > most:
            yield held
            held, size = [], 0
        held.append(words_of(text))
        size += len(text or "")
    if held:
        yield held


def runs(ids: np.ndarray, shortest: int) -> np.ndarray:
    """Positions of the runs of known words (ids above 0) that are at least `shortest` long."""
    known = np.concatenate([[False], ids > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= shortest
    return np.concatenate([np.arange(a, b) for a, b in zip(starts[long], ends[long], strict=True)]) if long.any() else np.empty(0, np.int64)


def suffix_array(text: np.ndarray, deep: int) -> np.ndarray:
    """Start positions in order of their suffixes, compared to at least `deep` words; prefix doubling."""
    rank, step = np.unique(text, return_inverse=True)[1], 1
    while step < deep:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1 if step < len(rank) else 0
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1]
        step *= 2
    return np.argsort(rank, kind="stable")


def occurrences(shard: list[list[bytes]], tests: Tests) -> Iterator[tuple[int, list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """For each distinct window that stands in the shard: its words, the items that hold it, its places in the shard, and where documents start there."""
    if not tests.windows or not shard:
        return
    get = tests.vocabulary.get
    starts = np.cumsum([0] + [len(ws) + 1 for ws in shard])
    ids = np.zeros(starts[-1], np.int64)
    for ws, at in zip(shard, starts, strict=False):
        ids[at : at + len(ws)] = [get(w, 0) for w in ws]
    places = runs(ids, tests.shortest)
    if not len(places):
        return
    deep = max(tests.windows)
    # The runs, each followed by a zero, which no window has.
    gaps = np.flatnonzero(np.diff(places) > 1) + 1
    text, where = np.insert(ids[places], gaps, 0), np.insert(places, gaps, -1)
    order = suffix_array(text, deep)
    order = order[text[order] > 0]
    padded = np.concatenate([text, np.zeros(deep, np.int64)])
    for n, (windows, holders) in tests.windows.items():
        low, high = bounds(windows, order, padded, n, False), bounds(windows, order, padded, n, True)
        for w in np.flatnonzero(high > low).tolist():
            yield n, holders[w], where[order[low[w] : high[w]]], starts


def covered(shard: list[list[bytes]], tests: Tests) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """For each document of the shard: the stretches (first word, words) that windows cover, and the ids of the items that hold one of them. Each place and each holder of a window is looked at once, never their pairs."""
    hit = np.zeros(sum(len(ws) + 1 for ws in shard) + 1, np.int64)
    names: list[set[str]] = [set() for _ in shard]
    starts = np.cumsum([0] + [len(ws) + 1 for ws in shard])
    for n, holders, found, _ in occurrences(shard, tests):
        np.add.at(hit, found, 1)
        np.add.at(hit, found + n, -1)
        held = {tests.names[k] for k, _ in holders} - {None}
        for d in np.unique(np.searchsorted(starts, found, "right") - 1).tolist():
            names[d] |= held
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8), [0]])))
    spans: list[list[tuple[int, int]]] = [[] for _ in shard]
    for a, b in edges.reshape(-1, 2).tolist():
        d = int(np.searchsorted(starts, a, "right")) - 1
        spans[d].append((a - int(starts[d]), b - a))
    return [(x, sorted(y)) for x, y in zip(spans, names, strict=True)]


def matches(shard: list[list[bytes]], tests: Tests) -> list[list[tuple[int, int, int, int]]]:
    """For each document of the shard: (item, its word, document word, words) of the longest verbatim matches that hold a window."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in shard]
    hits: dict[tuple[int, int, int], list[int]] = defaultdict(list)
    for _, holders, found, starts in occurrences(shard, tests):
        for at in found.tolist():
            d = int(np.searchsorted(starts, at, "right")) - 1
            for k, i in holders:
                hits[d, k, int(at - starts[d]) - i].append(i)
    for (d, k, shift), found in hits.items():
        n = tests.size[k]
        found.sort()
        begin = found[0]
        for i, j in zip(found, [*found[1:], None], strict=True):
            if j is None or j > i + 1:
                out[d].append((k, begin, begin + shift, i - begin + n))
                begin = j if j is not None else 0
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items, in blocks of bounded size."""
    block, held = [], 0
    for item, text in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        if block and held + len(text or "") > most:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += len(text or "")
    if block:
        yield block


MATCHES = "array<struct<item:string,item_word:long,doc_word:long,n_words:long>>"


SPANS = "array<struct<doc_word:long,n_words:long>>"


def scanned(docs: DataFrame, benchmark: DataFrame, columns: dict[str, str], found: Callable[[list[list[bytes]], Tests], list[dict]], id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, block_bytes: int) -> DataFrame:
    """id, n_words and the columns, arrays of what `found` tells of each document of a shard; those of several blocks of the benchmark are put together."""
    kind, context = docs.schema[id_col].dataType.simpleString(), docs.sparkSession.sparkContext
    schema = "".join(f", {c} {t}" for c, t in columns.items())

    def scan(rows_in: DataFrame, block: list[tuple[str | None, str | None]]) -> DataFrame:
        sent = context.broadcast(Tests(block, window))  # at most block_bytes of text
        kinds = {c: to_arrow_type(T.StructType.fromDDL(f"x {t}")[0].dataType) for c, t in columns.items()}

        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, told = [], []
            for shard in shards(batch.column(1).to_pylist()):
                sizes += [len(x) for x in shard]
                told += found(shard, sent.value)
            return pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), *[pa.array([x[c] for x in told], t) for c, t in kinds.items()], *batch.columns[2:]], names=[id_col, "n_words", *kinds, *["tidemark_row"] * (batch.num_columns - 2)])

        return map_batches(rows_in, rows, f"`{id_col}` {kind}, n_words long{schema}" + ", tidemark_row long" * (len(rows_in.columns) - 2))

    told, docs = blocks(benchmark, item_col, item_text_col, block_bytes), docs.select(id_col, text_col)
    first, second = next(told, []), next(told, None)
    if second is None:
        return scan(docs, first)
    # Several blocks: each row has a number that is written before the scans.
    numbered = written(docs.withColumn("tidemark_row", F.monotonically_increasing_id()), "numbered")
    every = reduce(DataFrame.unionAll, [scan(numbered, block) for block in chain([first, second], told)])
    return every.groupBy("tidemark_row").agg(F.first(id_col).alias(id_col), F.max("n_words").alias("n_words"), *[F.flatten(F.collect_list(c)).alias(c) for c in columns]).drop("tidemark_row")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_words and matches, the longest verbatim matches with benchmark items that hold a whole window: a row for each item and place, so items times repeats where both repeat. `contamination` tells less, and is linear."""

    def found(shard: list[list[bytes]], tests: Tests) -> list[dict]:
        return [{"matches": [{"item": tests.names[k], "item_word": i, "doc_word": at, "n_words": n} for k, i, at, n in sorted(x)]} for x in matches(shard, tests)]

    return scanned(docs, benchmark.where(F.col(item_col).isNotNull()), {"matches": MATCHES}, found, id_col, text_col, item_col, item_text_col, window, block_bytes)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_words, spans (the stretches of words that windows cover) and items (the distinct ids of items with such windows, as strings in order)."""

    def found(shard: list[list[bytes]], tests: Tests) -> list[dict]:
        return [{"spans": [{"doc_word": a, "n_words": n} for a, n in spans], "items": items} for spans, items in covered(shard, tests)]

    told = scanned(docs, benchmark, {"spans": SPANS, "items": "array<string>"}, found, id_col, text_col, item_col, item_text_col, window, block_bytes)
    return told.withColumn("items", F.array_sort(F.array_distinct("items")))


def covered_words(matches: Column) -> Column:
    """Words that lie in any match."""
    spans = F.sort_array(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(spans, start, lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"), F.greatest(s["b"], acc["end"]).alias("end")), lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the documents that hold a window of the benchmark.

    One block needs no shuffle: the matches are found beside the row. Several blocks remove one after the other.
    """
    context, fields = docs.sparkSession.sparkContext, docs.schema
    for block in blocks(benchmark, item_col, item_text_col, block_bytes):
        sent = context.broadcast(Tests(block, window))

        def rows(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            found = [x for shard in shards(batch.column(fields.names.index(text_col)).to_pylist()) for x, _ in covered(shard, sent.value)]
            return batch.filter(pa.array([not x for x in found], pa.bool_()))

        docs = map_batches(docs, rows, fields)
    return docs


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    told = found.select("doc_id", "n_words", covered_words(F.col("spans")).alias("n_hit"), "items")
    return told.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
