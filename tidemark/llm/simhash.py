"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are one node.  Two fingerprints within the radius r agree on n - r of any
n blocks of their bits, so nodes meet in buckets of such block combinations; nothing is
lost.  A bucket is compared in tiles with numpy exclusive-or and bit counts; a pair of
tiles whose population counts differ by more than the radius is skipped.  Buckets of more
nodes than a tile holds are dealt out as pairs of tiles, so none falls to one task.  Each
comparison returns the links of a spanning forest, which connect what all links connect.

For a Jaccard similarity instead of a radius, wide fingerprints of the sets of shingles only
find candidates: sets that share a MinHash band and lie within a generous radius. Members of a
component of candidates are then compared with each other on their true sets, and only pairs
that reach the similarity are links.

Defined results: a null or empty text has the fingerprint zero and links like any other;
rows of equal ids are one document for linking and keep their own rows; null ids get
fingerprints, and the smallest id of a component ignores them; an empty table gives an empty
result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_batches
from tidemark.llm.components import components
from tidemark.llm.shared import written

SEED = 42
#: Fingerprints of a bucket that one task compares; of larger buckets, about so many a tile.
TILE = 4096
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Lanes of the fingerprints that stand for a similarity rather than for a radius.
WIDE = 4
#: Odd multipliers of the MinHash values of a set, and the most that a pair at the similarity may miss all bands by chance.
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 64, 288, np.uint64) | np.uint64(1)
MISSED = 1e-6
#: Sets of a component of candidates that are compared in one unit; a larger component is dealt out as pairs of such parts.
PART = 128
#: Bits of the bitmap of candidates at most, eight megabytes; beyond that more texts pass it than need to.
SLOTS = 1 << 26


def shingles(text: str | None, width: int) -> list[bytes]:
    """The space-joined shingles of the words of a text, A-Z lowered; of fewer words the whole sequence, of none nothing."""
    words = (text or "").encode().lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False)))


def fingerprint(text: str | None, width: int) -> list[int]:
    """64 counted XXH64 bits, as a long in a list."""
    told = shingles(text, width)
    if not told:
        return [0]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(told), CHUNK):
        part = told[i : i + CHUNK]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part)).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(told), bitorder="little").view(np.int64).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """id and fp, an array of one long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=[id_col, "fp"])

    return map_batches(docs.select(id_col, text_col), rows, f"`{id_col}` {kind}, fp array<long>")


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The 64-bit hashes of the distinct shingles, sorted."""
    told = shingles(text, width)
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, told), np.uint64, len(told)))


def set_digest(told: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(told.tobytes()), "little", signed=True)


def wide_fingerprint(told: np.ndarray, lanes: int) -> list[int]:
    """64 counted bits a lane of a set of hashes, as longs; each lane mixes the hashes anew."""
    counts = np.zeros(64 * lanes, np.int64)
    for i in range(0, len(told), CHUNK):
        mixed = told[i : i + CHUNK, None] + np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(told), bitorder="little").view(np.int64).tolist()


def band_width(similarity: float) -> tuple[int, int]:
    """MinHash values a band and bands, such that a pair at the similarity shares one of the bands but for a chance of MISSED: as wide as five eighths of the multipliers allow, since every band costs a key that travels."""
    for r in range(16, 0, -1):
        bands = math.ceil(math.log(MISSED) / math.log1p(-(similarity**r)))
        if bands * r <= len(MULTIPLIERS) * 5 // 8:
            return r, bands
    return 1, len(MULTIPLIERS)


def band_keys(told: np.ndarray, width: int, bands: int) -> list[int]:
    """A key for every `width` MinHash values of a set of hashes; an empty set has none. The band is part of its key."""
    if not len(told):
        return []
    used = MULTIPLIERS[: bands * width]
    least = np.min([(told[i : i + 256, None] * used).min(axis=0) for i in range(0, len(told), 256)], axis=0).reshape(bands, width)
    return [int.from_bytes(xxhash.xxh3_64_digest(row.tobytes(), seed=k), "little", signed=True) for k, row in enumerate(least)]


def blocks_for(nodes: int, radius: int) -> int:
    """Blocks of the 64 bits such that a bucket of n - r of them has about 16 nodes or fewer if bits are even."""
    n = radius + 1
    while 64 * (n - radius) // n < np.log2(max(nodes, 2)) - 4 and n < 16:
        n += 1
    return n


def masks(n: int, radius: int) -> list[int]:
    edges = [round(64 * i / n) for i in range(n + 1)]
    whole = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(whole[i] for i in kept) for kept in combinations(range(n), n - radius)]


def exact_keys(n_nodes: int, radius: int) -> list[Column]:
    """(c, key) of one-lane fingerprints: any two within the radius share a key."""
    return [F.struct(F.lit(c).cast("int").alias("c"), F.col("fp")[0].bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for c, m in enumerate(masks(blocks_for(n_nodes, radius), radius))]


def forest(fps: np.ndarray, radius: int, other: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Index pairs that connect what lies within the radius in fps (rows of lanes), or across fps and other (its indices follow), tile by tile in order of bit counts."""
    every = fps if other is None else np.concatenate([fps, other])
    bits = np.bitwise_count(every).sum(axis=1, dtype=np.int64)
    label = np.arange(len(every))
    sides = [np.argsort(bits[: len(fps)], kind="stable")]
    sides.append(sides[0] if other is None else len(fps) + np.argsort(bits[len(fps) :], kind="stable"))
    tiles = [[side[i : i + 128] for i in range(0, len(side), 128)] for side in sides]
    for x, a in enumerate(tiles[0]):
        for b in tiles[1][x:] if other is None else tiles[1]:
            if bits[b[0]] - bits[a[-1]] > radius:
                break
            if bits[a[0]] - bits[b[-1]] > radius:
                continue
            apart = sum(np.bitwise_count(every[a, lane][:, None] ^ every[b, lane][None, :]).astype(np.int16) for lane in range(every.shape[1]))
            near = apart <= radius
            # Pairs that are connected already are passed over at once, however many they are.
            while (news := near & (label[a][:, None] != label[b][None, :])).any():
                i, j = divmod(int(news.argmax()), len(b))
                p, q = sorted((label[a[i]], label[b[j]]))
                label[label == q] = p
                yield int(a[i]), int(b[j])


def marks(rows: DataFrame, value: Column, n: int) -> np.ndarray:
    """A bitmap of the n values of rows, long and evenly spread, by their rest: 16 bits a value and SLOTS bits at most, so it never grows beyond that; values that share a bit pass for each other."""
    slots = min(SLOTS, max(64, 1 << (16 * max(n, 1) - 1).bit_length()))
    words = rows.select(F.pmod(value, F.lit(slots)).alias("s")).groupBy(F.floor(F.col("s") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 AS int))")).alias("bits")).toArrow()
    out = np.zeros(slots // 64, np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out


def marked(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which of the slots are set."""
    return (bitmap[slots // 64] >> (slots % 64)) & 1 == 1


def links(nodes: DataFrame, keys: list[Column], radius: int) -> DataFrame:
    """(a, b): links that connect all nodes (fp of one lane, node) that share a key and whose fingerprints differ in at most `radius` bits."""
    keyed = nodes.select(F.col("fp")[0].alias("f0"), "node", F.bit_count(F.col("fp")[0]).alias("bits"), F.explode(F.array(*keys)).alias("k")).select("f0", "node", "bits", "k.c", "k.key")
    sizes = keyed.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
    return compared(keyed.join(sizes, ["c", "key"]), radius, 1)


def band_links(nodes: DataFrame, radius: int, lanes: int) -> DataFrame:
    """(a, b): links that connect all nodes (fp, keys, node) that share a key of a band and whose fingerprints differ in at most `radius` bits.

    Keys are counted first, and a bitmap of bounded size of those that meet tells the nodes which of their keys to send at all.
    """
    met = written(nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    sent = nodes.sparkSession.sparkContext.broadcast(marks(met, F.col("key"), met.count()))

    def passing(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        keys = lists.flatten().to_numpy(zero_copy_only=False)
        nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        kept = marked(sent.value, keys % (64 * len(sent.value)))
        return pa.record_batch([pa.array(nodes[kept], pa.int64()), pa.array(keys[kept], pa.int64())], names=["node", "key"])

    keyed = map_batches(nodes.select("node", "keys"), passing, "node long, key long")
    bits = sum((F.bit_count(F.col("fp")[i]) for i in range(lanes)), F.lit(0))
    fps = nodes.select("node", bits.alias("bits"), *[F.col("fp")[i].alias(f"f{i}") for i in range(lanes)])
    return compared(keyed.join(met, "key").join(fps, "node").withColumn("c", F.lit(0)), radius, lanes)


def compared(met: DataFrame, radius: int, lanes: int) -> DataFrame:
    """(a, b) of the rows (c, key, n, node, bits, f0...) of the buckets (c, key) of n nodes."""
    names = [f"f{i}" for i in range(lanes)]
    # A large bucket's tiles: ranges of bit counts as wide as the radius, so that links reach the next range at most, in `parts` shares each.
    cut = met.where(F.col("n") > TILE).withColumns({"parts": F.ceil(F.col("n") / F.lit(TILE)).cast("int"), "range": F.floor(F.col("bits") / (radius + 1)).cast("int")})
    mine = F.col("range") * F.col("parts") + F.pmod(F.xxhash64(*names), F.col("parts")).cast("int")
    span = F.sequence((F.col("range") - 1) * F.col("parts"), (F.col("range") + 2) * F.col("parts") - 1)
    dealt = cut.select("c", "key", *names, "node", mine.alias("mine"), F.explode(span).alias("theirs"))
    large = dealt.select("c", "key", F.least("mine", "theirs").alias("t"), F.greatest("mine", "theirs").alias("u"), (F.col("mine") > F.col("theirs")).alias("side"), "node", *names)
    small = met.where(F.col("n") <= TILE).select("c", "key", F.lit(-1).alias("t"), F.lit(-1).alias("u"), F.lit(False).alias("side"), "node", *names)
    unit = ["c", "key", "t", "u"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units come sorted; rows of the unit that is still open wait for the next batch."""
        rest: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6 + lanes)]
            now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            starts = np.concatenate([[0], 1 + np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in now[:4]]))])
            last = int(starts[-1])
            rest = [x[last:] for x in now]
            if last and (out := made([x[:last] for x in now], starts[:-1])):
                yield out
        if rest is not None and len(rest[0]) and (out := made(rest, np.array([0]))):
            yield out

    def made(rows: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch | None:
        t, u, side, nodes, fps = rows[2], rows[3], rows[4], rows[5], np.stack([x.view(np.uint64) for x in rows[6:]], axis=1)
        sizes = np.diff(np.append(starts, len(fps)))
        pairs = starts[(sizes == 2) & (t[starts] < 0)]
        near = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]).sum(axis=1, dtype=np.int64) <= radius]
        found: list[tuple[int, int]] = [(i, i + 1) for i in near.tolist()]
        for i, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            if n < 2 or n == 2 and t[i] < 0:
                continue
            if t[i] == u[i]:
                found += [(i + p, i + q) for p, q in forest(fps[i : i + n], radius)]
                continue
            ours, theirs = i + np.flatnonzero(~side[i : i + n]), i + np.flatnonzero(side[i : i + n])
            if len(ours) and len(theirs):
                at = np.concatenate([ours, theirs])
                found += [(at[p], at[q]) for p, q in forest(fps[ours], radius, fps[theirs])]
        if not found:
            return None
        a, b = np.array(found).T
        return pa.record_batch([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

    return small.union(large).repartition(*unit).sortWithinPartitions(*unit).mapInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """id (a long), fp and component_id, the smallest id that links reach; every link within the radius counts."""
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min(id_col).alias("node")), "nodes")
    near = links(nodes.where("node is not null"), exact_keys(nodes.count(), radius), radius)
    # Rows of one id with different fingerprints are one document.
    several = fps.groupBy(id_col).agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where(F.col(id_col).isNotNull() & (F.col("least") != F.col("most"))).select(id_col)
    same = fps.join(several, id_col).join(nodes, "fp").select(F.col("node").cast("long").alias("a"), F.col(id_col).cast("long").alias("b"))
    labels = components(near.union(same))
    known = nodes.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(known, "fp", "left").select(id_col, "fp", "component_id")


def bits_apart(similarity: float, lanes: int) -> int:
    """Bits in which fingerprints of that Jaccard similarity differ on average, and eight standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(64 * lanes * p + 8 * math.sqrt(64 * lanes * p * (1 - p)))


def near_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets (of distinct values) reach the Jaccard similarity."""
    sizes = np.array([len(x) for x in sets])
    place, owner = np.unique(np.concatenate(sets), return_inverse=True)[1], np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(place) > 1
    kept = shared[place]
    column, row = (np.cumsum(shared) - 1)[place[kept]], owner[kept]
    order = np.argsort(column, kind="stable")
    column, row, common = column[order], row[order], np.zeros((len(sets), len(sets)))
    for at in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(column, [at, at + 4096])
        held = np.zeros((len(sets), 4096), np.float32)
        held[row[i:j], column[i:j] - at] = 1
        common += held @ held.T
    return common / np.maximum(sizes[:, None] + sizes[None, :] - common, 1) >= similarity


def spanning(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Index pairs of a symmetric matrix that connect what it connects."""
    label = np.arange(len(near))
    for i in range(len(near)):
        while (news := near[i] & (label != label[i])).any():
            j = int(news.argmax())
            label[label == label[j]] = label[i]
            yield i, j


def verified(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """(a, b): links that connect all sets of shingles of one component whose similarity is reached. members: digest, node (the id of a document with that set) and component; docs have ids.

    Texts stay where they are: a bitmap of bounded size tells which of them can be members, and only the sets of those travel.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts"))
    n = members.count()
    sent = docs.sparkSession.sparkContext.broadcast(marks(members, F.xxhash64("node"), n))
    slot = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(64 * len(sent.value)))

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(marked(sent.value, batch.column(2).to_numpy())))
        sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(map(set_digest, sets), pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "digest", "told"])

    found = map_batches(docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col), slot.alias("slot")), told, "node long, digest long, told array<long>")
    # Other texts of an id have another digest.
    known = written(members.join(sizes, "component"), "members")
    sets = found.join(known, ["node", "digest"])
    mine = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")
    dealt = sets.withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("parts = 1 or mine != theirs")
    unit = ["component", "t", "u"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units come sorted; one is held at a time."""
        held: dict[int, tuple[int, np.ndarray]] = {}
        open_unit = None
        for batch in batches:
            values, ends = batch.column(5).values.to_numpy().view(np.uint64), batch.column(5).offsets.to_numpy()
            for i, (*now, digest, node) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True)):
                if now != open_unit:
                    yield from ended(held)
                    held, open_unit = {}, now
                held[digest] = node, values[ends[i] : ends[i + 1]].copy()
        yield from ended(held)

    def ended(held: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1 and (found := list(spanning(near_sets([x for _, x in held.values()], similarity)))):
            nodes = [node for node, _ in held.values()]
            yield pa.record_batch([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], names=["a", "b"])

    units = dealt.select("component", F.least("mine", "theirs").alias("t"), F.greatest("mine", "theirs").alias("u"), "digest", "node", "told")
    return units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(compare, "a long, b long")


def similar_components(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, lanes: int) -> DataFrame:
    """id and component_id, the smallest id that links reach; docs have ids, which are longs. Every link is a pair of shingle sets whose similarity was computed."""
    kind, (width_, bands) = docs.schema[id_col].dataType.simpleString(), band_width(similarity)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
        longs = pa.list_(pa.int64())
        return pa.record_batch([batch.column(0), pa.array(map(set_digest, sets), pa.int64()), pa.array([wide_fingerprint(x, lanes) for x in sets], longs), pa.array([band_keys(x, width_, bands) for x in sets], longs)], names=[id_col, "digest", "fp", "keys"])

    prints = written(map_batches(docs.select(id_col, text_col), rows, f"`{id_col}` {kind}, digest long, fp array<long>, keys array<long>"), "fingerprints")
    # Equal sets are one node, and the document of the smallest id shows its set.
    nodes = written(prints.groupBy("digest").agg(F.min(id_col).cast("long").alias("node"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    ids = nodes.select("digest", "node")
    loose = components(band_links(nodes.select("fp", "keys", F.col("digest").alias("node")), bits_apart(similarity, lanes), lanes))
    near = verified(docs, loose.select(F.col("node").alias("digest"), "component").join(ids, "digest"), id_col, text_col, width, similarity)
    # Rows of one id with different texts are one document.
    several = prints.groupBy(id_col).agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least != most").select(id_col)
    same = prints.join(several, id_col).join(ids, "digest").select(F.col("node").alias("a"), F.col(id_col).cast("long").alias("b"))
    labels = components(near.union(same))
    known = ids.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return prints.select(id_col, "digest").join(known, "digest").select(id_col, "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, lanes: int = WIDE) -> DataFrame:
    """docs with one document of each near-duplicate component: that of the smallest id; of repeated rows of an id one stays. Rows without an id stay."""
    found = written(similar_components(docs.where(F.col(id_col).isNotNull()), id_col, text_col, width, similarity, lanes), "groups")
    # Written, so that Spark knows its size: below its own threshold the ids come to the texts, else the texts move once.
    gone = written(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "gone")
    left = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    if found.groupBy(id_col).count().where("count > 1").isEmpty():
        return left
    return left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(left.where(F.col(id_col).isNull()))


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")
