"""Merkle manifest of a dataset: trees of SHA-256 digests with proofs, and folding of changed leaves.

A leaf digests the fields of one row. The leaves of a tree ascend by id; every `FANOUT`
consecutive nodes become their parent until one is left, the tree's root; the roots of all
trees, in the order of their keys, become the root of the dataset in the same way.

Trees are built in blocks of at most FANOUT ** STAGE nodes, one group of bounded size each, stage
by stage, so that no task holds a tree. A parent keeps the hash state before each of its child slots;
a changed child is folded by resuming that state with the replacement and the siblings
right of it, and nothing left of it is hashed again. Of the stages above, a block gets one path, whose states are made once
and resumed for each of its leaves.

Defined results: null fields are written as `-`; rows without a key form a tree, which comes first; rows
without an id come first in their tree and are never tampered with; rows of equal ids are ordered by their leaves, and equal rows have leaves,
places and proofs of their own; an empty table gives an empty manifest; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_batches
from tidemark.llm.shared import written

FANOUT = 8
#: Levels that one block of nodes climbs at once: 4096 nodes a block.
STAGE = 4
#: Siblings before and after a node, level by level.
PATH = "array<struct<before:binary,after:binary>>"


class Parent:
    """A node over its children's digests, with the hash state that stood before each of them."""

    def __init__(self, children: Sequence[bytes]):
        self.children = children
        self.states, state = [], hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def siblings(self, slot: int) -> tuple[bytes, bytes]:
        return b"".join(self.children[:slot]), b"".join(self.children[slot + 1 :])

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in that slot."""
        return resumed(self.states[slot], child, b"".join(self.children[slot + 1 :]))


def resumed(state, child: bytes, after: bytes) -> bytes:
    state = state.copy()
    state.update(child + after)
    return state.hexdigest().encode()


def height(n: int) -> int:
    """Levels between n nodes and the one that remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def parents(digests: Sequence[bytes], levels: int) -> list[list[Parent]]:
    """The parents of each level over the nodes of a block."""
    out: list[list[Parent]] = []
    for _ in range(levels):
        out.append([Parent(digests[i : i + FANOUT]) for i in range(0, len(digests), FANOUT)])
        digests = [p.digest for p in out[-1]]
    return out


def climb(built: list[list[Parent]], at: int) -> Iterator[tuple[Parent, int]]:
    """The parents of node `at` of a block and its slot in each."""
    for level in built:
        yield level[at // FANOUT], at % FANOUT
        at //= FANOUT


def written_field(value) -> bytes:
    if value is None:
        return b"-"
    told = value if isinstance(value, bytes) else str(value).encode()
    return b"%d:%b" % (len(told), told)


def leaf(values: Sequence) -> bytes:
    return hashlib.sha256(b"".join(map(written_field, values))).hexdigest().encode()


def every_third(key) -> bool:
    """Whether 3 divides the crc32 of the decimal id."""
    return key is not None and zlib.crc32(str(key).encode()) % 3 == 0


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lowered(text: str | None) -> bytes | None:
    return None if text is None else text.encode().translate(LOWER)


def leaves(docs: DataFrame, id_col: str, tree_col: str, fields: Sequence[str], tampered: Callable[[Sequence], Sequence | None] | None) -> DataFrame:
    """id, key, leaf and changed: the leaf of the values that `tampered` gives for a row's values, null where it gives none."""
    kinds = docs.select(F.col(id_col).alias("id"), F.col(tree_col).alias("key")).schema

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = list(zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True))
        other = [tampered(v) if tampered else None for v in told]
        digests = [leaf(v) for v in told], [None if v is None else leaf(v) for v in other]
        return pa.record_batch([batch.column(0), batch.column(1), *[pa.array(d, pa.binary()) for d in digests]], names=["id", "key", "leaf", "changed"])

    given = docs.select(F.col(id_col).alias("id"), F.col(tree_col).alias("key"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])
    return map_batches(given, rows, f"id {kinds['id'].dataType.simpleString()}, key {kinds['key'].dataType.simpleString()}, leaf binary, changed binary")


def placed(df: DataFrame, group: str | None, order: Sequence[Column]) -> DataFrame:
    """df with `at`, its place in that order within its group, from zero, and `n`, the group's size. Rows are dealt out by ranges of the order, so a group of any size spreads; equal rows spread by number."""
    dealt = df.withColumn("deal", F.monotonically_increasing_id())
    order = [*order, F.xxhash64("deal")]
    sort = written(dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("deal").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i")), "sorted")
    of = F.col(group) if group else F.lit(0)
    parts = sort.groupBy("part", of.alias("g")).agg(F.count("*").alias("size"), F.min("i").alias("first"))
    whole = Window.partitionBy("g")
    starts = parts.select(F.col("part").alias("p"), "g", "first", (F.sum("size").over(whole.orderBy("part")) - F.col("size")).alias("start"), F.sum("size").over(whole).alias("n"))
    met = sort.join(starts, (F.col("part") == F.col("p")) & of.eqNullSafe(F.col("g")))
    return met.select(*df.columns, (F.col("start") + F.col("i") - F.col("first")).alias("at"), "n")


def block_of(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / FANOUT**STAGE).cast("long"))


def built(table: pa.Table, digest: str) -> tuple[pa.Table, list[list[Parent]]]:
    """The rows of a block in order, and its levels."""
    table = table.sort_by("at")
    return table, parts_of(table.column(digest).to_pylist(), table.column("n")[0].as_py())


def parts_of(digests: list[bytes], n: int) -> list[list[Parent]]:
    return parents(digests, min(STAGE, height(n)))


def stages(nodes: DataFrame) -> list[DataFrame]:
    """Tables (tree, at, n, digest) of the nodes between which blocks climb: the given ones, the tops of their blocks, and so on to the roots. Tables are written once."""

    def top(table: pa.Table) -> pa.Table:
        table, levels = built(table, "digest")
        digest = levels[-1][0].digest if levels else table.column("digest")[0].as_py()
        n = -(-table.column("n")[0].as_py() // FANOUT**STAGE)
        return pa.table({"tree": table.column("tree")[:1], "at": table.column("block")[:1], "n": pa.array([n], pa.int64()), "digest": pa.array([digest], pa.binary())})

    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(written(block_of(out[-1]).groupBy("tree", "block").applyInArrow(top, "tree long, at long, n long, digest binary"), "nodes"))
    return out


def paths(tables: list[DataFrame], above: DataFrame | None) -> DataFrame | None:
    """(tree, at, path) of the first of the stages: the siblings up to the tree's root, and those that `above` (tree, path) gives for the root itself."""
    if above is not None:
        above = above.withColumn("at", F.lit(0).cast("long"))
    for nodes in reversed(tables[:-1]):
        above = written(with_path(nodes, above).groupBy("tree", "block").applyInArrow(siblings, f"tree long, at long, path {PATH}"), "paths")
    return above


def with_path(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """nodes with `block` and `path`, the path of their block's top."""
    if above is None:
        return block_of(nodes).withColumn("path", F.array().cast(PATH))
    return block_of(nodes).join(above.withColumnRenamed("at", "block"), ["tree", "block"])


def siblings(table: pa.Table) -> pa.Table:
    table, levels = built(table, "digest")
    rest = table.column("path")[0].as_py()
    told = [[*({"before": b, "after": a} for b, a in (p.siblings(slot) for p, slot in climb(levels, i))), *rest] for i in range(table.num_rows)]
    kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
    return pa.table([table.column("tree"), table.column("at"), pa.array(told, kind)], names=["tree", "at", "path"])


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Callable[[Sequence], Sequence | None] | None = None) -> DataFrame:
    """A row for each row of docs: id, key of its tree, leaf, subroot, root, proof_sha256 (of the siblings up to the root), folded_root (of the tampered leaf, else of the leaf) and verified. `tampered` takes the values of the fields, and gives others or none."""
    made = written(leaves(docs, id_col, tree_col, fields, tampered), "leaves")
    nodes = placed(made, "key", [F.col("key"), F.col("id"), F.col("leaf")])
    keys = written(placed(made.select("key").distinct(), None, [F.col("key")]).select(F.col("key").alias("k"), F.col("at").alias("tree")), "keys")
    nodes = written(nodes.join(keys, F.col("key").eqNullSafe(F.col("k"))).drop("k"), "leaves")

    trees = stages(nodes.select("tree", "at", "n", F.col("leaf").alias("digest")))
    subroots = trees[-1].select("tree", F.col("digest").alias("subroot"))
    crown = trees[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(keys.count()).cast("long").alias("n"), "digest")
    tops = stages(crown)
    crown_paths = paths(tops, None)
    above = trees[-1].select("tree", F.array().cast(PATH).alias("path")) if crown_paths is None else crown_paths.select(F.col("at").alias("tree"), "path")
    above = paths(trees[1:], above).join(subroots, "tree")

    def folded(table: pa.Table) -> pa.Table:
        table, levels = built(table, "leaf")
        rest = [(hashlib.sha256(p["before"]), p["before"], p["after"]) for p in table.column("path")[0].as_py()]
        told, other = table.column("leaf").to_pylist(), table.column("changed").to_pylist()
        proofs, roots = [], []
        for i in range(len(told)):
            now, proof = told[i] if other[i] is None else other[i], hashlib.sha256()
            for parent, slot in climb(levels, i):
                proof.update(b"".join(parent.siblings(slot)))
                now = parent.fold(slot, now)
            for state, before, after in rest:
                proof.update(before + after)
                now = resumed(state, now, after)
            proofs.append(proof.hexdigest())
            roots.append(now)
        return pa.table([*[table.column(c) for c in ("id", "key", "leaf", "subroot")], pa.array(proofs, pa.string()), pa.array(roots, pa.binary())], names=["id", "key", "leaf", "subroot", "proof_sha256", "folded"])

    kinds = made.schema
    out = with_path(nodes, above).groupBy("tree", "block").applyInArrow(folded, f"id {kinds['id'].dataType.simpleString()}, key {kinds['key'].dataType.simpleString()}, leaf binary, subroot binary, proof_sha256 string, folded binary")
    root = tops[-1].agg(F.max("digest")).first()[0]
    hexed = [F.col(c).cast("string").alias(c) for c in ("leaf", "subroot")]
    out = out.select("id", "key", *hexed, F.lit(None if root is None else bytes(root).decode()).cast("string").alias("root"), "proof_sha256", F.col("folded").cast("string").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_case_thirds(values: Sequence) -> Sequence | None:
    """The values (id first, text last) with a lower-case text, for every third id."""
    return [*values[:-1], lowered(values[-1])] if every_third(values[0]) else None


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    told = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), tampered=lower_case_thirds)
    return told.withColumnRenamed("id", "doc_id").drop("key")
