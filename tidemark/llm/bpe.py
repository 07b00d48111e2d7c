"""Byte-level BPE encoding and decoding with the vocabulary file of a public tokenizer.

The merges of one word run on a segment tree: a leaf holds the rank of the pair that starts
at its position, the root the lowest rank and of equal ranks the leftmost.  A merge takes
the root, writes three leaves and mends their paths, so a word of n bytes takes O(n log n).
Words repeat, so each Python worker keeps the tokens of words it has seen, up to a bound.

Defined results: a null text is an empty text and has no tokens; an empty table gives an
empty result; repeated rows are encoded row by row; columns other than the id and the text
are ignored.  Special tokens written out in a text are encoded as such.  Ids that are not in
the vocabulary are refused by decode; a null list of ids has an empty text.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import map_batches

#: Words of one generation whose tokens a worker keeps, two generations at most. It bounds memory only.
KEPT_WORDS = 400_000
#: Longer words are not kept.
KEPT_CHARS = 64
FREE = 1 << 60
#: A handful of pairs.
FEW = 4
#: Bits of a token in a pair.
SHIFT = 20

#: Fixed value: the public split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def merged(tokens: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """tokens after all merges, lowest rank first and leftmost among equals.

    ranks: of a pair, as left << SHIFT | right; made: the token that the merge of a rank makes.
    The tree is one list: node k has the children 2k and 2k + 1 and holds the least of them, and leaf m + i
    holds rank * m + i of the pair of the token at i and the one after it, so the root is the leftmost of the lowest.
    A word of no more than FEW pairs has its ranks in the root alone.
    """
    n, get = len(tokens), ranks.get
    found = [get(a << SHIFT | b, FREE) for a, b in zip(tokens, tokens[1:])]  # noqa: B905
    if n <= FEW + 1:
        return merged_in_root(tokens, found, get, made)
    m = 1 << (n - 2).bit_length()
    tree = [FREE] * m + [rank * m + i if rank != FREE else FREE for i, rank in enumerate(found)] + [FREE] * (m - n + 1)
    for k in range(m - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (best := tree[1]) != FREE:
        rank, i = divmod(best, m)
        gone = after[i]
        j = after[i] = after[gone]
        token = tokens[i] = made[rank]
        tokens[gone] = -1
        tree[m + i], changed = FREE, [i]
        if j < n:
            # The last token starts no pair, so only here does the one that went have a leaf.
            before[j], tree[m + gone] = i, FREE
            changed.append(gone)
            if (rank := get(token << SHIFT | tokens[j])) is not None:
                tree[m + i] = rank * m + i
        if (p := before[i]) >= 0:
            tree[m + p] = FREE if (rank := get(tokens[p] << SHIFT | token)) is None else rank * m + p
            changed.append(p)
        for k in changed:
            k += m
            while k > 1:
                a, b = tree[k], tree[k ^ 1]
                k >>= 1
                if b < a:
                    a = b
                if tree[k] == a:
                    break
                tree[k] = a
    return [t for t in tokens if t >= 0]


def merged_in_root(tokens: list[int], found: list[int], get: Callable, made: list[int]) -> list[int]:
    """The same for a few pairs, which close up when one goes; of equal ranks the first is the leftmost."""
    while found and (rank := min(found)) != FREE:
        i = found.index(rank)
        token = tokens[i] = made[rank]
        del tokens[i + 1], found[i]
        if i < len(found):
            found[i] = get(token << SHIFT | tokens[i + 1], FREE)
        if i:
            found[i - 1] = get(tokens[i - 1] << SHIFT | token, FREE)
    return tokens


class Bpe:
    """A vocabulary with its merges, read from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, names = told["model"], byte_names()
        vocab = model["vocab"]
        self.of_byte = [0] * 256
        for name, byte in names.items():
            self.of_byte[byte] = vocab[name]
        self.bytes_of = {i: bytes(names[c] for c in token) for token, i in vocab.items()}
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[left] << SHIFT | vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """The tokens of one word as native 32-bit integers. Words seen since the generation before last are kept."""
        if (found := self.kept.get(word)) is None:
            if (found := self.older.get(word)) is None:
                found = array("i", merged([self.of_byte[b] for b in word.encode()], self.ranks, self.made)).tobytes()
            if len(word) <= KEPT_CHARS:
                if len(self.kept) >= KEPT_WORDS:
                    self.older, self.kept = self.kept, {}
                self.kept[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if self.at_special is None or not self.at_special.search(text):
            return b"".join(map(self.word, self.words.findall(text)))
        return b"".join(array("i", [self.special[part]]).tobytes() if part in self.special else b"".join(map(self.word, self.words.findall(part))) for part in self.at_special.split(text))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@cache
def bpe(path: str) -> Bpe:
    """One a worker process and file."""
    return Bpe(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int); path: the vocabulary file, which every executor reads."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [bpe(path).encode(text or "") for text in batch.column(1).to_pylist()]
        starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32), pa.int32())
        return pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)], names=[id_col, "ids"])

    return map_batches(docs.select(id_col, text_col), rows, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, ids and the text that the ids spell; invalid UTF-8 becomes U+FFFD."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        # Slices of one list of plain integers; to_pylist would make an Arrow scalar of every id.
        ids = lists.flatten().to_numpy(zero_copy_only=False).tolist()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()
        texts = [bpe(path).decode(ids[start:end]) for start, end in zip([0, *ends], ends)]  # noqa: B905
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

    return map_batches(encoded.select(id_col, "ids"), rows, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digests(decoded: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, what is kept of the columns, n_tokens and the SHA-256 of the ids and of the decoded text."""
    return decoded.select(
        id_col,
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    path = vocabulary()
    return digests(bpe_decode(bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path))
