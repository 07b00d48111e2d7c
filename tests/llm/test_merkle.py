"""The manifest against a plain tree, and folding against building anew."""

import hashlib
import random
import zlib
from itertools import pairwise

from tidemark.llm.merkle import Parent, lower_case_thirds, manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree int, at string, path string, root int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def walk(tree, at):
    """Siblings before and after, level by level."""
    for nodes, _ in pairwise(tree):
        run = at // 8 * 8
        yield nodes[run:at], nodes[at + 1 : run + 8]
        at //= 8


def lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain(docs):
    rows = []
    for i, text, lang, source, n in docs:
        leaf = h(*map(field, (i, source, lang, n, text)))
        third = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        rows.append((i, lang, leaf, h(*map(field, (i, source, lang, n, lower(text)))) if third else leaf))
    key = lambda x: (x is not None, (x or "").encode())
    langs = sorted({r[1] for r in rows}, key=key)
    of = {x: sorted((r for r in rows if r[1] == x), key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for x in langs}
    trees = {x: levels([r[2] for r in of[x]]) for x in langs}
    crown = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for at, (i, _, leaf, now) in enumerate(of[x]):
            proof = ""
            for before, after in (*walk(trees[x], at), *walk(crown, k)):
                proof += "".join((*before, *after))
                now = h(*before, now, *after)
            out.append((i, leaf, trees[x][-1][0], crown[-1][0], h(proof), now, now == crown[-1][0]))
    return sorted(out, key=repr)


def made(spark, docs):
    df = spark.createDataFrame([(*d, 1, "mine", "mine", 1) for d in docs], SCHEMA)
    out = manifest(df, tampered=lower_case_thirds).select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_manifest_by_a_plain_tree(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["Some Text", "some text", "É", ""]) + str(i), rng.choice(["en", "en", "fr", None, "é", "z"]), rng.choice(["s", None]), i) for i in rng.sample(range(-5000, 20_000), 700)]
    assert made(spark, docs) == plain(docs)


def test_trees_of_more_than_a_block(spark):
    docs = [(i, "Text" if i % 2 else "text", "en" if i < 4700 else "de", None, i) for i in range(4800)]
    assert made(spark, docs) == plain(docs)


def test_many_trees(spark):
    docs = [(i, "T", f"l{i % 4500}", "s", 1) for i in range(4600)]
    assert made(spark, docs) == plain(docs)


def test_nulls_ties_and_repeated_rows(spark):
    docs = [(None, None, None, None, None), (None, "A", None, None, None), (3, "A" * 300_000, "en", "s", 1), (3, "A" * 300_000, "en", "s", 1), (3, "B", "en", "s", 1), (6, None, "en", None, 2), (9, "", "", "", 0), (12, "-", "-", "-", 1)]
    assert made(spark, docs) == plain(docs)
    assert made(spark, docs[:1]) == plain(docs[:1])
    assert made(spark, [docs[2]] * 70) == plain([docs[2]] * 70)
    assert made(spark, []) == []


def test_folding_resumes_the_state_before_a_slot():
    children = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(8)]
    for n in range(1, 9):
        parent = Parent(children[:n])
        for slot in range(n):
            assert parent.fold(slot, b"x" * 64) == Parent([*children[:slot], b"x" * 64, *children[slot + 1 : n]]).digest
            assert parent.fold(slot, children[slot]) == parent.digest
