"""The whole pipeline against a plain chain of the same five decisions, on one small table."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import quality_classifier, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("com", "re", "in", "pro", "dis", "sub", "un", "out") for b in ("mit", "port", "form", "pose", "tend", "side", "act", "ply", "vert", "duct")]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    junk = lambda n: " ".join("".join(rng.choice("#$%&<>|*") for _ in range(rng.randint(1, 6))) for _ in range(n))
    docs = {}
    for i in range(120):
        docs[i] = junk(rng.randint(5, 60)) if i % 5 == 0 else prose(rng.randint(60, 200))
    for i in range(120, 170):
        told = docs[rng.choice([k for k in range(120) if k % 5])].split()
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
            told[rng.randrange(len(told))] = rng.choice(words)
        docs[i] = " ".join(told)
    items = [prose(14) for _ in range(6)]
    for i in range(170, 190):
        docs[i] = prose(40) + " " + (items[i % 6] if i % 2 else " ".join(items[i % 6].split()[2:11])) + " " + prose(40)
    for i in range(190, 210):
        docs[i] = prose(50) + rng.choice([" password = hunter2hunter2 ", " AKIA" + "Q" * 16 + " ", f" {rng.getrandbits(160):040x} ", " api_key: abc "]) + prose(30)
    labels = [(i, 0 if i % 5 == 0 else 1, 0) for i in range(100)]
    return docs, labels, [(f"item{k}", x) for k, x in enumerate(items)]


def slow_score(machine, text):
    """Pair by pair."""
    at, value = quality_classifier.features(text)
    kept = [(int(i), float(v)) for i, v in zip(at, value, strict=True)]
    linear = machine.bias + sum(machine.weights[i] * v for i, v in kept)
    rows = np.array([machine.factors[i] * v for i, v in kept])
    pairs = sum(float(rows[i] @ rows[j]) for i in range(len(kept)) for j in range(i)) if len(kept) else 0.0
    return 1 / (1 + np.exp(-np.clip(linear + pairs, -30, 30)))


def sets(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 5 else {tuple(words)}


def slow_groups(docs):
    told, label = {i: sets(t) for i, t in docs.items()}, {i: i for i in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in docs:
        for j in docs:
            if j < i and len(told[i] & told[j]) >= 0.8 * len(told[i] | told[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i for i in docs if root(i) == i}


def windows(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
    n = min(10, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def test_pipeline_by_a_plain_chain(spark, tmp_path):
    texts, labels, items = documents()
    at = f"file://{tmp_path}"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    machine = quality_classifier.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    good = {i: t for i, t in texts.items() if slow_score(machine, t) >= quality_classifier.GOOD}
    one = {i: good[i] for i in slow_groups(good)}
    held = set().union(*(windows(x) for _, x in items))
    clean = {i: t for i, t in one.items() if not windows(t) & held}
    assert len(texts) > len(good) > len(one) > len(clean) > 60
    found = secret_scan.secret_spans(spark.createDataFrame([(i, t) for i, t in clean.items()], "doc_id long, text string")).collect()
    masked, n = {}, 0
    for r in found:
        out, end = "", 0
        for a, b in sorted((s.start, s.end) for k in secret_scan.PATTERNS for s in r[k]):
            out, end, n = out + (r.text[end:a] + "[SECRET]" if a >= end else ""), max(end, b), n + 1
        masked[r.doc_id] = out + r.text[end:]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for i, t in masked.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (ids, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.ids, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, at).collect()}
    assert n > 5 and got == want
