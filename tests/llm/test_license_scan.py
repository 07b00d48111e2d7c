"""The positional index against a scan of all templates at all shifts."""

import random

import pytest

from tidemark.llm import license_scan as ls


def slow(words, templates):
    out = []
    for label, text, phrases in templates:
        t = text.split()
        firsts = [next(k for k in range(len(t)) if t[k : k + len(p.split())] == p.split()) for p in phrases]
        for s in range(-len(t), len(words)):
            if all(s + at >= 0 and words[s + at : s + at + len(p.split())] == p.split() for at, p in zip(firsts, phrases, strict=True)):
                out.append((label, max(s, 0), sum(0 <= s + k < len(words) and words[s + k] == w for k, w in enumerate(t)) / len(t)))
    return sorted(out)


def test_index_finds_what_a_scan_of_all_templates_finds():
    rng, index, hits = random.Random(1), ls.Index(), 0
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 4)):
            t = rng.choice(ls.TEMPLATES)[1].split()
            a = rng.choice([0, 0, rng.randrange(len(t))])
            words += [rng.choice("license the cc by software mozilla zz".split()) for _ in range(rng.randrange(6))] + t[a : a + rng.randrange(1, len(t) + 1)]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "zz"
        want = slow(words, ls.TEMPLATES)
        hits += len(want)
        assert sorted(index.matches([w.encode() for w in words])) == want
    assert hits > 100


@pytest.mark.parametrize("name", ["MIT", "ISC", "BSD", "ZLIB", "BOOST", "UNLICENSE", "APACHE", "GPL", "MPL", "CC0"])
def test_whole_texts(name):
    found = ls.scan("Some words. " + getattr(ls, name).capitalize() + ". More.", ls.Index())
    assert {"MPL": "mpl-2.0", "APACHE": "apache-2.0"}.get(name, name.lower()) in found[5] and found[6] == 1.0


def test_a_rare_word_elsewhere_loses_nothing():
    index = ls.Index()
    assert ("mpl-2.0", 3) in [(a, b) for a, b, _ in index.matches(f"mozilla mozilla public {ls.MPL} mozilla".encode().split())]
    assert index.matches(b"mozilla has a public office with a license".split()) == []
    assert index.matches(b"license " .split() * 20_000) == []
