"""Names by one automaton against their patterns one by one, coverage, findings and edit scripts."""

import random
import re
import time

import pytest

from tidemark.functions.times import times
from tidemark.operators import extraction, text
from tidemark.operators.names import Names
from tidemark.plans.source_queries import NAMES

NAMED = [
    ("COMPANY", "Acme Widgets, Inc."), ("COMPANY", "AT&T Corp"), ("COMPANY", "Johnson & Co"), ("COMPANY", "a a a"), ("COMPANY", ".NET Works"), ("COMPANY", "Éé"), ("COMPANY", "José Sons Ltd"),
    ("PERSON", "Mary Ann Johnson"), ("PERSON", "Jane Q. Public"), ("PERSON", "Ada Lovelace"), ("PERSON", "Miles O'Brien"), ("PERSON", "Kiss"),
    ("TICKER", "ACME"), ("TICKER", "BRK.B"), ("IDENTIFIER", "0000320193"), ("IDENTIFIER", "12-34"), ("IDENTIFIER", "000"), ("COMPANY", ""),
]


def by_patterns(said, names):
    return sorted((a, b, k, kind) for k, w in enumerate(text.all_writings(names)) for a, b, kind in ((m.start(), m.end(), w.kind) for m in w.pattern.finditer(said)))


def test_the_automaton_finds_what_the_patterns_find():
    rng = random.Random(3)
    names, found = Names(NAMED), 0
    parts = sorted({w for _, n in NAMED for w in re.findall(r"[^\s,]+", n)} | {"M.", "A.", "M", "A", "J.", "Q", "&", "Co", "Inc", "Ltd.", "JOHNSON", "johnson", "Johnson", "lovelace", "0320193", "00012-34", "0", "00", "Brien", "Kiss", "Kiſs", "x", "and"})
    for _ in range(4000):
        said = "".join(rng.choice(parts) + rng.choice([" ", " ", ", ", ",", "\n", ".", "-", "", "  ", " , ", "'"]) for _ in range(rng.randrange(1, 14)))
        want = by_patterns(said, NAMED)
        assert sorted(names.find(said)) == want, said
        found += len(want)
    assert found > 5000


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("M. A. Johnson said", ["M. A. Johnson"]),
        ("M.A. Johnson, M A Johnson; Johnson, M. A.", ["M.A. Johnson", "M A Johnson", "Johnson, M. A."]),
        ("Mary A. Johnson met Johnson", ["Mary A. Johnson", "Johnson"]),
        ("Johnson & Co, Johnson Ltd and Johnson and Sons", []),
        ("Mary Ann Johnson & Co", ["Mary Ann Johnson"]),
    ],
)
def test_initials_and_firms(said, want):
    names = Names([("PERSON", "Mary Ann Johnson")])
    assert [said[a:b] for a, b, _ in text.spans(said, [], names.find)] == want


def test_ten_thousand_names_in_one_pass():
    names = Names([("PERSON", f"Given{k} Middle{k % 97} Family{k}") for k in range(10_000)])
    said = " ".join(f"word{k} met G. M. Family{k * 7 % 10_000}, then Family{k}" for k in range(3000))
    began = time.process_time()
    masked, n = text.mask(said, [], names.find)
    assert n == 6000 and "Family" not in masked and time.process_time() - began < 15


def test_what_an_overlap_leaves_bare_is_covered():
    rule = lambda kind, p: lambda t: ((m.start(), m.end(), kind) for m in re.finditer(p, t))
    said = "New York Times Square Garden"
    rules = [rule("A", "New York Times"), rule("B", "Times Square"), rule("C", "Square|Garden")]
    assert text.spans(said, rules, passes=1) == [(0, 14, "A"), (15, 21, "C"), (22, 28, "C")]
    rules = [rule("A", "New York Times"), rule("B", "Times Square Garden"), rule("C", "(?<!Times )Square"), rule("D", "(?<!Square )Garden")]
    assert text.spans(said, rules, passes=1) == [(0, 14, "A")]
    assert text.spans(said, rules) == [(0, 14, "A"), (15, 21, "C"), (22, 28, "D")]


def test_coverage_is_a_fixed_point():
    rng = random.Random(6)
    rule = lambda k, p: lambda t: ((m.start(), m.end(), k) for m in re.finditer(p, t))
    for _ in range(400):
        rules = [rule(f"K{k}", "".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))) for k in range(3)]
        said = "".join(rng.choice("abc") for _ in range(30))
        got = text.spans(said, rules)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
        bare = text.gaps(said, got)
        assert not any(list(r(said[a:b])) for a, b in bare for r in rules) or len(got) > 3


def test_findings_and_none_after_masking(spark):
    docs = spark.createDataFrame([(1, "In 2019, on 2024-03-11 (Q3) MIT said: mit 2020"), (2, None), (3, ""), (4, "é Q1 2024 é M. A. Johnson")], "doc_id long, text string")
    got = [tuple(r) for r in text.findings(docs, ["MIT"]).orderBy("doc_id", "n").collect()]
    assert got == [
        (1, 0, "year", 3, 7, "REVIEW", "2019"), (1, 1, "year", 12, 16, "REVIEW", "2024"), (1, 2, "date", 12, 22, "LEAK", "2024-03-11"), (1, 3, "quarter", 24, 26, "LEAK", "Q3"),
        (1, 4, "literal:MIT", 28, 31, "LEAK", "MIT"), (1, 5, "literal:MIT", 38, 41, "LEAK", "mit"), (1, 6, "year", 42, 46, "REVIEW", "2020"), (4, 0, "quarter", 2, 4, "LEAK", "Q1"), (4, 1, "year", 5, 9, "REVIEW", "2024"),
    ]
    assert text.findings(docs.where("false")).count() == 0


def test_no_leak_after_masking(spark):
    rng = random.Random(7)
    parts = ["on 2024-03-11", "in Q3", "q1 2023,", "2019-12-31T10:00:00Z", "Mary Ann Johnson", "mary ann\njohnson", "Apache Software Foundation", "APACHE  SOFTWARE FOUNDATION", "Johnson & Co", "a 5,000", "(Q2)", "by M. A. Johnson", "word", "é"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(parts) for _ in range(12))) for i in range(300)], "doc_id long, text string")
    names = [n for k, n in NAMES if k in ("PERSON", "COMPANY")]
    leaks = lambda df: text.findings(df, names).where("severity = 'LEAK'").count()
    assert leaks(docs) > 1000 and leaks(text.masked(docs, NAMES)) == 0


def test_masking_by_patterns_alone(spark):
    """The query's own names and texts, masked with one pattern after the other."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.text, r.n_masked) for r in text.masked(spark.createDataFrame(rows), NAMES).collect()}
    assert got == {r.doc_id: text.mask(r.text, [*text.entity_rules(NAMES), times]) for r in rows}


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, best[j + 1] = best[j + 1], last + 1 if x == y else max(best[j], best[j + 1])
    return best[-1]


def test_edit_scripts_rebuild_and_are_shortest():
    rng = random.Random(5)
    for _ in range(600):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        script = extraction.edit_script(a, b)
        assert extraction.applied(a, script, b) == b
        assert [x for op, i, j, k, l in script for x in a[i:j]] == a and sum(j - i for op, i, j, *_ in script if op == "keep") == lcs(a, b)
        assert all(a[i:j] == b[k:l] for op, i, j, k, l in script if op == "keep") and all(x[0] != y[0] for x, y in zip(script, script[1:], strict=False))
    assert extraction.edit_script([], []) == [] and extraction.edit_script(["a"], ["a"]) == [("keep", 0, 1, 0, 1)]


def test_edits_of_versions(spark):
    versions = spark.createDataFrame([("p", 1, "a\nb\nb"), ("p", 2, "b\nb\nc"), ("q", 1, "x"), ("q", 2, None)], "name string, version int, body string")
    got = sorted(tuple(r) for r in extraction.prompt_edits(versions).collect())
    assert got == [("p", 2, 0, "delete", 0, 1, 0, 0), ("p", 2, 1, "keep", 1, 3, 0, 2), ("p", 2, 2, "insert", 3, 3, 2, 3), ("q", 2, 0, "replace", 0, 1, 0, 1)]
