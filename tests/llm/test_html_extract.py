"""Extraction: markup as bounded evidence, attributes, held-out pages, the query against its pages and edges of tables."""

import html as entities
import random
import re
import time
import tracemalloc

import pandas as pd
import pytest

from tidemark.llm import html_extract as h

SF = "/root/testdata/sf0.01"
A, B = "A long paragraph of real prose, which says a lot of things about its topic. And more of them.", "Another one of the kind, with commas, full stops and a good many words in it. It ends here."
P, Q = f"<p>{A}</p>", f"<p>{B}</p>"
CASES = {
    f'<div class="layout has-sidebar"><article>{P}{Q}</article></div>': f"{A}\n{B}",
    f'<main><div class="page-with-header">{P}{Q}</div></main>': f"{A}\n{B}",
    f'<article>{P}<div class="widget-reviews">{Q}</div></article>': f"{A}\n{B}",
    f'<article><header class="entry-header"><h1>Title here</h1></header>{P}</article>': f"Title here\n{A}",
    f'<article><h1>Title</h1><p class="byline">By A. Writer</p>{P}<div id="related-work">{Q}</div></article>': f"Title\nBy A. Writer\n{A}\n{B}",
    f"<section><header><h1>Title here now</h1></header>{P}{Q}</section>": f"Title here now\n{A}\n{B}",
    f'<article>{P}<p title="A hidden gem">One thing.</p><div data-state="hidden">Two things.</div><div data-id="nav">Three things.</div></article>': f"{A}\nOne thing.\nTwo things.\nThree things.",
    f"<article>{P}<p>x <span hidden>secret <b>text</b></span> y</p><div style='display: none'>gone</div><p aria-hidden=true>gone</p></article>": f"{A}\nx y",
    f'<body><nav class=x><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav><article>{P}<div class="ad">Buy this thing now, it is cheap.</div>{Q}</article><section id="comments"><article class="comment"><p>{A} I agree.</p></article></section><footer>&copy; Someone</footer>': f"{A}\n{B}",
    f"<head><title>T</title><body><div>{P}</div>": A,
    "<p>a&nbsp;b &lt;i&gt; &#233;<br>c\n\td</p>": "a b <i> é c d",
}


@pytest.mark.parametrize("source", CASES)
def test_markup_is_evidence_and_no_more(source):
    assert h.extract(source, h.trained()) == CASES[source]


def test_held_out_pages():
    right = wrong = 0
    for source, told in h.made_pages(120, seed=77):
        page = h.Page(source)
        for b, keep in zip(page.blocks, h.label(page, h.trained()), strict=True):
            right, wrong = right + (keep == (b.text in told)), wrong + (keep != (b.text in told))
    assert wrong < 0.02 * (right + wrong)


def test_neighbours_can_outvote_markup():
    """One paragraph that is called a notice, among alike ones: against its evidence it stays; without smoothness it goes."""
    block = lambda k, e: h.Block(A, k, "p", e, 0)
    plain, notice = h.Evidence(inside=1.0), h.Evidence(inside=1.0, part=1.0)
    weights = [1.0] + [0.0] * 14 + [-1.5] + [0.0] * 2
    blocks = [block(2, plain), block(3, notice), block(4, plain)]
    page = h.Page("<div><p></p><p></p><p></p></div>")
    page.blocks = blocks
    assert h.label(page, weights) == [True, True, True] and blocks[1].costs[0] > blocks[1].costs[1]
    page.blocks = [block(3, notice)]
    assert h.label(page, weights) == [False]


def test_long_page_of_open_blocks():
    source = "".join(f"<p>{'word ' * (k % 7 + 1)}</p>" for k in range(20_000))
    assert h.extract(source, [0.0] * h.N_FEATURES) is not None
    n = 4000
    side = h.max_flow_side(n, [1.0 + (i * 7 % 11) / 11 for i in range(n)], [1.0 + (i * 5 % 13) / 13 for i in range(n)], [(i, i + 1, 1.0) for i in range(n - 1)])
    assert len(side) == n


def test_query_against_its_pages(spark):
    """The pages of the test tables hold their article in one element; brute force cuts it out."""
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id").html
    got = h.op4_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        told = [" ".join(entities.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in told if x) and r.n_chars == len(r.text)


def test_tables_with_odd_rows(spark):
    rows = [(1, "u", P, "t"), (1, "u", P, "t"), (2, None, None, "t"), (None, "v", "", "t"), (3, "w", "<div>" * 3000 + "deep", "t"), (4, "w", "<p>" + "x" * 300_000, "t"), (5, "w", "<" * 5000 + "&" * 5000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = h.extract_main_text(df).collect()
    assert sorted((r.page_id or 0, r.text) for r in got if r.page_id in (1, 2, None)) == [(0, ""), (1, A), (1, A), (2, "")]
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert h.extract_main_text(df.where("false")).count() == 0


def told(source):
    return " ".join(b.text for b in h.Page(source).blocks)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>One <a href=http://x.com/o'brien>two</a> three</p><p class=it's>Four</p><p>don't</p>", "One two three Four don't"),
        ("<p title=\"x>one</p><p>two</p>", "one two"),
        ("<p title='a > b'>one<b a='x' b = \"y>\" c>two</b>", "onetwo"),
        ("<p>x <math><mi>y</mi> = <mn>2</mn></math> z", "x y = 2 z"),
        ("a<!--> b <!-- c -- > d --!> e <!x> f </ g> h <? i > j", "a b e f h j"),
        ("1 < 2 <3 </p> <", "1 < 2 <3 <"),
        ("one <b two", "one"),
        ("one <!-- two", "one"),
        ("<a/b=c>one</a><i =x=y>two</i><br/>three", "onetwo three"),
    ],
)
def test_tags_are_read_by_the_rules(source, text):
    assert told(source) == text


def slow_text(source):
    """Text outside tags, one character after the other; every quote that opens is known to close or not."""
    out, i, n, space = [], 0, len(source), " \t\n\r\f\v"
    while i < n:
        c, after = source[i], source[i + 1 : i + 2]
        name = source[i + 2 : i + 3] if after == "/" else after
        if c == "<" and name.isascii() and name.isalpha():
            j = i + 1
            while j < n and source[j] not in space + ">" and (source[j] != "/" or j == i + 1):
                j += 1
            while j < n and source[j] != ">":
                if source[j] in space + "/":
                    j += 1
                    continue
                j += 1
                while j < n and source[j] not in space + "/>=":
                    j += 1
                k = j
                while k < n and source[k] in space:
                    k += 1
                if k < n and source[k] == "=":
                    k += 1
                    while k < n and source[k] in space:
                        k += 1
                    if k < n and source[k] in "\"'":
                        end = source.find(source[k], k + 1)
                        j = end + 1 if end >= 0 else j
                    elif k < n and source[k] != ">":
                        j = k
                        while j < n and source[j] not in space + ">":
                            j += 1
            i = j + 1
        elif c == "<" and (after in ("!", "?") or after == "/" and name):
            if source.startswith("<!--", i):
                if source.startswith(">", i + 4) or source.startswith("->", i + 4):
                    i = source.index(">", i + 4) + 1
                    continue
                ends = [e + len(x) for x in ("-->", "--!>") if (e := source.find(x, i + 4)) >= 0]
                i = min(ends, default=n)
            else:
                end = source.find(">", i + 1)
                i = end + 1 if end >= 0 else n
        else:
            out.append(c)
            i += 1
    return " ".join("".join(out).split())


def test_broken_pages_by_a_slow_reader():
    rng = random.Random(9)
    parts = ["<b", "<i ", "</b>", "</", "<", ">", "=", " ", "x", "y=", "'", '"', "/", "<!--", "-->", "--", "<!", "<?", "!", "-", "text ", "\n", "=\"q\"", "='q'", "=q'"]
    for _ in range(6000):
        source = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert told(source) == slow_text(source), source


@pytest.mark.parametrize(
    "source",
    ["<div>x" * 200_000, "<div>x" * 100_000 + "</section></b>" * 100_000, "<h1>x" * 100_000, "<a " * 100_000, '<a b=">"' * 100_000, "<![CDATA[" * 100_000, "<svg>" * 100_000 + "</b>" * 100_000, "<p title='" + "x" * 2_000_000 + "'>y"],
    ids=["nested", "strays", "headings", "open tags", "quotes", "declarations", "dropped", "value"],
)
def test_long_and_deep_pages(source):
    """In proportion to the page: with quadratic work each of these took minutes."""
    began = time.process_time()
    h.extract(source, h.trained())
    assert time.process_time() - began < 30


def test_memory_of_a_deep_page():
    tracemalloc.start()
    h.extract("<div>x" * 50_000, h.trained())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120_000_000


def test_distances_in_the_tree():
    page = h.Page("a<div>b<p>c</p><ul><li>d<li>e</ul></div>f")
    a, b, c, d, e, f = page.blocks
    assert [page.apart(*x) for x in ((a, b), (b, c), (c, d), (d, e), (e, f), (a, f))] == [1, 1, 3, 2, 3, 0]
