"""Main text of HTML pages by minimum-cut labelling.

A page becomes a row of text blocks.  A logistic classifier gives each block the costs of being
content and of being boilerplate, from its text shape and from its markup: elements and class
names around it are evidence like any other, and no evidence is beyond CAP.  The costs are
terminal capacities; blocks next to each other in the page and blocks of one parent are joined
by smoothness edges, the stronger the nearer they are in the element tree and the more alike
their elements.  The minimum cut is the labelling of least total cost, so a block may get the
label of its neighbours against its own evidence.  A block whose costs differ by more than all
its open edges together has its label in every minimum cut; such blocks are settled first,
which is exact, and max-flow runs on the rest.

The classifier learns from pages that are made by rule, whose content is known because it was
put there (`made_pages`), so the same weights come out wherever it is trained.

Tags and attributes are read by the rules of HTML: an unquoted value goes on to white space or the
end of the tag, whatever quotes it holds, and a quoted one to its quote.  A value whose quote never comes ends with
its tag; a tag that never ends, or a comment, takes the rest of the page.  Reading takes time and memory in
proportion to the page, however deep its elements lie.

Defined results: a null or empty html has an empty text; a page without content blocks too;
repeated rows are extracted row by row; an empty table gives an empty result; columns other
than those named are ignored.  Scripts, styles, forms' controls and hidden elements, inline
ones included, are no blocks.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrow import map_batches

#: Elements by what they mean for a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style noscript template textarea select option button svg iframe object canvas audio video head title datalist".split())
RAW = {t: re.compile(rf"</{t}(?:[\s/][^>]*+)?>", re.I) for t in "script style textarea title iframe noscript".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class names, ids and roles that speak for boilerplate, and words that say nothing beside them.
AWAY_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagination paywall popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget complementary contentinfo alert adsbygoogle skip".split()
)
PLAIN_WORDS = frozenset("area bar block body bottom box buttons container global group inner item items left link links list main outer page panel primary right row secondary section site slot text thread top unit wrap wrapper".split())
CONTENT_WORDS = frozenset("article articlebody content entry maincontent post postbody story storybody".split())

#: One attribute, as groups of its name and its value in double, single or no quotes; nothing in it is tried twice.
ATTRIBUTE = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|((?!["'>])[^\s>]++)))?+"""
ATTRIBUTES = re.compile(ATTRIBUTE)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|" + re.sub(r"(?<!\\)\((?!\?)", "(?:", ATTRIBUTE) + ")*+)>")
#: What is no tag: a comment, which may end at once, and other declarations, instructions and end tags without a name.
ASIDE = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]|\Z))[^>]*+(?:>|\Z)", re.S)
UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])")

#: The most that the evidence of a block counts for, as log odds.
CAP = 2.0
#: Smoothness of neighbours that are siblings of one kind, and the share of it between different kinds of elements.
NEAR, UNLIKE = 2.0, 0.4
#: Pages made by rule that train the classifier.
MADE_PAGES = 400


@dataclass(frozen=True)
class Evidence:
    """What the markup around a block says: elements and class words for boilerplate within the nearest article or main element and beyond it, words that are only part of a name, and signs of content."""

    tag: float = 0.0
    tag_beyond: float = 0.0
    header: float = 0.0
    word: float = 0.0
    word_beyond: float = 0.0
    part: float = 0.0
    inside: float = 0.0
    content: float = 0.0


@dataclass
class Block:
    """A block's text, the number of its element and what the labelling needs to know of it."""

    text: str
    number: int
    tag: str
    evidence: Evidence
    n_link: int
    costs: tuple[float, float] = (0.0, 0.0)


@dataclass
class Open:
    tag: str
    number: int
    evidence: Evidence
    dropped: bool


#: Longer sources of attributes are not kept.
KEPT_SOURCE = 256


def attributes(text: str) -> dict[str, str]:
    """Names and values as written in a tag; of a repeated name the first counts."""
    return kept_attributes(text) if len(text) <= KEPT_SOURCE else read_attributes(text)


def read_attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTES.findall(text):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


kept_attributes = lru_cache(1 << 14)(read_attributes)


def unseen(told: dict[str, str]) -> bool:
    return "hidden" in told or told.get("aria-hidden", "").lower() == "true" or bool(UNSEEN.search(told.get("style", "").lower()))


def named(text: str) -> tuple[float, float, float]:
    return kept_named(text) if len(text) <= KEPT_SOURCE else read_named(text)


def read_named(text: str) -> tuple[float, float, float]:
    """Of a tag's class, id, role and itemprop: whether a whole name speaks for boilerplate, whether just a part of one does, and whether a name speaks for content."""
    told = attributes(text)
    word = part = content = 0.0
    for token in " ".join(told.get(n, "") for n in ("class", "id", "role", "itemprop")).split():
        pieces = [p for p in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if len(p) > 1]
        away = [p for p in pieces if p in AWAY_WORDS]
        if away and all(p in AWAY_WORDS or p in PLAIN_WORDS for p in pieces):
            word = 1.0
        elif away:
            part = 1.0
        elif token.lower() in CONTENT_WORDS or token.lower() == "main" or pieces and all(p in CONTENT_WORDS or p in PLAIN_WORDS for p in pieces) and any(p in CONTENT_WORDS for p in pieces):
            content = 1.0
    return word, part, content


kept_named = lru_cache(1 << 14)(read_named)
AWAY_TAGS = frozenset("nav footer aside form menu dialog".split())


def within(above: Evidence, tag: str, text: str) -> Evidence:
    """The evidence inside an element, given that around it. An article or main element starts anew and keeps what was around it apart."""
    if tag in ("html", "body"):
        return above
    word, part, content = named(text) if text.strip() else (0.0, 0.0, 0.0)
    starts = tag in ("article", "main")
    if not (starts or word or part or content or tag in AWAY_TAGS or tag == "header"):
        return above
    return Evidence(
        tag=float(tag in AWAY_TAGS) if starts else max(above.tag, float(tag in AWAY_TAGS)),
        tag_beyond=max(above.tag_beyond, above.tag) if starts else above.tag_beyond,
        header=0.0 if starts else max(above.header, float(tag == "header")),
        word=word if starts else max(above.word, word),
        word_beyond=max(above.word_beyond, above.word) if starts else above.word_beyond,
        part=part if starts else max(above.part, part),
        inside=1.0 if starts else above.inside,
        content=max(above.content, content),
    )


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Page:
    """Reads a page into blocks."""

    source: str
    blocks: list[Block] = field(default_factory=list)
    #: Of each element by number, that of its parent and its depth; 0 is the page.
    parents: list[int] = field(default_factory=lambda: [0])
    depths: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        stack = [Open("", 0, Evidence(), False)]
        open_tags: Counter[str] = Counter()
        parts: list[str] = []
        links, anchor = 0, 0
        at, source = 0, self.source

        def flush() -> None:
            nonlocal links
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    self.blocks.append(Block(text, stack[-1].number, stack[-1].tag, stack[-1].evidence, links))
            links = 0

        def put(tag: str, number: int, evidence: Evidence, dropped: bool) -> None:
            stack.append(Open(tag, number, evidence, dropped))
            open_tags[tag] += 1

        def cut(k: int) -> None:
            for o in stack[k:]:
                open_tags[o.tag] -= 1
            del stack[k:]

        def close(k: int) -> None:
            flush()
            cut(k)

        def say(end: int) -> None:
            nonlocal links
            if end > at and not stack[-1].dropped:
                parts.append(source[at:end])
                if anchor:
                    links += end - at

        seen = 0
        while (start := source.find("<", seen)) >= 0:
            m = TAG.match(source, start)
            if not m:
                if other := ASIDE.match(source, start):
                    say(start)
                    at = seen = other.end()
                elif source[start + 1 : start + 2].isascii() and source[start + 1 : start + 2].isalpha() or source[start + 1 : start + 2] == "/" and len(source) > start + 2:
                    say(start)
                    at = seen = len(source)
                else:
                    seen = start + 1
                continue
            say(start)
            at = seen = m.end()
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    anchor = 0
                block = tag in BLOCKS
                if not open_tags[tag]:
                    if block:
                        flush()
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        if block:
                            close(k)
                        else:
                            cut(k)
                        break
                    # An inline end tag reaches no further than its block.
                    if not block and tag not in DROPPED and stack[k].tag in BLOCKS:
                        break
                continue
            if tag == "br" or tag == "img":
                if not stack[-1].dropped:
                    parts.append(" ")
                if tag == "br":
                    continue
            if tag in VOID and tag not in BLOCKS:
                continue
            if tag == "a":
                anchor = 1
            told = attributes(m[3]) if m[3].strip(" /") else {}
            if tag in DROPPED:
                if tag in RAW:
                    # Text of these elements ends at their own end tag and nowhere else.
                    end = RAW[tag].search(source, at)
                    at = seen = end.end() if end else len(source)
                elif not m[3].endswith("/"):
                    put(tag, 0, stack[-1].evidence, True)
                continue
            if tag not in BLOCKS:
                if told and unseen(told) and not m[3].endswith("/"):
                    put(tag, 0, stack[-1].evidence, True)
                continue
            if open_tags["head"] and (tag == "body" or stack[-1].tag == "head"):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "head"))
            flush()
            anchor = 0
            ended = ("p", "li") if tag == "li" else ("p", "dt", "dd") if tag in ("dt", "dd") else ("p",)
            if any(open_tags[t] for t in ended):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ended:
                        close(k)
                        break
                    if stack[k].tag not in HEADINGS:
                        break
            if tag in VOID:
                continue
            above = stack[-1]
            parent = next(o.number for o in reversed(stack) if o.number or o is stack[0])
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
            put(tag, len(self.parents) - 1, within(above.evidence, tag, m[3]), above.dropped or bool(told) and unseen(told))
        say(len(source))
        flush()

    def apart(self, a: Block, b: Block) -> int:
        """Elements on the way between two blocks. Between neighbours this takes all in all as many steps as the page has elements."""
        i, j, steps = a.number, b.number, 0
        while i != j:
            if self.depths[i] >= self.depths[j]:
                i = self.parents[i]
            else:
                j = self.parents[j]
            steps += 1
        return steps


N_FEATURES = 18


def shape(block: Block, place: float) -> list[float]:
    """What the classifier sees of a block: its text and its markup."""
    text, words, e = block.text, block.text.count(" ") + 1, block.evidence
    linked = min(1.0, block.n_link / len(text))
    return [
        1.0,
        math.log1p(words) / 5,
        linked,
        min(1.0, sum(map(text.count, ".,;:!?")) / words),
        float(text[-1] in ".!?"),
        float(words < 4),
        abs(place - 0.5),
        float(block.tag in HEADINGS),
        float(block.tag == "h1"),
        float(block.tag == "li") * linked,
        e.tag,
        e.tag_beyond,
        e.header,
        e.word,
        e.word_beyond,
        e.part,
        e.inside,
        e.content,
    ]


def logistic(rows: list[tuple[list[float], int]], steps: int = 25, ridge: float = 1.0) -> list[float]:
    """Weights by Newton's method; with one class or none, no opinion."""
    if len({y for _, y in rows}) < 2:
        return [0.0] * N_FEATURES
    x, y = np.array([f for f, _ in rows]), np.array([y for _, y in rows])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return [float(v) for v in w]


def max_flow_side(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of the minimum cut (of several, the one with the fewest nodes there); blocking flows over shortest paths."""
    s, t, tiny = n, n + 1, 1e-9
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def add(u: int, v: int, there: float, back: float) -> None:
        at[u].append(len(to))
        to.append(v)
        room.append(there)
        at[v].append(len(to))
        to.append(u)
        room.append(back)

    for i in range(n):
        both = min(source[i], sink[i])
        if source[i] > both:
            add(s, i, source[i] - both, 0.0)
        if sink[i] > both:
            add(i, t, sink[i] - both, 0.0)
    for u, v, w in edges:
        add(u, v, w, w)
    while True:
        far = [-1] * (n + 2)
        far[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in at[u]:
                if room[e] > tiny and far[to[e]] < 0:
                    far[to[e]] = far[u] + 1
                    queue.append(to[e])
        if far[t] < 0:
            return [far[i] >= 0 for i in range(n)]
        # Every edge of the layers is given up at most once a phase.
        tried, path, u = [0] * (n + 2), [], s
        while True:
            if u == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                first = next(k for k, e in enumerate(path) if room[e] <= tiny)
                u = to[path[first] ^ 1]
                del path[first:]
            while tried[u] < len(at[u]):
                e = at[u][tried[u]]
                if room[e] > tiny and far[to[e]] == far[u] + 1:
                    break
                tried[u] += 1
            if tried[u] < len(at[u]):
                path.append(at[u][tried[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                u = to[path.pop() ^ 1]
                tried[u] += 1


def edges_of(page: Page) -> list[tuple[int, int, float]]:
    """Smoothness: between blocks next to each other, and between blocks of one parent with others between them, halved. It falls with the elements between them in the tree."""
    blocks = page.blocks

    def weight(a: Block, b: Block, apart: int) -> float:
        return NEAR * 2 / max(apart, 2) * (1.0 if a.tag == b.tag and a.evidence == b.evidence else UNLIKE)

    edges = [(i, i + 1, weight(a, b, page.apart(a, b))) for i, (a, b) in enumerate(pairwise(blocks))]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        parent = page.parents[b.number]
        if parent in last and last[parent] < i - 1:
            edges.append((last[parent], i, weight(blocks[last[parent]], b, 2) / 2))
        last[parent] = i
    return edges


def label(page: Page, weights: list[float]) -> list[bool]:
    """True for the content blocks: the side of the source in the minimum cut."""
    blocks = page.blocks
    n = len(blocks)
    for i, b in enumerate(blocks):
        z = max(-CAP, min(CAP, sum(w * f for w, f in zip(weights, shape(b, (i + 0.5) / n), strict=True))))
        b.costs = math.log1p(math.exp(-z)), math.log1p(math.exp(z))
    edges = edges_of(page)
    # Costs beyond all edges of a block settle it, and a settled block is a terminal of its neighbours.
    near: list[list[tuple[int, float]]] = [[] for _ in blocks]
    for u, v, w in edges:
        near[u].append((v, w))
        near[v].append((u, w))
    source, sink = [b.costs[1] for b in blocks], [b.costs[0] for b in blocks]
    known: list[bool | None] = [None] * n
    open_ = [sum(w for _, w in x) for x in near]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if known[i] is None and abs(source[i] - sink[i]) > open_[i]:
            known[i] = source[i] > sink[i]
            for j, w in near[i]:
                if known[j] is None:
                    (source if known[i] else sink)[j] += w
                    open_[j] -= w
                    queue.append(j)
    rest = [i for i in range(n) if known[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        side = max_flow_side(len(rest), [source[i] for i in rest], [sink[i] for i in rest], [(place[u], place[v], w) for u, v, w in edges if u in place and v in place])
        for i, k in place.items():
            known[i] = side[k]
    return [bool(x) for x in known]


def extract(source: str | None, weights: list[float]) -> str:
    page = Page(source or "")
    return "\n".join(b.text for b, keep in zip(page.blocks, label(page, weights), strict=True) if keep)


def made_pages(n: int = MADE_PAGES, seed: int = 4) -> Iterator[tuple[str, set[str]]]:
    """(html, texts of its content blocks) of pages made by rule: articles in many wrappers, some of misleading names, among menus, notices, adverts, forms, sidebars, comments and footers, marked or bare."""
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p
    letters = "etaoinsrhldcumfpgwybvk"

    def words(k: int) -> str:
        return " ".join("".join(pick(letters) for _ in range(rng.randint(1, 9))) for _ in range(k))

    def prose(low: int, high: int) -> str:
        said = words(rng.randint(low, high)).split()
        for i in range(len(said)):
            if chance(0.12):
                said[i] += pick(",.")
        return " ".join(said).capitalize() + pick("....!?:") * chance(0.85)

    for _ in range(n):
        told: set[str] = set()

        def mine(text: str, told: set[str] = told) -> str:
            told.add(text)
            return text

        def links(k: int) -> str:
            return "<ul>" + "".join(f"<li><a href=/{i}>{words(rng.randint(1, 4))}</a>{'</li>' * chance(0.7)}" for i in range(k)) + "</ul>"

        def marked(tags: str, names: str, inner: str, bare: float = 0.1) -> str:
            """inner in an element whose tag or name says what it is; with a chance of `bare` in one that does not."""
            if chance(bare):
                return f"<div>{inner}</div>"
            tag, name = pick(tags.split()), pick(names.split())
            named = f' {pick(["class", "class", "id"])}="{pick(["", "", "x1 "])}{name}"' if tag in ("div", "ul", "section", "p") or chance(0.4) else ""
            return f"<{tag}{named}>{inner}</{tag}>"

        menu = lambda: marked("nav nav div", "menu nav navbar main-menu site-nav navigation", links(rng.randint(3, 9)))
        advert = lambda: marked("div div aside", "ad ads advert sponsored promo ad-slot banner", prose(3, 30), 0.0)
        notice = lambda: marked("div section p", "notice cookie-notice alert consent gdpr newsletter popup cookie-banner", prose(4, 30) + pick(["", "<button>ok</button>"]), 0.0)
        form = lambda: f"<form{pick(['', ' class=search', ' id=signup'])}><p>{words(rng.randint(1, 6))}</p><input name=q></form>"
        sidebar = lambda: marked("aside aside div section", "sidebar related widget recommended sidebar-left related-links", f"<h3>{words(2)}</h3>" + pick([links(rng.randint(2, 7)), f"<p>{prose(4, 40)}</p>", f"<p>{prose(4, 12)}</p>" + links(3)]), 0.0)
        foot = lambda: marked("footer footer div", "footer site-footer page-footer", pick([f"<p>&copy; {prose(3, 20)}</p>", f"&copy; {words(3)}" + links(3), prose(3, 12)]))
        head = lambda: marked("header div", "header masthead topbar page-header site-header", f"<{pick(['h2', 'div', 'p'])}>{words(2)}</div>" + pick(["", menu()]))

        def comments() -> str:
            one = lambda: pick(['<div class="comment">', '<article class="comment">', '<li class="comment-item">', '<div class="reply">', "<div>"]) + f"<p>{words(1)}</p><p>{prose(3, 60)}</p>" + pick(["</div>", "</article>", "</li>"])
            return marked("section div div", "comments comment-list disqus replies comment-section respond", f"<h3>{words(2)}</h3>" + "".join(one() for _ in range(rng.randint(1, 5))), 0.0)

        def body() -> str:
            title = f"<h1>{mine(prose(2, 14))}</h1>"
            out = [pick([title, title, f"<header>{title}</header>", f'<header class="entry-header">{title}</header>', f'<div class="{pick(["post-header", "header-group", "story-header"])}">{title}</div>', title + f'<p class="byline">{mine(words(rng.randint(2, 5)))}</p>', ""])]
            for _ in range(rng.randint(1, 12)):
                p = f"<p>{mine(pick([prose(8, 90), prose(8, 90), prose(1, 8), words(rng.randint(1, 25))]))}" + pick(["</p>", "</p>", ""])
                kinds = [p] * 12 + [f"<h2>{mine(words(rng.randint(1, 6)))}</h2>", "<ul>" + "".join(f"<li>{mine(prose(1, 14))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>", f"<blockquote>{mine(prose(5, 40))}</blockquote>"]
                kinds += [f"<p>{mine(words(4) + ' linked words ' + prose(5, 30))}</p>".replace(" linked words ", " <a href=/x>linked words</a> "), f'<div class="{pick(["widget-reviews", "text-with-sidebar", "notice-period", "reply-rates", "lead", "related-work"])}"><p>{mine(prose(8, 60))}</p></div>']
                kinds += [f"<table><tr><td>{mine(words(2))}<td>{mine(words(1))}</table>", f"<figure><img src=i><figcaption>{mine(prose(3, 14))}</figcaption></figure>", f'<section id="{pick(["part", "background"])}"><h3>{mine(words(3))}</h3><p>{mine(prose(8, 60))}</p></section>']
                out.append(pick(kinds))
                if chance(0.08):
                    out.append(pick([advert, advert, form, notice, sidebar])())
            return "".join(out)

        wraps = ["<article>|</article>"] * 4 + ["<main>|</main>", "<main><article>|</article></main>", "<div class=content>|</div>", '<div class="post">|</div>', "<div>|</div>", "<section>|</section>", "|", '<div class="layout has-sidebar"><article>|</article></div>', '<main><div class="page-with-header">|</div></main>', "<form id=f><main>|</main></form>", '<div class="sidebar-layout"><div class="entry">|</div></div>', '<div role="main">|</div>', '<div itemprop="articleBody">|</div>']
        before, after = pick(wraps).split("|")
        front = [x() for x, p in ((head, 0.4), (menu, 0.7), (notice, 0.3), (advert, 0.3), (form, 0.2), (sidebar, 0.15)) if chance(p)]
        back = [x() for x, p in ((advert, 0.2), (sidebar, 0.4), (comments, 0.35), (form, 0.1), (foot, 0.8)) if chance(p)]
        inner = body()
        if chance(0.12):
            front, back = [], []
        yield "<body>" + "".join(front) + before + inner + after + "".join(back), {" ".join(t.split()) for t in told}


def fit(labelled: Iterator[tuple[str, set[str]]]) -> list[float]:
    """Weights of the block classifier, from pages with the texts of their content blocks."""
    rows = []
    for source, content in labelled:
        blocks = Page(source).blocks
        rows += [(shape(b, (i + 0.5) / len(blocks)), int(b.text in content)) for i, b in enumerate(blocks)]
    return logistic(rows)


@cache
def trained() -> tuple[float, ...]:
    return tuple(fit(made_pages()))


def extract_main_text(pages: DataFrame, weights: list[float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars; weights: of the block classifier, those of `trained` if none are given."""
    weights = list(trained()) if weights is None else weights
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(x, weights) for x in batch.column(2).to_pylist()]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return map_batches(pages.select(id_col, url_col, html_col), rows, f"{kinds}, text string, n_chars long")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
