"""Chunking, masking, leak scans, digests and validation of texts."""

from __future__ import annotations

import difflib
import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.batches import of_texts
from tidemark.functions.times import times
from tidemark.operators.facts import Refused

MAX_CHARS = 12_000
#: White space, and the punctuation that ends a sentence before it, with what closes after it.
GAP = re.compile(r"([.!?…][\"'”’»)\]]*)?([ \t\n\r\f\v]+)")


def borders(text: str) -> list[list[int]]:
    """Where a text may be cut, after white space: [after any, after a sentence, after an empty line], each in order."""
    out: list[list[int]] = [[], [], []]
    for m in GAP.finditer(text):
        rank = 2 if m[2].count("\n") > 1 else 1 if m[1] else 0
        out[rank].append(m.end())
    return out


def chunk(text: str, most: int = MAX_CHARS) -> list[tuple[int, int]]:
    """Spans of at most `most` characters that tile the text. Each reaches as far as it may to a border of the best rank within reach; where there is none, it is cut."""
    if most < 1:
        raise Refused("a chunk needs a character")
    ranked, out, at = borders(text), [], 0
    while len(text) - at > most:
        ends = (places[k - 1] for places in reversed(ranked) if (k := bisect_right(places, at + most)) and places[k - 1] > at)
        end = next(ends, at + most)
        out.append((at, end))
        at = end
    return [*out, (at, len(text))] if text else []


def chunks(docs: DataFrame, most: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk, start, end and text; chunks tile the text. A null or empty text has none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, a, b, t[a:b]) for i, t in zip(batch[id_col], batch[text_col], strict=True) if t for k, (a, b) in enumerate(chunk(t, most))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk", "start", "end", "text"])

    return of_texts(docs.select(id_col, text_col)).mapInPandas(run, f"{id_col} {kind}, chunk int, start int, end int, text string")


#: What finds the spans of one rule: (start, end, kind) in a text.
Finder = Callable[[str], Iterable[tuple[int, int, str]]]
RULES: list[Finder] = [times]
#: The author's choice: endings of company names by their legal form, and words too common to stand for a company or a person alone.
LEGAL_FORMS = frozenset("ag bv co company corp corporation gmbh group holding holdings inc incorporated limited llc llp lp ltd nv oy plc sa sarl se spa trust".split())
COMMON_WORDS = frozenset("advanced american bank capital energy financial first general global great group holding home international life market national new north power public service south standard state summit target technology time trust united universal western world".split())


def _between(*parts: str) -> str:
    """The parts with white space or a comma between them."""
    return r"(?:\s*,\s*|\s+)".join(parts)


def writings(kind: str, name: str) -> list[str]:
    """Patterns of how a name is written, the fuller first: a company also without its legal form, or by a distinctive first word; a person in either order; an identifier also padded to ten digits."""
    words = name.replace(",", " ").split()
    plain = [re.escape(w.rstrip(".")) + r"\.?" if w.endswith(".") else re.escape(w) for w in words]
    if not words:
        return []
    if kind == "TICKER":
        return [re.escape(x) for x in dict.fromkeys([name, name.upper(), name.title()])]
    if kind == "IDENTIFIER":
        bare = name.lstrip("0") or "0"
        return [f"0{{0,{max(0, 10 - len(bare))}}}{re.escape(bare)}"]
    out = [f"(?i:{_between(*plain)})"]
    if kind == "PERSON" and len(words) > 1:
        given, last = plain[:-1], plain[-1]
        first, initials = given[0], [f"{re.escape(w[0])}\\.?" for w in words[1:-1]]
        orders = [(first, last), (last, first), (last, *given), (first, *initials, last), (last, first, *initials), (f"{re.escape(words[0][0])}\\.", last)]
        out += [f"(?i:{_between(*order)})" for order in dict.fromkeys(orders)]
        # All given names as initials, with a point or white space after each, the family name first or last.
        every = [re.escape(w[0]) for w in words[:-1]]
        if len(every) > 1:
            dotted = r"(?:\.\s*|\s+)".join(every)
            out += [f"(?i:{dotted}(?:\\.\\s*|\\s+){last})", f"(?i:{_between(last, dotted)})\\.?"]
        else:
            out += [f"(?i:{every[0]}\\.{last})", f"(?i:{_between(last, every[0])})\\."]
        if len(words[-1]) > 3 and words[-1].lower() not in COMMON_WORDS:
            # A family name alone, unless it is the beginning of a firm's.
            out.append(re.escape(words[-1].title()) + rf"(?!\s*(?:&|,?\s(?i:and\s+(?:co|sons|partners)|{'|'.join(sorted(LEGAL_FORMS))})\b))")
    if kind == "COMPANY":
        core = list(words)
        while len(core) > 1 and core[-1].rstrip(".").lower().replace(".", "") in LEGAL_FORMS:
            core.pop()
        if core != words:
            out.append(f"(?i:{_between(*map(re.escape, core))})(?:(?:\\s*,\\s*|\\s+)(?i:{'|'.join(sorted(LEGAL_FORMS))})\\b\\.?)?")
        if len(core) > 1 and len(core[0]) > 3 and core[0].lower() not in COMMON_WORDS:
            out.append(re.escape(core[0]))
    return out


#: What names are made of and do not stand within; the last two letters are s and k in another case.
LETTERS = "A-Za-z0-9\u017f\u212a"


@dataclass(frozen=True)
class Writing:
    """One way to write a name: its source, which is compiled when it is first tried, how many characters stand before its first word, and the words of its alternatives in order."""

    kind: str
    source: str
    lead: int
    paths: tuple[tuple[str, ...], ...]

    @property
    def pattern(self) -> re.Pattern:
        return bounded(self.source)


@lru_cache(1 << 16)
def bounded(pattern: str) -> re.Pattern:
    return re.compile(rf"(?<![{LETTERS}])(?:{pattern})(?![{LETTERS}])")


#: What a pattern of a name can hold besides its words, to tell the words from it; and runs of letters and digits.
SYNTAX = re.compile(r"\(\?!.*|\(\?i:|\(\?:\\s\*,\\s\*\|\\s\+\)|\(\?:\\\.\\s\*\|\\s\+\)|\\s[*+]|\)|\?", re.S)
RUN = re.compile(f"[{LETTERS}]+")


def all_writings(names: list[tuple[str, str]]) -> list[Writing]:
    """All writings of all names, in the order of `entity_rules`."""
    out = []
    for kind, name in names:
        for pattern in writings(kind, name):
            out.append(Writing(kind, pattern, *words_of(kind, name, pattern)))
    return out


def words_of(kind: str, name: str, pattern: str) -> tuple[int, tuple[tuple[str, ...], ...]]:
    """How far the first word is from the start of what a pattern matches, and its words; an identifier has them once for each number of zeros, and the legal form that may follow a company is not among them."""
    if kind == "IDENTIFIER":
        bare = name.lstrip("0") or "0"
        words = RUN.findall(bare)
        if not words or not RUN.match(bare):
            return 0, ()
        return 0, tuple(("0" * k + words[0], *words[1:]) for k in range(max(0, 10 - len(bare)) + 1))
    bare = re.sub(r"\\(.)", r"\1", SYNTAX.sub(lambda m: " ", pattern.split("(?:(?:\\s*,")[0]))
    first = RUN.search(bare.lstrip())
    return (first.start() if first else 0), ((tuple(RUN.findall(bare)),) if first else ())


def entity_rules(names: list[tuple[str, str]]) -> list[Finder]:
    """Finders of (kind, name): COMPANY and PERSON in any case and with white space free, TICKER as listed, in capitals or with one, IDENTIFIER with leading zeros or without. One for each writing; `names.Names` finds the same for all of them at once."""

    def finder(kind: str, pattern: re.Pattern) -> Finder:
        return lambda text: ((m.start(), m.end(), kind) for m in pattern.finditer(text))

    return [finder(kind, bounded(p)) for kind, name in names for p in writings(kind, name)]


#: Passes over a text at most. Each looks at what is not yet covered, as a text of its own.
PASSES = 4


def chosen(found: Iterable[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Of (start, end, rank, kind) those that do not overlap: leftmost, then longest, then of the least rank."""
    out, at = [], 0
    for a, b, _, kind in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if a >= at and b > a:
            out.append((a, b, kind))
            at = b
    return out


def spans(text: str, rules: list[Finder], find: Callable[[str], Iterable[tuple[int, int, int, str]]] | None = None, passes: int = PASSES) -> list[tuple[int, int, str]]:
    """What the rules find, without overlaps. A find that lost to an overlapping one may leave a part of it bare, so what is not covered is looked through again until nothing is found there, or `passes` times in all. `find` comes before the rules."""

    def found(part: str) -> Iterator[tuple[int, int, int, str]]:
        first = list(find(part)) if find else []
        yield from first
        before = 1 + max((k for _, _, k, _ in first), default=-1)
        yield from ((a, b, before + k, kind) for k, rule in enumerate(rules) for a, b, kind in rule(part))

    out: list[tuple[int, int, str]] = []
    bare = [(0, len(text))]
    for _ in range(passes):
        news = [(start + a, start + b, kind) for start, end in bare for a, b, kind in chosen(found(text[start:end]))]
        if not news:
            break
        out = sorted(out + news)
        bare = gaps(text, out)
    return out


def gaps(text: str, covered: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The stretches between spans that hold a letter or a digit."""
    edges = [0, *(x for a, b, _ in covered for x in (a, b)), len(text)]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if RUN.search(text, a, b)]


def mask(text: str, rules: list[Finder], find: Callable[[str], Iterable[tuple[int, int, int, str]]] | None = None) -> tuple[str, int]:
    """The text with numbered placeholders, the same number for the same writing of a kind, and how many spans there were."""
    found = spans(text, rules, find)
    numbers: dict[tuple[str, str], int] = {}
    told: Counter[str] = Counter()
    out, at = [], 0
    for a, b, kind in found:
        key = kind, " ".join(text[a:b].lower().split())
        if key not in numbers:
            told[kind] += 1
        n = numbers.setdefault(key, told[kind])
        out += [text[at:a], f"[{kind}_{n}]"]
        at = b
    return "".join([*out, text[at:]]), len(found)


def masked(docs: DataFrame, names: list[tuple[str, str]] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text with dates, periods and the named entities masked, and n_masked. A null text stays null."""
    kind, listed = docs.schema[id_col].dataType.simpleString(), list(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidemark.operators.names import Names

        find = Names(listed).find if listed else None  # compiled once a task
        for batch in batches:
            told = [mask(t, RULES, find) if isinstance(t, str) else (None, 0) for t in batch[text_col]]
            yield pd.DataFrame({id_col: batch[id_col], "text": [t for t, _ in told], "n_masked": [n for _, n in told]})

    return of_texts(docs.select(id_col, text_col)).mapInPandas(run, f"{id_col} {kind}, text string, n_masked int")


def leaks(docs: DataFrame, literals: list[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What still tells a time or a name, by its own patterns and in DataFrame functions: id, kind, found."""
    patterns = {"year": r"(?<![\d.,$€£¥#A-Za-z])(?:19|20)\d{2}(?![\dA-Za-z])", "date": r"\d{4}-\d{2}-\d{2}", "quarter": r"(?i)\bQ[1-4]\b"} | {f"literal:{x}": f"(?i)(?<![A-Za-z0-9])\\Q{x}\\E(?![A-Za-z0-9])" for x in literals}
    found = [F.transform(F.regexp_extract_all(text_col, F.lit(p), F.lit(0)), _kind(k)) for k, p in patterns.items()]
    return docs.select(id_col, F.inline(F.concat(*found)))


#: What the scan of masked texts looks for, in the order of severity: what tells a time or a name for sure, and what may.
LEAK, REVIEW = "LEAK", "REVIEW"
SIGNS = {
    "date": (LEAK, re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")),
    "quarter": (LEAK, re.compile(r"(?i)\bQ[1-4]\b", re.A)),
    "year": (REVIEW, re.compile(r"(?<![\d.,$€£¥#A-Za-z])(?:19|20)[0-9]{2}(?![0-9A-Za-z])", re.A)),
}


def findings(docs: DataFrame, literals: list[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, kind, start, end, severity and found: every sign of a time or of one of the literals, with its place, numbered in order of place. It shares nothing with the rules that mask. A null text has none."""
    kind = docs.schema[id_col].dataType.simpleString()
    signs = SIGNS | {f"literal:{x}": (LEAK, re.compile(rf"(?i)(?<![A-Za-z0-9]){re.escape(x)}(?![A-Za-z0-9])")) for x in literals}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t in zip(batch[id_col], batch[text_col], strict=True):
                told = sorted((m.start(), m.end(), k, s, m[0]) for k, (s, p) in signs.items() for m in p.finditer(t or ""))
                rows += [(i, n, k, a, b, s, x) for n, (a, b, k, s, x) in enumerate(told)]
            yield pd.DataFrame(rows, columns=[id_col, "n", "kind", "start", "end", "severity", "found"])

    return of_texts(docs.select(id_col, text_col)).mapInPandas(run, f"{id_col} {kind}, n int, kind string, start int, end int, severity string, found string")


def _kind(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("found"))


def cache_key(*parts: str) -> str:
    """BLAKE2b of length-prefixed parts."""
    h = hashlib.blake2b(digest_size=32, person=b"tidemark-cache")
    for p in parts:
        data = p.encode()
        h.update(len(data).to_bytes(8, "big") + data)
    return h.hexdigest()


def with_cache(calls: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """calls with their cached answer, and the hit rate."""
    got = calls.join(cache, key, "left").withColumn("hit", F.col("answer").isNotNull())
    return got, got.agg(F.count("*").alias("calls"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def diff(before: str, after: str) -> list[str]:
    """A unified diff of two prompts."""
    return list(difflib.unified_diff(before.splitlines(), after.splitlines(), "before", "after", lineterm=""))


def validated(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """Answers that must be a JSON object with just tone in [-1, 1], confidence in [0, 1] and topic: the values, or why not."""
    body = F.col(text_col)
    keys = F.json_object_keys(body)
    got = F.from_json(body, "tone double, confidence double, topic string")
    why = (
        F.when(keys.isNull(), "not an object")
        .when(F.size(F.array_except(keys, F.array(F.lit("tone"), F.lit("confidence"), F.lit("topic")))) > 0, "unknown key")
        .when(got["tone"].isNull() | got["confidence"].isNull() | got["topic"].isNull(), "missing value")
        .when(~got["tone"].between(-1, 1) | ~got["confidence"].between(0, 1), "out of range")
    )
    ok = why.isNull()
    return answers.select("*", F.when(ok, got["tone"]).alias("tone"), F.when(ok, got["confidence"]).alias("confidence"), F.when(ok, got["topic"]).alias("topic"), F.coalesce(why, F.lit("ok")).alias("status"))
