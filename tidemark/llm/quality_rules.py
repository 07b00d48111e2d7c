"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a native boolean expression over measures of a text; a measure may need others, down
to the text itself.  On a bounded sample one scan tells which rules reject each document and how
much text, words and lines it has.  From these the rules are put in order: next is always the
rule with the most rejections for its cost among the sampled documents that all rules before it
keep, and its cost is that of the measures that no rule before it has made.

The cascade is a row of columns.  Every measure that is not asked for in the result is made
only for documents that no earlier rule has rejected, and once, however many rules use it. The
order changes the cost and the rule that is named, never which documents are kept.

Defined results: a null text is an empty text; an empty text has no words and fails the
word-count rule; repeated rows are judged row by row; an empty table gives an empty result;
columns other than the id and the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
#: Rows on which costs and selectivities are estimated; it bounds the sample, not the result.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 20_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, though body names it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))


def window_hashes(words: Column, width: int) -> Column:
    """A hash of every `width` consecutive words; none if there are fewer."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) >= width, hashes).otherwise(F.array().cast("array<bigint>"))


def _with_a_twin(ordered: Column, kind: str) -> Column:
    """The (key, i) structs of a sorted array whose key equals that of a neighbour."""
    none = F.array(F.lit(None).cast(f"struct<k:{kind},i:int>"))
    rest = F.greatest(F.size(ordered) - 1, F.lit(0))
    near = F.arrays_zip(ordered.alias("x"), F.concat(F.slice(ordered, 2, rest), none).alias("y"), F.concat(none, F.slice(ordered, 1, rest)).alias("z"))
    twin = F.filter(near, lambda t: F.coalesce(t["x"]["k"] == t["y"]["k"], F.lit(False)) | F.coalesce(t["x"]["k"] == t["z"]["k"], F.lit(False)))
    return F.transform(twin, lambda t: t["x"]["i"])


def repeated_window_words(words: Column, hashes: Column, width: int = 5) -> Column:
    """Words that lie in a window of `width` words which occurs at least twice, first occurrence included.

    Equal windows have equal hashes, so distinct hashes prove that nothing repeats; in the
    other documents the windows whose hashes repeat are compared themselves.
    """

    def covered(starts: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(F.sort_array(starts), start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])

    def exact() -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("k"), i.alias("i"))))
        maybe = let(keyed, lambda o: _with_a_twin(o, "bigint"))
        texts = F.sort_array(F.transform(maybe, lambda i: F.struct(F.array_join(F.slice(words, i + 1, width), " ").alias("k"), i.alias("i"))))
        return covered(let(texts, lambda o: _with_a_twin(o, "string")))

    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), exact()).otherwise(F.lit(0))


@dataclass(frozen=True)
class Measure:
    """make: from a lookup of measures to a column; needs: the measures that it looks up; cost: per unit of `per`, in nanoseconds as once measured, which only order the rules."""

    make: Callable[[Callable[[str], Column]], Column]
    needs: tuple[str, ...] = ()
    cost: float = 1.0
    per: str = "chars"


#: Of a document. "text" is given; words, lines and windows are arrays that others need.
MEASURES: dict[str, Measure] = {
    "words": Measure(lambda m: words_of(m("text")), ("text",), 135.0),
    "lines": Measure(lambda m: lines_of(m("text")), ("text",), 16.0),
    "windows": Measure(lambda m: window_hashes(m("words"), 5), ("words",), 1200.0, "words"),
    "n_words": Measure(lambda m: F.size(m("words")), ("words",), 1.0, "rows"),
    "word_chars": Measure(lambda m: F.length(F.array_join(m("words"), "")), ("words",), 30.0, "words"),
    "n_symbols": Measure(lambda m: F.length(m("text")) - F.length(F.regexp_replace(m("text"), "[#*$%&|<>]", "")), ("text",), 45.0),
    "n_dup_lines": Measure(lambda m: F.size(m("lines")) - F.size(F.array_distinct(m("lines"))), ("lines",), 200.0, "lines"),
    "n_repeat_words": Measure(lambda m: repeated_window_words(m("words"), m("windows")), ("words", "windows"), 2100.0, "words"),
    "n_lines": Measure(lambda m: F.size(m("lines")), ("lines",), 1.0, "rows"),
    "n_letters": Measure(lambda m: F.length(F.regexp_replace(m("text"), "\\P{L}+", "")), ("text",), 45.0),
    "n_capitals": Measure(lambda m: F.length(F.regexp_replace(m("text"), "\\P{Lu}+", "")), ("text",), 16.0),
}
#: Those that the digest returns.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """rejects: from a lookup of measures to a boolean column; base rules stay whatever the cascade adds."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Callable[[str], Column]], Column]
    base: bool = False


RULES = (
    Rule("few_words", ("n_words",), lambda m: m("n_words") < 10, base=True),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda m: 100 * m("n_repeat_words") > 20 * m("n_words"), base=True),
    Rule("symbols", ("n_symbols", "n_words"), lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines")),
    Rule("word_length", ("word_chars", "n_words"), lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
    Rule("capitals", ("n_capitals", "n_letters"), lambda m: 2 * m("n_capitals") > m("n_letters")),
    Rule("few_letters", ("n_letters", "word_chars"), lambda m: 10 * m("n_letters") < 6 * m("word_chars")),
)


def look(name: str) -> Column:
    return F.col(f"_{name}")


def missing(needs: tuple[str, ...], known: set[str]) -> list[str]:
    """The measures to make for `needs`, each after those that it needs itself."""
    out: list[str] = []
    for name in needs:
        if name not in known and name not in out:
            out += [x for x in missing(MEASURES[name].needs, known) if x not in out] + [name]
    return out


def with_measures(texts: DataFrame, needs: tuple[str, ...], known: set[str], only: Column | None = None) -> DataFrame:
    """texts (column _text) with a column for each measure that is not known yet; null where `only` does not hold. Columns, since an expression inside a lambda is computed for every element."""
    for name in missing(needs, known):
        value = MEASURES[name].make(look)
        texts = texts.withColumn(f"_{name}", value if only is None else F.when(only, value))
        known.add(name)
    return texts


def sampled(texts: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[frozenset[str], dict[str, int]]]:
    """Of at most `rows` texts of up to SAMPLE_CHARS characters: the rules that reject each and its sizes.

    Rules run in the JVM on as few partitions as hold the sample; only flags and sizes return.
    """
    short = texts.where(F.length("_text") <= SAMPLE_CHARS).sample(False, 0.1, 7)
    all_of = with_measures(short, ("words", "lines", *[n for r in rules for n in r.needs]), {"text"})
    flags = [F.coalesce(r.rejects(look), F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)]
    told = all_of.select(*flags, F.length("_text").alias("chars"), F.size("_words").alias("words"), F.size("_lines").alias("lines")).take(rows)
    return [(frozenset(r.name for k, r in enumerate(rules) if row[f"r{k}"]), {"rows": 1, "chars": row["chars"], "words": row["words"], "lines": row["lines"]}) for row in told]


def in_order(estimates: list[tuple[Rule, float, float]]) -> list[Rule]:
    """(rule, cost, share rejected): most rejections per cost first; ties by name."""
    return [r for r, cost, share in sorted(estimates, key=lambda x: (-x[2] / max(x[1], 1e-9), x[0].name))]


def cascade(sample: list[tuple[frozenset[str], dict[str, int]]], rules: tuple[Rule, ...] = RULES, ready: tuple[str, ...] = ()) -> list[Rule]:
    """The rules in order. ready: measures that are made for every document anyway and so cost a rule nothing."""
    known, left, kept, order = {"text"}, list(rules), sample, []
    known |= set(missing(ready, known))
    while left:
        n = max(len(kept), 1)
        cost = lambda rule: 1.0 + sum(MEASURES[m].cost * sum(size[MEASURES[m].per] for _, size in kept) / n for m in missing(rule.needs, known))  # noqa: B023, E731
        best = in_order([(r, cost(r), sum(r.name in out for out, _ in kept) / n) for r in left])[0]
        order.append(best)
        left.remove(best)
        known |= set(missing(best.needs, known))
        kept = [x for x in kept if best.name not in x[0]]
    return order


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, measures: tuple[str, ...] = BASE) -> DataFrame:
    """id, the measures asked for (longs, of every document), kept and rejected_by (the first rule of the cascade that rejects; null if kept).

    base_failed, whether a base rule rejects, comes with them if the measures of the base rules are asked for. With
    measures=() a document pays for the rules up to its first rejection and no further.
    """
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    order = cascade(sampled(texts.select("_text"), rules, sample_rows), rules, measures)
    known = {"text"}
    told = with_measures(texts, measures, known).withColumn("_rejected_by", F.lit(None).cast("string"))
    open_ = F.col("_rejected_by").isNull()
    for rule in order:
        told = with_measures(told, rule.needs, known, open_)
        told = told.withColumn("_rejected_by", F.when(open_ & rule.rejects(look), F.lit(rule.name)).otherwise(F.col("_rejected_by")))
    firm = [r for r in rules if r.base]
    failed = [F.coalesce(F.greatest(F.lit(False), *[r.rejects(look) for r in firm]), F.lit(False)).alias("base_failed")] if all(n in measures for r in firm for n in r.needs) else []
    return told.select(id_col, *[look(n).cast("long").alias(n) for n in measures], *failed, open_.alias("kept"), F.col("_rejected_by").alias("rejected_by"))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rejected_by")
