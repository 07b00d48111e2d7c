"""What models say about texts: answers of five forms, prompts and their versions, runs over chunks, and differences between filings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.batches import of_texts
from tidemark.operators import text
from tidemark.operators.facts import Refused, baseline_of, refuse


@dataclass(frozen=True)
class Field:
    """kind: shift in [-1, 1], level in [0, 1], count (whole, zero or more), flag, choice (one of `among`) or quotes (at most `among[0]` strings)."""

    name: str
    kind: str
    among: tuple[str, ...] = ()


def form(*fields: str) -> tuple[Field, ...]:
    """Fields from lines of name, kind, and choices or the most quotes."""
    return tuple(Field(n, k, tuple(c)) for n, k, *c in (x.split() for x in fields))


#: The fields of the answers to five tasks.
FORMS = {
    "risk_language": form("severity_shift shift", "hedging_shift shift", "specificity_shift shift", "evidence quotes 8", "confidence level"),
    "guidance": form("tone_shift shift", "magnitude_direction choice raised reiterated lowered withdrawn absent", "magnitude_size level", "tone_magnitude_gap shift", "evidence quotes 8", "confidence level"),
    "evasiveness": form("evasiveness_shift shift", "specificity_shift shift", "declined_questions_current count", "declined_questions_prior count", "evidence quotes 8", "confidence level"),
    "accounting": form("aggressiveness_shift shift", "estimate_reliance_shift shift", "non_gaap_emphasis_shift shift", "policy_change_disclosed flag", "evidence quotes 8", "confidence level"),
    "risk_set": form("added quotes 40", "removed quotes 40", "retained_count count", "confidence level"),
}
TYPES = {"shift": "double", "level": "double", "count": "bigint", "flag": "boolean", "choice": "string", "quotes": "array<string>"}
#: The types that a JSON value of each kind has.
WRITTEN = {"shift": "^(BIGINT|DOUBLE|DECIMAL.*)$", "level": "^(BIGINT|DOUBLE|DECIMAL.*)$", "count": "^BIGINT$", "flag": "^BOOLEAN$", "choice": "^STRING$", "quotes": "^ARRAY<(STRING|VOID)>$"}


def parsed(answers: DataFrame, fields: tuple[Field, ...], text_col: str = "answer") -> DataFrame:
    """answers with value (a struct of the fields, null unless all is well) and status: ok, not an object, unknown key, missing value, wrong type or out of range.

    Strict: a number in quotes is no number, a whole number has no fraction, keys other than the fields are refused, and an error is a row.
    """
    names = [f.name for f in fields]
    told = answers.withColumn("_json", F.try_parse_json(text_col))
    keys = F.json_object_keys(F.when(F.schema_of_variant("_json").startswith("OBJECT"), F.col(text_col)))
    kinds = [F.coalesce(F.schema_of_variant(F.try_variant_get("_json", f"$.{n}", "variant")), F.lit("VOID")) for n in names]
    told = told.select(*answers.columns, "_json", keys.alias("_keys"), *[k.alias(f"_k{i}") for i, k in enumerate(kinds)])
    lacks = mistyped = outside = F.lit(False)
    for i, f in enumerate(fields):
        v, kind = F.try_variant_get("_json", f"$.{f.name}", TYPES[f.kind]), F.col(f"_k{i}")
        lacks = lacks | (kind == "VOID")
        mistyped = mistyped | ~kind.rlike(WRITTEN[f.kind])
        ok = {"shift": v.between(-1, 1), "level": v.between(0, 1), "count": v >= 0, "choice": v.isin(*f.among)}.get(f.kind) if f.kind not in ("flag", "quotes") else F.size(v) <= int(f.among[0]) if f.kind == "quotes" else None
        outside = outside if ok is None else outside | ~F.coalesce(ok, F.lit(False))
    why = F.when(F.col("_keys").isNull(), "not an object").when(F.size(F.array_except("_keys", F.array(*[F.lit(n) for n in names]))) > 0, "unknown key").when(lacks, "missing value").when(mistyped, "wrong type").when(outside, "out of range")
    value = F.struct(*[F.try_variant_get("_json", f"$.{f.name}", TYPES[f.kind]).alias(f.name) for f in fields])
    return told.withColumn("status", F.coalesce(why, F.lit("ok"))).select(*answers.columns, "status", F.when(F.col("status") == "ok", value).alias("value"))


#: From a prompt to an answer: a model, or what stands for one, as a column.
Model = Callable[[Column], Column]


def extracted(docs: DataFrame, template: str, fields: tuple[Field, ...], model: Model, cache: DataFrame | None = None, names: list[tuple[str, str]] = (), most: int = text.MAX_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk, key, cached, answer, status and value of every chunk of the masked texts.

    Mask, cut, look up the digest of template and chunk in the cache (key, answer), ask the model for the rest, and check what it says. `{text}`
    in the template stands for the chunk. A null or empty text has no chunks.
    """
    if "{text}" not in template:
        raise Refused("the template has no place for the text")
    masked = text.masked(docs, list(names), id_col, text_col).select(id_col, F.col("text").alias(text_col))
    cut = text.chunks(masked, most, id_col, text_col)
    before, after = template.split("{text}", 1)
    asked = cut.select(id_col, "chunk", F.concat(F.lit(before), F.col("text"), F.lit(after)).alias("_prompt"))
    asked = asked.withColumn("key", F.sha2(F.concat_ws("\x1f", F.lit(len(template)).cast("string"), "_prompt"), 256))
    known = asked.join(cache.groupBy("key").agg(F.min("answer").alias("_known")), "key", "left") if cache is not None else asked.withColumn("_known", F.lit(None).cast("string"))
    told = known.select(id_col, "chunk", "key", F.col("_known").isNotNull().alias("cached"), F.when(F.col("_known").isNotNull(), F.col("_known")).otherwise(model(F.col("_prompt"))).alias("answer"))
    return parsed(told, fields)


def deltas(filings: DataFrame, answers: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """A row for every filing (seq, cik, form, valid_from, knowledge_time): measured with its value, rejected with the reason, unanswered, or no comparison where no earlier filing of its kind was known.

    answers (seq, baseline, answer) must be about the pair that the filing resolves to; one about another pair is refused.
    """
    pairs = baseline_of(filings, ("cik", "form")).select("seq", "cik", "form", "baseline")
    told = parsed(answers.select("seq", F.col("baseline").alias("_about"), "answer"), fields)
    joined = pairs.join(told, "seq", "left")
    joined = refuse(joined, F.col("answer").isNotNull() & ~F.col("_about").eqNullSafe(F.col("baseline")), "an answer about another pair of filings")
    kind = F.when(F.col("baseline").isNull(), "no comparison").when(F.col("answer").isNull(), "unanswered").when(F.col("status") == "ok", "measured").otherwise("rejected")
    return joined.select("seq", "cik", "form", "baseline", kind.alias("outcome"), F.when((F.col("status") != "ok") & F.col("answer").isNotNull() & F.col("baseline").isNotNull(), F.col("status")).alias("reason"), F.when(F.col("baseline").isNotNull(), F.col("value")).alias("value"))


def prompt_versions(saved: DataFrame) -> DataFrame:
    """saved (name, saved_at, body) numbered by name in the order of saving, with the digest of the body; a body that was saved before under the name keeps its first version."""
    digest = F.sha2(F.col("body"), 256)
    first = saved.withColumn("digest", digest).groupBy("name", "digest").agg(F.min("saved_at").alias("saved_at"), F.min("body").alias("body"))
    return first.select("name", F.row_number().over(Window.partitionBy("name").orderBy("saved_at", "digest")).alias("version"), "saved_at", "digest", "body")


def active_prompts(versions: DataFrame, activations: DataFrame) -> DataFrame:
    """name, version and body of the version that was activated last (sequence); a rollback is an activation of an earlier one. An activation of a version that does not exist is refused."""
    known = activations.join(versions.select("name", "version", F.lit(True).alias("_ok")), ["name", "version"], "left")
    known = refuse(known, F.col("_ok").isNull(), "an activation of a version that does not exist")
    last = known.groupBy("name").agg(F.max_by("version", "sequence").alias("version"))
    return last.join(versions, ["name", "version"]).select("name", "version", "body")


def golden_verdicts(scores: DataFrame, threshold: float) -> DataFrame:
    """scores (name, version, case, passed) to the share of cases passed and the verdict: promote at the threshold or above, hold below, and no verdict without cases that were scored."""
    told = scores.groupBy("name", "version").agg(F.count("passed").alias("n"), F.avg(F.col("passed").cast("double")).alias("share"))
    return told.withColumn("verdict", F.when(F.col("n") == 0, "none").when(F.col("share") >= threshold, "promote").otherwise("hold"))


def prompt_diffs(versions: DataFrame) -> DataFrame:
    """name, version, added and removed: the lines that a version has and its predecessor lacks, and the other way round, as sets in order."""
    lines = F.split("body", "\n")
    told = versions.select("name", "version", lines.alias("now"), F.lag(lines).over(Window.partitionBy("name").orderBy("version")).alias("was"))
    return told.where("was IS NOT NULL").select("name", "version", F.array_except("now", "was").alias("added"), F.array_except("was", "now").alias("removed"))


def edit_script(before: list[str], after: list[str]) -> list[tuple[str, int, int, int, int]]:
    """(keep, delete, insert or replace, from and to in `before`, from and to in `after`) that tile both, from a longest common subsequence: the furthest reaching paths by number of edits."""
    n, m = len(before), len(after)
    reach, trail = {1: 0}, []
    down = lambda d, k, held: k == -d or k != d and held[k - 1] < held[k + 1]
    for d in range(n + m + 1):
        trail.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if down(d, k, reach) else reach[k - 1] + 1
            while x < n and x - k < m and before[x] == after[x - k]:
                x += 1
            reach[k] = x
        if reach.get(n - m, -1) >= n:
            break
    pairs, x, y = [], n, m
    for d in range(len(trail) - 1, -1, -1):
        k, held = x - y, trail[d]
        came = k + 1 if down(d, k, held) else k - 1
        px = held[came]
        while x > px and y > px - came:
            x, y = x - 1, y - 1
            pairs.append((x, y))
        x, y = px, px - came
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for a, b in [*reversed(pairs), (n, m)]:
        if i < a or j < b:
            out.append(("insert" if i == a else "delete" if j == b else "replace", i, a, j, b))
        if a < n and b < m:
            if out and out[-1][0] == "keep" and out[-1][2] == a and out[-1][4] == b:
                out[-1] = "keep", out[-1][1], a + 1, out[-1][3], b + 1
            else:
                out.append(("keep", a, a + 1, b, b + 1))
        i, j = a + 1, b + 1
    return out


def applied(before: list[str], script: list[tuple[str, int, int, int, int]], after: list[str]) -> list[str]:
    """What a script makes of `before`, taking from `after` only what it inserts."""
    return [x for op, a, b, c, d in script for x in (before[a:b] if op == "keep" else after[c:d])]


def prompt_edits(versions: DataFrame) -> DataFrame:
    """name, version, n, op, was_from, was_to, now_from, now_to: the aligned edit script by lines from the version before it to each version. Order and repeats of lines count. Bodies are prompts, which a person reads; work grows with their lines times their differences."""
    told = versions.select("name", "version", "body", F.lag("body").over(Window.partitionBy("name").orderBy("version")).alias("was"), F.lag("version").over(Window.partitionBy("name").orderBy("version")).alias("older")).where("older IS NOT NULL")
    kinds = {c: versions.schema[c].dataType.simpleString() for c in ("name", "version")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(name, version, n, *step) for name, version, now, was in zip(batch["name"], batch["version"], batch["body"], batch["was"], strict=True) for n, step in enumerate(edit_script((was or "").split("\n"), (now or "").split("\n")))]
            yield pd.DataFrame(rows, columns=["name", "version", "n", "op", "was_from", "was_to", "now_from", "now_to"])

    return of_texts(told.select("name", "version", "body", "was")).mapInPandas(run, f"name {kinds['name']}, version {kinds['version']}, n int, op string, was_from int, was_to int, now_from int, now_to int")
