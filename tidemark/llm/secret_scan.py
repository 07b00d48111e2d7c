"""Secret scan, in DataFrame functions only.

Three patterns find secrets by their form.  Beyond them, two character Markov models, of
random strings and of ordinary identifiers, are trained from labelled samples by counting
transitions; a long token whose log-likelihood ratio speaks for the random model is a secret
as well.

Spark has no function for the places of all matches.  They come from the lengths of what
regexp_extract_all returns for "the text since the last match, then a match", anchored at
the end of the last match, so that each text is passed once.

Defined results: a null text is an empty text without spans; repeated rows are scanned row by
row; an empty table gives an empty result; columns other than the id and the text are ignored.
Spans of different kinds may overlap. Places count code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: The last two keep only what is long enough, which is the same as to drop shorter matches of `+`, since a match takes a whole run.
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "markov": "[A-Za-z0-9+/_=-]{20,}"}
#: A text without a match of these has none of the pattern's, either; they fail fast.
GUARDS = {"assign": "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]", "access": "AKIA[A-Z0-9]{16}", "hex": "(?<![0-9a-f])[0-9a-f]{24}", "markov": "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}"}
BASE = ("assign", "access", "hex")
LEAST_VALUE = 6
#: Log-likelihood ratio from which a token is a secret.
LEAST_RATIO = 8.0
#: States of the models: each small letter, and one each for capitals, digits and the rest.
STATES = "abcdefghijklmnopqrstuvwxyzA0-"
CAPITALS, DIGITS, REST = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-."
#: Matches that are summed in one piece.
PIECE = 256

#: Parts of ordinary identifiers.
IDENTIFIER_WORDS = (
    "account address amount array base batch block buffer build cache call channel check class client code collection column command config connection content context control core count create current customer data database date default delete description device directory document "
    "domain download element email encode engine entry error event example execute export factory field file filter folder format frame function gateway generate group handler header helper history host image import index information input instance interface internal item iterator key language layer "
    "length level library limit link list listener load local location logger manager message method metric model module monitor name network node notification number object operation option order output package page parameter parent parser partition password path payment permission pipeline "
    "plugin pointer position process product profile project property protocol provider proxy query queue reader record reference register remote report repository request resource response result role route row rule schema scope search section security segment select sequence server service session setting "
    "size snapshot source stage start state status storage stream string structure style sub summary support switch table target task template test text thread time title token tool trace transaction transfer transport tree type update upload user utility validate value variable version view visitor window worker writer"
)


def labelled_samples(spark: SparkSession, rows: int = 3000) -> DataFrame:
    """(text, random): strings made by rule, random ones from digests and ordinary ones from joined words."""
    ids = spark.range(rows)
    words = F.split(F.lit(IDENTIFIER_WORDS), " ")
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)) + 1).cast("int"))
    a, b, c, d = (word(k) for k in range(4))
    ordinary = F.element_at(
        F.array(F.concat_ws("_", a, b, c, d), F.concat(a, F.initcap(b), F.initcap(c), F.initcap(d)), F.concat_ws("-", a, b, c), F.concat_ws("/", a, b, c, d), F.upper(F.concat_ws("_", a, b, c)), F.concat(a, b, c, d), F.concat_ws("_", a, b, c, F.lit("v2")), F.concat_ws("-", a, b, F.lit("2024-01-15")), F.repeat(F.element_at(F.split(F.lit("- = _ /"), " "), (F.pmod(F.col("id"), F.lit(4)) + 1).cast("int")), F.lit(24)), F.concat_ws("--", F.lit(""), a, b, c)),
        (F.pmod("id", F.lit(10)) + 1).cast("int"),
    )
    digest = F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512))
    coded = F.base64(digest)
    random = F.element_at(F.array(F.substring(coded, 1, 40), F.sha1(digest), F.substring(F.lower(coded), 1, 32), F.substring(F.upper(coded), 1, 24)), (F.pmod("id", F.lit(4)) + 1).cast("int"))
    return ids.select(ordinary.alias("text"), F.lit(False).alias("random")).unionAll(ids.select(random.alias("text"), F.lit(True).alias("random")))


def states(text: Column) -> Column:
    """The numbers of a token's states, from 1."""
    told = F.translate(text, CAPITALS + DIGITS + REST, "A" * len(CAPITALS) + "0" * len(DIGITS) + "-" * len(REST))
    return F.transform(F.array_remove(F.split(told, ""), ""), lambda c: F.greatest(F.instr(F.lit(STATES), c), F.lit(1)))


def train(samples: DataFrame) -> list[float]:
    """log P(next | state, random) - log P(next | state, ordinary), row by row; null texts train nothing. What returns to the driver is one count for each pair of states."""
    seen = samples.where("text is not null").select("random", states(F.col("text")).alias("s"))
    pairs = seen.select("random", F.explode(F.arrays_zip(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))).alias("a"), F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))).alias("b"))).alias("p"))
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in pairs.groupBy("random", "p.a", "p.b").agg(F.count("*").alias("n")).collect()}
    n = len(STATES)

    def log_p(random: bool, a: int, b: int) -> float:
        row = sum(counts.get((random, a, x), 0) for x in range(1, n + 1))
        return math.log((counts.get((random, a, b), 0) + 0.5) / (row + 0.5 * n))

    return [round(log_p(True, a, b) - log_p(False, a, b), 6) for a in range(1, n + 1) for b in range(1, n + 1)]


def ratio(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a token."""
    cells, n = F.expr(f"array({', '.join(f'{x!r}D' for x in table)})"), len(STATES)
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))
    step = lambda acc, s: F.struct(s.alias("at"), (acc["sum"] + F.when(acc["at"] > 0, F.element_at(cells, (acc["at"] - 1) * n + s)).otherwise(F.lit(0.0))).alias("sum"))
    return F.aggregate(states(token), start, step, lambda acc: acc["sum"])


def _found(df: DataFrame, kind: str) -> DataFrame:
    """df with _kind: array of (start, end, text, value) of the matches of a kind.  Each step is a column, since an expression inside a lambda is computed for every element."""
    pattern, empty = F.lit(f"\\G([\\s\\S]*?)(?:{PATTERNS[kind]})"), F.array().cast("array<string>")
    all_of = lambda group: F.when(F.col("_text").rlike(GUARDS[kind]), F.regexp_extract_all("_text", pattern, F.lit(group))).otherwise(empty)
    df = df.withColumns({"_full": all_of(0), "_gap": all_of(1), "_value": all_of(3) if kind == "assign" else empty})
    df = df.withColumn("_lens", F.transform("_full", F.length))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("_lens") - 1) / PIECE).cast("int"))), lambda k: F.slice("_lens", k * PIECE + 1, PIECE))
    df = df.withColumn("_pieces", pieces)
    summed = lambda values, first: F.aggregate(
        values, F.struct(first.alias("s"), F.array().cast("array<int>").alias("a")), lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")), lambda acc: acc["a"]
    )
    df = df.withColumn("_sums", F.transform("_pieces", lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)))
    df = df.withColumn("_before", F.concat(F.array(F.lit(0)), summed(F.col("_sums"), F.lit(0))))
    df = df.withColumn("_ends", F.flatten(F.transform("_pieces", lambda p, k: summed(p, F.element_at(F.col("_before"), k + 1)))))
    rows = F.arrays_zip("_full", "_gap", "_ends", "_value")
    spans = F.transform(
        rows, lambda r: F.struct((r["_ends"] - F.length(r["_full"]) + F.length(r["_gap"])).alias("start"), r["_ends"].alias("end"), F.substr(r["_full"], F.length(r["_gap"]) + 1).alias("text"), r["_value"].alias("value"))
    )
    return df.withColumn(f"_{kind}", spans).drop("_full", "_gap", "_value", "_lens", "_pieces", "_sums", "_before", "_ends")


def secret_spans(docs: DataFrame, samples: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", least_ratio: float = LEAST_RATIO) -> DataFrame:
    """id, text and one array of (start, end) for each kind: assign, access, hex and markov."""
    table = train(labelled_samples(docs.sparkSession) if samples is None else samples)
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    for kind in PATTERNS:
        df = _found(df, kind)
    keeps = {"assign": lambda s: F.length(s["value"]) >= LEAST_VALUE, "access": lambda s: F.lit(True), "hex": lambda s: F.lit(True), "markov": lambda s: ratio(s["text"], table) >= least_ratio}
    bare = lambda kind: F.transform(F.filter(f"_{kind}", keeps[kind]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return df.select(id_col, F.col("_text").alias("text"), *[bare(kind).alias(kind) for kind in PATTERNS])


def span_list(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""

    def named(k: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    told = [named(k, kind) for k, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.sort_array(F.concat(*told)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def without_secrets(docs: DataFrame, samples: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", chars_col: str | None = None) -> DataFrame:
    """docs with every secret in the text replaced by a mark; texts without secrets, nulls included, stay as they are. chars_col: a column that holds the length of the text, kept true."""
    row = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_body"))
    found = secret_spans(row, samples, "_row", "_body")
    spans = F.sort_array(F.concat(*[F.col(kind) for kind in PATTERNS]))
    df = found.select("_row", "text", spans.alias("_spans"))
    # Spans in pieces of PIECE, each with the text from where the spans before it end to where its own do: no span looks at the whole text, and none copies what came before.
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("_spans") - 1) / PIECE).cast("int"))), lambda k: F.slice("_spans", k * PIECE + 1, PIECE))
    df = df.withColumn("_pieces", pieces).withColumn("_ends", F.transform("_pieces", lambda p: F.coalesce(F.array_max(F.transform(p, lambda s: s["end"])), F.lit(0))))
    reach = F.aggregate("_ends", F.array(F.lit(0)), lambda acc, e: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), e))))
    df = df.withColumn("_reach", reach).withColumn("_parts", F.transform("_pieces", lambda p, k: F.struct(p.alias("spans"), F.element_at("_reach", k + 1).alias("at"), F.substr("text", F.element_at("_reach", k + 1) + 1, F.element_at("_reach", k + 2) - F.element_at("_reach", k + 1)).alias("text"))))

    def told_of(part: Column) -> Column:
        """Text up to each span that begins beyond all before it; spans that overlap share a mark."""
        start = F.struct(part["at"].alias("end"), F.array().cast("array<string>").alias("parts"))

        def step(acc: Column, s: Column) -> Column:
            piece = F.concat(F.substr(part["text"], acc["end"] - part["at"] + 1, s["start"] - acc["end"]), F.lit(mark))
            return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), F.when(s["start"] >= acc["end"], F.concat(acc["parts"], F.array(piece))).otherwise(acc["parts"]).alias("parts"))

        return F.aggregate(part["spans"], start, step, lambda acc: F.array_join(acc["parts"], ""))

    clean = F.concat(F.array_join(F.transform("_parts", told_of), ""), F.substr("text", F.element_at("_reach", -1) + 1))
    df = df.withColumn("_clean", F.when(F.size("_spans") > 0, clean).otherwise(F.col(f"_row.{text_col}")))
    told = {text_col: F.col("_clean")} | ({chars_col: F.length("_clean").cast(docs.schema[chars_col].dataType)} if chars_col else {})
    return df.select(*[told.get(c, F.col(f"_row.{c}")).alias(c) for c in docs.columns])


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sizes = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *sizes, F.sha2(span_list(BASE), 256).alias("base_sha256"), span_list(tuple(PATTERNS)).alias("spans"))
