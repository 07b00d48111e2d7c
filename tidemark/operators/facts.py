"""Versioned (bitemporal) facts and the only way to read them: as of an instant."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.operators.guard import Refused, every, kind, plans_in, read_only, relations

#: The open end of an interval, and its opposite.
INFINITY = dt.datetime(9999, 12, 31, 23, 59, 59, 999999, tzinfo=dt.UTC)
MINUS_INFINITY = dt.datetime(1, 1, 1, tzinfo=dt.UTC)
TEMPORAL = ("valid_from", "valid_to", "knowledge_time", "is_retraction")


@dataclass(frozen=True)
class FactSpec:
    """A fact table: its logical key, its payload, the payload that an observation must have, and what breaks ties of equal knowledge times."""

    name: str
    key: tuple[str, ...]
    payload: tuple[str, ...]
    required: tuple[str, ...] = ()
    tie: tuple[str, ...] = ()


def instant(at: dt.datetime, now: dt.datetime | None = None, what: str = "as_of") -> dt.datetime:
    """`at` if it is aware, in UTC and not in the future."""
    if at.tzinfo is None or at.utcoffset() is None:
        raise Refused(f"{what} must be timezone-aware UTC; got {at!r}")
    if at.utcoffset() != dt.timedelta(0):
        raise Refused(f"{what} must have offset 0; got {at.utcoffset()}")
    if at > (now or dt.datetime.now(dt.UTC)):
        raise Refused(f"{what} may not lie in the future: {at.isoformat()}")
    return at


def literal(at: dt.datetime, like: str) -> Column:
    """The instant as a literal of a column's type, with or without a zone."""
    text = at.astimezone(dt.UTC).strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz") if like == "timestamp_ntz" else F.lit(at)


def refuse(df: DataFrame, when: Column, message: str) -> DataFrame:
    """df, which fails as a whole if a row meets the condition."""
    return df.where(F.when(F.coalesce(when, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def visible(facts: DataFrame, spec: FactSpec, as_of: dt.datetime, columns: tuple[str, ...] | None = None) -> DataFrame:
    """What was known at `as_of`: of each key and valid_from the version learned last, unless that is a retraction.

    One aggregation with partial maxima; the filter on knowledge_time reaches the scan, and only
    the columns asked for are carried. Retractions go after the winner is chosen, not before.
    """
    kind = dict(facts.dtypes)["knowledge_time"]
    wanted = [c for c in (columns or (*spec.payload, "valid_to", "knowledge_time")) if c not in (*spec.key, "valid_from")]
    carried = list(dict.fromkeys([*wanted, "is_retraction"]))
    known = facts.where(F.col("knowledge_time") <= literal(as_of, kind))
    won = known.groupBy(*spec.key, "valid_from").agg(F.max_by(F.struct(*carried), F.struct("knowledge_time", *spec.tie)).alias("_won"))
    return won.where("NOT _won.is_retraction").select(*spec.key, "valid_from", *[F.col(f"_won.{c}").alias(c) for c in wanted])


def in_force(facts: DataFrame, at: Column) -> DataFrame:
    """Rows whose half-open interval holds the instant."""
    return facts.where((F.col("valid_from") <= at) & (F.col("valid_to") > at))


def violations(facts: DataFrame, spec: FactSpec) -> DataFrame:
    """Rows that break the payload contract or the interval, with the reason: a retraction has no payload, an observation all required payload."""
    filled = F.lit(False)
    for c in spec.payload:
        filled = filled | F.col(c).isNotNull()
    lacks = F.lit(False)
    for c in spec.required:
        lacks = lacks | F.col(c).isNull()
    reason = (
        F.when(F.col("valid_from") >= F.col("valid_to"), "empty interval")
        .when(F.col("is_retraction") & filled, "retraction with payload")
        .when(~F.col("is_retraction") & lacks, "observation without required payload")
    )
    return facts.withColumn("reason", reason).where("reason IS NOT NULL")


@dataclass
class AsOf:
    """Facts as of one instant. Raw tables are not reachable through it: table() and sql() see versions only."""

    spark: SparkSession
    at: dt.datetime
    now: dt.datetime | None = None
    facts: dict[str, tuple[DataFrame, FactSpec]] = field(default_factory=dict)
    plain: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.at = instant(self.at, self.now)

    def with_facts(self, df: DataFrame, spec: FactSpec) -> AsOf:
        return AsOf(self.spark, self.at, self.now, self.facts | {spec.name: (df, spec)}, self.plain)

    def with_plain(self, name: str, df: DataFrame) -> AsOf:
        """A table without versions, such as an identity anchor."""
        if "knowledge_time" in df.columns:
            raise Refused(f"{name} has versions; register it as facts")
        return AsOf(self.spark, self.at, self.now, self.facts, self.plain | {name: df})

    def table(self, name: str, columns: tuple[str, ...] | None = None) -> DataFrame:
        if name in self.plain:
            return self.plain[name]
        if name not in self.facts:
            raise Refused(f"no facts named {name}")
        df, spec = self.facts[name]
        return visible(df, spec, self.at, columns)

    def sql(self, text: str) -> DataFrame:
        """A query whose tables are the registered names, every one of them versioned at the same instant.

        Spark parses the text, and the relations of the parsed plan, those of subqueries and joins by comma included, must be registered
        names or the query's own; a catalog table, a path and anything but a query are refused. Views of the names stand while the query is
        analysed and no longer.
        """
        used = self.references(text)
        if not used:
            raise Refused("the query names no registered table")
        held = self.spark._jsparkSession.sessionState().catalog()
        before = {n: self.spark.table(n) for n in used if held.getTempView(n).isDefined()}
        frames = {n: self.table(n) for n in used}
        try:
            for n, df in frames.items():
                df.createOrReplaceTempView(n)
            told = self.spark.sql(text)
        finally:
            for n in used:
                self.spark.catalog.dropTempView(n)
            for n, df in before.items():
                df.createOrReplaceTempView(n)
        read_only(told, frames)
        return no_retractions(told)

    def references(self, text: str) -> list[str]:
        """The registered names that a query reads; refused if it reads anything else."""
        read, own = relations(self.spark, text)
        names = {n.lower(): n for n in [*self.facts, *self.plain]}
        if hidden := own & set(names):
            raise Refused(f"the query's own names hide registered tables: {sorted(hidden)}")
        if strange := read - set(names):
            raise Refused(f"not registered, so not versioned: {sorted(strange)}")
        return sorted(names[n] for n in read)


def unmasked(df: DataFrame, names: list[str]) -> list[str]:
    """The fact tables among `names` whose view a query reads without the filter that drops retractions right above its versions."""
    out: set[str] = set()
    open_ = [df._jdf.queryExecution().analyzed()]
    while open_:
        node = open_.pop()
        if kind(node) == "View" and (n := str(node.desc().identifier().table()).lower()) in {x.lower() for x in names} and not masks(node.child()):
            out.add(n)
        open_ += [*every(node.children()), *plans_in(node)]
    return sorted(out)


def masks(node) -> bool:
    """Whether a plan is that of visible versions: a projection of a filter that negates the flag of what was chosen."""
    while kind(node) == "Project":
        node = node.child()
    return kind(node) == "Filter" and kind(node.condition()) == "Not" and kind(node.condition().child()) == "GetStructField" and str(node.condition().child().extractFieldName()) == "is_retraction"


def no_retractions(df: DataFrame) -> DataFrame:
    """df, which fails as a whole if a retraction is about to reach the caller; nothing to do where the column is not carried."""
    if "is_retraction" not in df.columns or df.schema["is_retraction"].dataType.simpleString() != "boolean":
        return df
    return refuse(df, F.col("is_retraction"), "a retraction reached the result")


def close_interval(open_rows: DataFrame, spec: FactSpec, valid_to: Column, knowledge_time: Column, now: dt.datetime | None = None) -> DataFrame:
    """Correction rows: the same key, start and payload with a bounded end, learned later."""
    kind = dict(open_rows.dtypes)["valid_to"]
    end, limit = literal(INFINITY, kind), literal(now or dt.datetime.now(dt.UTC), kind)
    for when, message in (
        (F.col("valid_to") != end, "only an interval that is open can be closed"),
        (F.col("is_retraction"), "a retraction has no interval to close"),
        (valid_to <= F.col("valid_from"), "the end must lie after the start"),
        (valid_to >= end, "the end must be bounded"),
        (knowledge_time <= F.col("knowledge_time"), "the correction must be learned later"),
        (knowledge_time > limit, "knowledge from the future"),
    ):
        open_rows = refuse(open_rows, when, message)
    return open_rows.withColumns({"valid_to": valid_to, "knowledge_time": knowledge_time})


def retract(rows: DataFrame, spec: FactSpec, knowledge_time: Column, now: dt.datetime | None = None) -> DataFrame:
    """Rows that withdraw facts: key and interval, no payload."""
    kind = dict(rows.dtypes)["knowledge_time"]
    for when, message in (
        (F.col("is_retraction"), "it is withdrawn already"),
        (knowledge_time <= F.col("knowledge_time"), "the retraction must be learned later"),
        (knowledge_time > literal(now or dt.datetime.now(dt.UTC), kind), "knowledge from the future"),
    ):
        rows = refuse(rows, when, message)
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in spec.payload} | {"knowledge_time": knowledge_time, "is_retraction": F.lit(True)})


def supersede(open_rows: DataFrame, spec: FactSpec, boundary: Column, knowledge_time: Column, changes: dict[str, Column], now: dt.datetime | None = None) -> DataFrame:
    """The closing rows and their successors with the changed payload, open from the boundary on."""
    if not changes or set(changes) - set(spec.payload):
        raise Refused(f"changes must name payload columns: {sorted(changes)}")
    closed = close_interval(open_rows, spec, boundary, knowledge_time, now)
    after = close_interval(open_rows, spec, boundary, knowledge_time, now).withColumns(changes | {"valid_from": boundary, "valid_to": literal(INFINITY, dict(open_rows.dtypes)["valid_to"])})
    return closed.unionByName(after)


def new_rows(batch: DataFrame, target: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows of a batch whose key the target lacks, each key once: what an append that is run again adds."""
    return batch.dropDuplicates(list(key)).join(target.select(*key), list(key), "left_anti")


def baseline_of(rows: DataFrame, key: tuple[str, ...], at: str = "valid_from", known: str = "knowledge_time", id_col: str = "seq") -> DataFrame:
    """rows with baseline, the id of the latest earlier row of the same key that was known at the row's own knowledge time; null if none. Two latest ones are refused.

    One sort by key and time. Along a key only rows are held that can still be a baseline: of two, the later one that was known no later is
    always the better, so those held are sorted by knowledge time and the answer is a binary search. A row without a time has no baseline and is none.
    """
    fields = rows.schema
    place = [fields.names.index(c) for c in (*key, at, known, id_col)]
    n = len(key)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held_at, held_known, held_id = None, [], [], []
        waiting: list[tuple] = []  # rows of one time, which are no baselines of each other

        def push() -> None:
            for a, k, i in waiting:
                while held_known and held_known[-1] > k:
                    del held_at[-1], held_known[-1], held_id[-1]
                held_at.append(a), held_known.append(k), held_id.append(i)
            waiting.clear()

        for batch in batches:
            out = []
            for values in zip(*[batch.column(c).to_pylist() for c in place], strict=True):
                now, (a, k, i) = values[:n], values[n:]
                if now != open_key:
                    open_key, held_at, held_known, held_id = now, [], [], []
                    waiting.clear()
                if a is None or k is None or None in now:
                    out.append(None)
                    continue
                if waiting and waiting[-1][0] != a:
                    push()
                j = bisect_right(held_known, k) - 1
                if j > 0 and held_at[j] == held_at[j - 1]:
                    raise Refused(f"two latest earlier rows of {now} at {held_at[j]}: {held_id[j - 1]} and {held_id[j]}")
                out.append(held_id[j] if j >= 0 else None)
                waiting.append((a, k, i))
            yield pa.record_batch([*batch.columns, pa.array(out, batch.schema.field(place[-1]).type)], names=[*fields.names, "baseline"])

    schema = StructType([*fields.fields, StructField("baseline", fields[id_col].dataType)])
    return rows.repartition(*key).sortWithinPartitions(*key, at, known, id_col).mapInArrow(resolve, schema)
