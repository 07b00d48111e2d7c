"""Joins of instants with the intervals that hold them, as equality joins.

The range of all instants is cut into bins; an instant lies in one, an interval is repeated for the bins that
it reaches, and both meet by key and bin, where the true bounds are checked. There are so many bins that
one of a key holds some PER_BIN instants, so an interval's copies pay for themselves with the rows they join. A
bin of more than its share of instants is split: its instants are dealt out, and its intervals go to every part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.facts import FactSpec
from tidemark.operators.guard import Refused

#: Instants of one key that share a bin, on average, and bins at most.
PER_BIN, BINS = 256, 1 << 16
#: A bin of a key with more instants than this is split, or with more than this share of all: so split bins are at most that many, which is what is broadcast.
HOT, HOT_BINS = 100_000, 10_000
KINDS = ("timestamp", "timestamp_ntz", "date", "bigint", "int")


def number(df: DataFrame, name: str) -> Column:
    """An instant as a long: microseconds, days or itself."""
    kind = dict(df.dtypes)[name]
    if kind not in KINDS:
        raise Refused(f"{name} is no instant but {kind}")
    if kind == "date":
        return F.unix_date(name).cast("long")
    return F.unix_micros(F.col(name).cast("timestamp")) if kind.startswith("timestamp") else F.col(name).cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, key: Sequence[str], at: str = "at", start: str = "valid_from", end: str = "valid_to", how: str = "inner", where: Column | None = None) -> DataFrame:
    """points with the columns of every interval of the same key that holds their instant: start <= at < end, and `where` of both sides' columns.

    how: inner, or left, which keeps an instant that no interval holds. Instants, bounds and keys that are null meet nothing, nor
    does an empty interval. Apart from the key, columns of one name on both sides are refused. Repeated rows join as often as they stand.
    """
    if how not in ("inner", "left"):
        raise Refused(f"inner or left, not {how}")
    if clash := set(points.columns) & set(intervals.columns) - set(key):
        raise Refused(f"columns of both sides: {sorted(clash)}")
    if len({dict(points.dtypes)[at].removesuffix("_ntz"), *(dict(intervals.dtypes)[c].removesuffix("_ntz") for c in (start, end))}) > 1:
        raise Refused("instants and bounds of different types")
    t, a, b = number(points, at), number(intervals, start), number(intervals, end)
    told = points.where(t.isNotNull()).agg(F.min(t), F.max(t), F.count("*"), F.approx_count_distinct(F.struct(*key)) if key else F.lit(1)).first()
    lo, hi, n = told[0] or 0, told[1] or 0, told[2]
    bins = max(1, min(BINS, n // (PER_BIN * max(1, told[3]))))
    width = (hi - lo) // bins + 1
    dealt = points.withColumns({"_x": t - F.lit(lo), "_w": F.lit(width).cast("long")}).withColumn("_bin", F.expr("_x div _w")).drop("_x", "_w")
    reach = intervals.where((a < b) & (a <= F.lit(hi)) & (b > F.lit(lo)))
    first, last = F.greatest(a, F.lit(lo)) - F.lit(lo), F.least(b - 1, F.lit(hi)) - F.lit(lo)
    spread = reach.withColumns({"_f": first, "_l": last, "_w": F.lit(width).cast("long")}).withColumn("_bin", F.explode(F.expr("sequence(_f div _w, _l div _w)"))).drop("_f", "_l", "_w")

    most = max(HOT, -(-n // HOT_BINS))
    hot = dealt.where("_bin IS NOT NULL").groupBy(*key, "_bin").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    hot = F.broadcast(hot.select(*key, "_bin", F.ceil(F.col("_n") / most).cast("int").alias("_parts")))  # each holds more than n / HOT_BINS instants, so there are fewer than HOT_BINS
    by = [*key, "_bin"]
    dealt = dealt.withColumn("_i", F.monotonically_increasing_id()).join(hot, by, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_i"), F.col("_parts")).cast("int"), F.lit(0))).drop("_i", "_parts")
    spread = spread.join(hot, by, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")

    names = {c: f"_of_{c}" for c in (*key, "_bin", "_part")}
    spread = spread.withColumnsRenamed(names)
    met = (F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))
    for mine, theirs in names.items():
        met = met & (F.col(mine) == F.col(theirs))
    return dealt.join(spread, met if where is None else met & where, how).drop("_bin", "_part", *names.values())


def versions_at(points: DataFrame, facts: DataFrame, spec: FactSpec, at: str = "at", known: str = "known", columns: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """points (key, at, known, ...) with what was known at `known` of each fact in force at `at`: of each key and valid_from the version learned last by then, unless that is a retraction.

    A version is current from when it is learned until the next one is. So a point in valid time and an instant of knowledge
    that both come from columns need no read for each instant. Facts' columns but the key, valid_from and `columns` are left out.
    """
    kind = dict(facts.dtypes)["knowledge_time"]
    later = F.lead("knowledge_time").over(Window.partitionBy(*spec.key, "valid_from").orderBy("knowledge_time", *spec.tie))
    told = facts.where("knowledge_time IS NOT NULL").withColumn("_until", later).where("NOT is_retraction AND (_until IS NULL OR knowledge_time < _until)")
    kept = list(dict.fromkeys([*spec.key, "valid_from", *columns]))
    told = told.select(*kept, F.col("valid_to").alias("_valid_to"), F.col("knowledge_time").alias("_known_from"), "_until")
    seen = (F.col("_known_from") <= F.col(known).cast(kind)) & (F.col("_until").isNull() | (F.col(known).cast(kind) < F.col("_until")))
    return interval_join(points, told, spec.key, at, "valid_from", "_valid_to", how, seen).drop("_valid_to", "_known_from", "_until")
