"""Versioned facts laid out by the month of valid_from, and a compacted table of their latest versions.

    versions/vf_month=2024-01/...   every version, appended once and never changed
    latest/vf_month=2024-01/...     of each key and valid_from the version learned last by a cutoff, retractions included
    cutoffs/...                     when which months were compacted

An append reads the target's partitions of the batch's own months and no others; a read between two instants prunes to their
months. `compact` makes the latest versions of the months that have new ones; a read as of a later instant
starts from them and adds only what was learned since.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.scratch import exists
from tidemark.operators.facts import FactSpec, instant, literal, refuse, visible
from tidemark.operators.guard import Refused

MONTH = "vf_month"
#: Months of one batch at most: its distinct months are told to the driver, and a batch with more spans centuries.
MOST_MONTHS = 10_000


def month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


@dataclass(frozen=True)
class MonthStore:
    """A store at a path. schema: that of the versions, without the month."""

    spark: SparkSession
    path: str
    spec: FactSpec
    schema: StructType

    def _table(self, part: str) -> DataFrame:
        """A part of the store, empty if nothing was written to it yet."""
        schema = StructType([*self.schema.fields, StructField(MONTH, StringType())])
        if not exists(self.spark, f"{self.path}/{part}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    @property
    def identity(self) -> tuple[str, ...]:
        """What makes a version the same version."""
        return (*self.spec.key, "valid_from", "knowledge_time", *self.spec.tie)

    def append(self, batch: DataFrame, now: dt.datetime | None = None) -> list[str]:
        """Appends the versions that the store lacks, each once, and tells the batch's months. Knowledge from the future, and rows without a key or a start, are refused before anything is written."""
        kind = batch.schema["knowledge_time"].dataType
        future = F.col("knowledge_time") > literal(now or dt.datetime.now(dt.UTC), kind.simpleString())
        bare = F.lit(False)
        for c in (*self.spec.key, "valid_from", "knowledge_time"):
            bare = bare | F.col(c).isNull()
        told = batch.select(*self.schema.names).withColumn(MONTH, month(F.col("valid_from")))
        told = refuse(refuse(told, bare, "a version without a key, a start or a time of knowledge"), future, "knowledge from the future")
        months = sorted(r[0] for r in told.select(MONTH).distinct().limit(MOST_MONTHS + 1).collect())
        if len(months) > MOST_MONTHS:
            raise Refused(f"a batch of more than {MOST_MONTHS} months")
        self.missing(told, months).write.mode("append").partitionBy(MONTH).parquet(f"{self.path}/versions")
        return months

    def missing(self, told: DataFrame, months: list[str]) -> DataFrame:
        """The rows of a batch with these months that the store lacks; what it reads of the store is those partitions, and of them what makes versions the same."""
        there = self._table("versions").where(F.col(MONTH).isin(months)).select(MONTH, *self.identity)
        same = [told[MONTH] == there[MONTH]]
        same += [told[c].eqNullSafe(there[c]) if c in self.spec.tie else told[c] == there[c] for c in self.identity]
        return told.dropDuplicates([*self.identity]).join(there, same, "left_anti")

    def versions(self, after: dt.datetime | None = None, before: dt.datetime | None = None) -> DataFrame:
        """All versions whose valid_from is from `after` on and before `before`; their months are derived, so only those partitions are read."""
        return self._between(self._table("versions"), after, before)

    def _between(self, rows: DataFrame, after: dt.datetime | None, before: dt.datetime | None) -> DataFrame:
        kind = self.schema["valid_from"].dataType.simpleString()
        if after is not None:
            rows = rows.where((F.col("valid_from") >= literal(after, kind)) & (F.col(MONTH) >= after.strftime("%Y-%m")))
        if before is not None:
            rows = rows.where((F.col("valid_from") < literal(before, kind)) & (F.col(MONTH) <= before.strftime("%Y-%m")))
        return rows.drop(MONTH)

    def compact(self, cutoff: dt.datetime) -> list[str]:
        """Makes the latest versions by `cutoff` of the months in which something was learned since they were last compacted, and tells those months. The versions themselves stay as they are."""
        kind, last = self.schema["knowledge_time"].dataType.simpleString(), self.cutoff()
        if last is not None and cutoff < last:
            raise Refused(f"compacted by {last} already")
        rows = self._table("versions")
        known = rows.where(F.col("knowledge_time") <= literal(cutoff, kind))
        news = known if last is None else known.where(F.col("knowledge_time") > literal(last, kind))
        # A version that was learned earlier may have been appended late, so months are also compared by their number of versions.
        counts = known.groupBy(MONTH).agg(F.count("*").alias("n"))
        before = self._counts()
        changed = {r[0] for r in news.select(MONTH).distinct().collect()} | {r[0] for r in counts.collect() if before.get(r[0]) != r["n"]}
        if changed:
            best = F.max_by(F.struct(*[c for c in self.schema.names if c not in (*self.spec.key, "valid_from")]), F.struct("knowledge_time", *self.spec.tie)).alias("_won")
            won = known.where(F.col(MONTH).isin(sorted(changed))).groupBy(MONTH, *self.spec.key, "valid_from").agg(best)
            latest = won.select(*[F.col(c) if c in (*self.spec.key, "valid_from") else F.col(f"_won.{c}") for c in self.schema.names], MONTH)
            latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(f"{self.path}/latest")
        done = counts.where(F.col(MONTH).isin(sorted(changed))) if changed else counts.where("false")
        done.select(F.lit(cutoff.isoformat()).alias("cutoff"), F.col(MONTH).alias("month"), "n").unionByName(self.spark.createDataFrame([(cutoff.isoformat(), None, None)], "cutoff string, month string, n long")).coalesce(1).write.mode("append").parquet(f"{self.path}/cutoffs")
        return sorted(changed)

    def _log(self) -> DataFrame:
        schema = "cutoff string, month string, n long"
        if not exists(self.spark, f"{self.path}/cutoffs"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/cutoffs")

    def cutoff(self) -> dt.datetime | None:
        """The instant by which the latest versions were last made."""
        told = self._log().agg(F.max("cutoff")).first()[0]
        return None if told is None else dt.datetime.fromisoformat(told)

    def _counts(self) -> dict[str, int]:
        """By month the number of versions when it was last compacted; a month is a row."""
        return {r["month"]: r["n"] for r in self._log().where("month IS NOT NULL").groupBy("month").agg(F.max_by("n", "cutoff").alias("n")).collect()}

    def read(self, as_of: dt.datetime, after: dt.datetime | None = None, before: dt.datetime | None = None, columns: tuple[str, ...] | None = None, now: dt.datetime | None = None) -> DataFrame:
        """What was known at `as_of` of facts whose valid_from lies between. From the last cutoff on it is the latest versions and what was learned since; earlier, all versions.

        Versions that were learned before the cutoff and appended after it are seen once their month is compacted again.
        """
        as_of, last = instant(as_of, now), self.cutoff()
        rows = self.versions(after, before)
        if last is not None and as_of >= last:
            kind = self.schema["knowledge_time"].dataType.simpleString()
            rows = self._between(self._table("latest"), after, before).unionByName(rows.where(F.col("knowledge_time") > literal(last, kind)))
        return visible(rows, self.spec, as_of, columns)

