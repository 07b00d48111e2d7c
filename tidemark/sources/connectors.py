"""Connectors: fetch batches from a checkpoint, append them once, move the checkpoint, and keep one record a run."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.facts import Refused, new_rows, refuse
from tidemark.sources.runs import checkpoint_text, latest_checkpoint

RUNS = "source string, run_id string, started_at timestamp, finished_at timestamp, status string, rows long, checkpoint string, error string"
#: From a checkpoint (None at first), batches with the checkpoint that holds once each is stored.
Fetch = Callable[[SparkSession, str | None], Iterator[tuple[DataFrame, dict]]]


@dataclass(frozen=True)
class Connector:
    """source: its name; fetch: its batches; key: what makes a row the same row."""

    source: str
    fetch: Fetch
    key: tuple[str, ...]


@dataclass
class Registry:
    """Connectors by name."""

    connectors: dict[str, Connector] = field(default_factory=dict)

    def register(self, connector: Connector) -> Connector:
        if not connector.source.isidentifier() or not connector.key:
            raise Refused(f"a source has a name of letters and digits, and a key: {connector.source!r}")
        if connector.source in self.connectors:
            raise Refused(f"{connector.source} is registered already")
        self.connectors[connector.source] = connector
        return connector

    def get(self, source: str) -> Connector:
        if source not in self.connectors:
            raise Refused(f"no connector {source!r}; there are {sorted(self.connectors)}")
        return self.connectors[source]


def table_at(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at a path, empty if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def run(spark: SparkSession, connector: Connector, target: str, runs: str, now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)) -> dict:
    """Runs a connector from its last checkpoint and returns its record, which is also appended to the runs at that path.

    A batch is appended before its checkpoint counts, and a row whose key the target holds is not appended again, so a run
    that fails anywhere is run again from where it got to. The record of a failed run has the last checkpoint that it stored.
    """
    log = table_at(spark, runs, RUNS).where(F.col("source") == connector.source)
    last = latest_checkpoint(log).first()
    at = last["checkpoint"] if last else None
    record = {"source": connector.source, "run_id": uuid.uuid4().hex, "started_at": now(), "status": "succeeded", "rows": 0, "checkpoint": at, "error": None}
    try:
        for batch, after in connector.fetch(spark, at):
            text = checkpoint_text(after)
            if "knowledge_time" in batch.columns:
                batch = refuse(batch, F.col("knowledge_time") > F.lit(now()).cast(batch.schema["knowledge_time"].dataType), "knowledge from the future")
            fresh = new_rows(batch, table_at(spark, target, batch.schema), connector.key).persist()
            try:
                n = fresh.count()
                if n:
                    fresh.write.mode("append").parquet(target)
            finally:
                fresh.unpersist()
            record |= {"checkpoint": text, "rows": record["rows"] + n}
    except (TypeError, AttributeError, NameError):
        raise  # an error of the program, not of the source
    except Exception as e:
        record |= {"status": "failed", "error": f"{type(e).__name__}: {str(e)[:500]}"}
    record["finished_at"] = now()
    names = [x.split()[0] for x in RUNS.split(", ")]
    spark.createDataFrame([tuple(record[c] for c in names)], RUNS).coalesce(1).write.mode("append").parquet(runs)
    return record
