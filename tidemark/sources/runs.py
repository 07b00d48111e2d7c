"""The log of ingestion runs and their checkpoints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.facts import Refused


def latest_checkpoint(runs: DataFrame) -> DataFrame:
    """runs (source, started_at, run_id, checkpoint): by source the newest checkpoint there is."""
    return runs.where("checkpoint IS NOT NULL").groupBy("source").agg(F.max_by("checkpoint", F.struct("started_at", "run_id")).alias("checkpoint"))


def checkpoint_text(values: dict) -> str:
    """A flat map of scalars as canonical JSON; anything else is refused."""
    if bad := [k for k, v in values.items() if not isinstance(k, str) or not isinstance(v, str | int | float | bool | None)]:
        raise Refused(f"a checkpoint holds scalars only: {bad}")
    return json.dumps(values, sort_keys=True, separators=(",", ":"), allow_nan=False)
