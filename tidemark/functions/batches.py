"""Rows that go to Python tasks in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of one batch where a row holds a whole text.
TEXT_ROWS = 256


def of_texts(df: DataFrame) -> DataFrame:
    """df, whose session from now on hands Python at most TEXT_ROWS rows at once, since a batch is held whole on both sides and texts may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if not 0 < now <= TEXT_ROWS:
        df.sparkSession.conf.set(key, str(TEXT_ROWS))
    return df
