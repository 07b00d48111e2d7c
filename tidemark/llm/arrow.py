"""How the operators that work inside Python tasks exchange rows with Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of one Arrow batch. Texts may be very long, and a batch is held whole by the JVM and by Python.
BATCH_ROWS = 256


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """df with `rows` applied to batches of at most BATCH_ROWS rows, each by itself; nothing is kept between batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield rows(batch)

    return df.mapInArrow(run, schema)
