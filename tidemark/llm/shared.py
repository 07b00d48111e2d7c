"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has made, by application, for `discard`.
MADE: dict[str, list[str]] = {}
#: Names of bucketed tables among them.
TABLES: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one if driver and tasks are one process, as in tests; on a cluster it is refused."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        told = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that was written once: its lineage ends there, and a lost executor costs a read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_table(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a table that is bucketed by `key`: it moves once, and groups and joins by the key read it in place. There are as many buckets as shuffle partitions."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(table)
    TABLES.setdefault(spark.sparkContext.applicationId, []).append(table)
    return spark.table(table)


def discard(spark: SparkSession) -> int:
    """Removes the tables and archives that this application has made here, and tells how many there were. Results read them, so store those first."""
    for table in TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    paths = MADE.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
