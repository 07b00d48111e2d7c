"""The driver's tables in the shapes that the operators take, and the same shapes as SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.facts import FactSpec

AS_OF = dt.datetime(2024, 1, 15, tzinfo=dt.UTC)
EVENTS = FactSpec("event_facts", ("entity",), ("value",), ("value",), ("seq",))
ORDERS = FactSpec("order_facts", ("customer",), ("total", "status"), ("total",), ("seq",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact a user and day, a version an event; an error withdraws it."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), day.alias("valid_from"), (day + F.expr("INTERVAL 1 DAY")).alias("valid_to"), F.col("ts").cast("timestamp_ntz").alias("knowledge_time"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"), (F.col("event_type") == "error").alias("is_retraction")
    )


EVENT_FACTS = """event_facts AS (SELECT user_id AS entity, date_trunc('day', ts) AS valid_from, date_trunc('day', ts) + INTERVAL 1 DAY AS valid_to, ts AS knowledge_time, event_id AS seq,
  CASE WHEN event_type <> 'error' THEN value END AS value, event_type = 'error' AS is_retraction FROM events)"""


def visible_sql(name: str = "vis", at: str = "2024-01-15", facts: str = "event_facts", key: str = "entity") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}, valid_from ORDER BY knowledge_time DESC, seq DESC) AS rn FROM {facts} WHERE knowledge_time <= TIMESTAMP '{at}') WHERE rn = 1 AND NOT is_retraction)"""


#: Rows of a task at most, unless one key has more, and rows that are worth a task.
TASK_ROWS, WORTH = 100_000, 20_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """df partitioned by a key, in parts of some TASK_ROWS rows however many there are. Groupings and windows by the key and others need no other shuffle, and a task's share does not grow with the table."""
    n, usual = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(usual, -(-n // WORTH)), -(-n // TASK_ROWS)), key)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price bar a supplier and day: the mean price of a piece, and the pieces."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("date"), cents("l_extendedprice").alias("paid"), cents("l_quantity").alias("pieces"), F.round("l_quantity").cast("long").alias("volume"))
    sums = spread(line, "id").groupBy("id", "date").agg(*[F.sum(c).alias(c) for c in ("paid", "pieces", "volume")])
    return sums.select("id", "date", (F.expr("paid * 10000 div pieces") / 10000.0).alias("close"), "volume")


BARS = """bars AS (SELECT id, date, (paid * 10000 // pieces) / 10000.0::DOUBLE AS close, volume FROM (SELECT l_suppkey AS id, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS paid, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS pieces, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS volume FROM lineitem GROUP BY 1, 2))"""


def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances by market segment, which stands for the date, and nation, which stands for the group."""
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("date"), F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.pmod(F.col("c_custkey"), F.lit(17)) / 10.0).alias("beta"))


CROSS_SECTION = "cs AS (SELECT c_mktsegment AS date, c_nationkey AS grp, c_custkey AS id, c_acctbal AS x, (c_custkey % 17) / 10.0 AS beta FROM customer)"
