"""The ledger of trials, a table in a text file with a row a trial: what was tried counts, so rows are only added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.facts import Refused, refuse

COLUMNS = ("run_id", "strategy", "started", "sharpe", "note")


def row(**values: object) -> str:
    """One line of the ledger; a pipe, a line break and an unknown column are refused."""
    if set(values) - set(COLUMNS) or not values.get("run_id"):
        raise Refused(f"columns are {COLUMNS}, and run_id is needed")
    cells = ["" if values.get(c) is None else str(values[c]).strip() for c in COLUMNS]
    if any("|" in x or "\n" in x or "\r" in x for x in cells):
        raise Refused("a cell may hold no pipe and no line break")
    return "| " + " | ".join(cells) + " |"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The trials of a text file or folder: lines between pipes but for the heading and its rule. A line of another width, a missing run_id and one that stands twice are refused."""
    return parse(spark.read.text(path).select(F.col("value").alias("line")))


def parse(lines: DataFrame) -> DataFrame:
    cells = F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|")
    told = lines.where(F.trim("line").startswith("|")).select(F.transform(cells, lambda x: F.trim(x)).alias("c"))
    heading = (F.lower(F.col("c")[0]) == COLUMNS[0]) | F.forall("c", lambda x: x.rlike("^:?-+:?$"))
    told = told.where(~heading)
    told = refuse(told, F.size("c") != len(COLUMNS), f"a trial has {len(COLUMNS)} cells")
    told = refuse(told, F.col("c")[0] == "", "a trial without a run")
    out = told.select(*[F.nullif(F.col("c")[k], F.lit("")).alias(c) for k, c in enumerate(COLUMNS)]).withColumn("sharpe", F.col("sharpe").try_cast("double"))
    # The number of rows of a run, by a partial count.
    n = out.groupBy("run_id").agg(F.count("*").alias("_n"))
    return refuse(out.join(n, "run_id"), F.col("_n") > 1, "a run that stands twice").select(*COLUMNS)


def append(trials: DataFrame, path: str) -> int:
    """Adds the trials (COLUMNS) to the ledger in a folder, and returns how many trials it holds then.

    What is there is neither rewritten nor moved: the new lines are files of their own, which Spark commits together. The ledger must exist,
    since a fresh one would start the count at zero. A run that it holds, or that stands twice in the batch, one without an id, and a cell with
    a pipe or a line break are refused, and then nothing is added.
    """
    if set(trials.columns) != set(COLUMNS):
        raise Refused(f"columns are {COLUMNS}")
    there = read(trials.sparkSession, path)
    cells = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in COLUMNS]
    told = trials.select(*cells)
    bad = F.lit(False)
    for c in COLUMNS:
        bad = bad | F.col(c).rlike(r"[|\r\n]")
    told = refuse(told, bad, "a cell may hold no pipe and no line break")
    told = refuse(told, F.col("run_id") == "", "a trial without a run")
    seen = told.groupBy("run_id").agg(F.count("*").alias("_n")).join(there.select("run_id", F.lit(1).alias("_there")), "run_id", "left")
    seen = refuse(seen, (F.col("_n") > 1) | F.col("_there").isNotNull(), "a run that stands twice").select("run_id")
    lines = told.join(seen, "run_id").select(F.concat(F.lit("| "), F.concat_ws(" | ", *COLUMNS), F.lit(" |")).alias("value"))
    lines.write.mode("append").text(path)
    return count(read(trials.sparkSession, path))


def count(trials: DataFrame) -> int:
    """How many trials there were, for the deflation of the best."""
    return trials.count()
