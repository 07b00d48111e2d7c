"""Connected components of a link table, as joins and aggregates over links only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of links (a, b); nodes without links are left out.

    Every round hooks each node to its smallest neighbour, jumps once and contracts the
    links to the hooks. The smallest node of a component hooks to itself, so it stays; at
    least half of the other nodes go, so the rounds are logarithmic. Minima are pre-aggregated,
    and the joins are inner ones, which the engine splits where a node has very many links.
    """
    pairs = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = written(links.where("a != b").select(*pairs).distinct(), "links")
    labels = written(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not links.isEmpty():
        both = links.union(links.select(F.col("b"), F.col("a")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("u"), F.least("a", "b").alias("p"))
        jumped = written(hooks.join(hooks.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p")), "hooks")
        labels = written(labels.join(jumped, labels["component"] == jumped["u"], "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
        left, right = (jumped.select(F.col("u").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        links = written(links.join(left, "a").join(right, "b").where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    return labels
