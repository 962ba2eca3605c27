"""Connected components of an edge table, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.session import materialize

MAX_ROUNDS = 60


def components(edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(node, comp) for every node of ``edges``; comp is the smallest node of its component.

    Each round gives a node the smallest label among its own and its neighbours', then the label of that
    label. A round is two joins and an aggregation over edges, combined before the shuffle; rounds are written
    to the shared folder, so nothing is recomputed when executors are lost. Only a count comes to the driver.
    """
    both = edges.select(F.col(x).alias("a"), F.col(y).alias("b"))
    both = materialize(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("comp"))
                         .withColumnRenamed("a", "node"), "labels")
    for _ in range(MAX_ROUNDS):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        hooked = labels.join(seen, labels["node"] == seen["a"]) \
            .select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("new"))
        jump = labels.select(F.col("node").alias("j"), F.col("comp").alias("jumped"))
        after = hooked.join(jump, hooked["new"] == jump["j"], "left") \
            .select("node", "old", F.least("new", F.coalesce("jumped", "new")).alias("comp"))
        after = materialize(after, "labels")
        labels = after.select("node", "comp")
        if after.where("comp <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
