"""Connected components by the least label, with pointer jumping.

This is for graphs of variants whose components are small; long chains are
halved in each round by the jump.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.durable import Scratch


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node of each component in byte order, for every node of an edge with both ends.

    A round takes the least label among a node's neighbours and then that
    label's own label. Rounds are written down, so none repeats an earlier
    one; the loop ends with the first that changes nothing.
    """
    scratch = Scratch(edges.sparkSession, "propagation")
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    e = scratch.write(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = scratch.write(e.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("component")), "labels0")
    for n in range(1, max_rounds + 1):
        near = e.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        met = labels.join(near, "node").withColumn("via", F.least("component", "near"))
        jumped = met.join(labels.select(F.col("node").alias("via"), F.col("component").alias("further")), "via", "left")
        new = scratch.write(jumped.select("node", F.coalesce(F.least("via", "further"), "via").alias("component"), (F.coalesce(F.least("via", "further"), "via") != F.col("component")).alias("changed")), f"labels{n}")
        labels = new.drop("changed")
        scratch.drop(f"labels{n - 1}")
        if new.filter("changed").isEmpty():
            return labels
    raise RuntimeError(f"components still change after {max_rounds} rounds")
