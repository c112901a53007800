"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import discard, stash


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, c): for every vertex of ``edges`` the smallest vertex that edges lead to, itself included.

    Each round takes the least label among the neighbours, then the label of that label, so chains shorten by
    half; only sums and minima by vertex are shuffled, and each round is written to the shared folder.
    """
    n = 2 * edges.count()
    both = edges.select(F.col(a).alias("v"), F.col(b).alias("w"))
    both = stash(both.unionByName(both.select(F.col("w").alias("v"), F.col("v").alias("w"))).where("v <> w").distinct(), "edges", n)
    labels = stash(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("c")), "labels", n)
    old = labels
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), "c"), "w").groupBy("v").agg(F.min("c").alias("near"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("jump"))
        step = labels.join(near, "v").join(jump, "c")
        new = stash(step.select("v", F.least("c", "near", "jump").alias("c"), (F.least("near", "jump") < F.col("c")).alias("moved")), "labels", n)
        discard(old)
        old, labels = new, new.select("v", "c")
        if not new.where("moved").limit(1).count():
            discard(both)
            return labels
