"""Connected components of an edge table by label propagation with pointer jumping; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for edges (a, b) of bigints. Loops and repeated edges do no harm.
    Minima are combined on the map side and joins can be split, so a node with very many edges is no bottleneck."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        step = labels.join(near, "node").select("node", F.least("label", "seen").alias("new"), "label")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("further"))
        new = written(step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("further", "new")).alias("label"), F.col("label").alias("old")), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
