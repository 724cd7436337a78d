"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import materialise


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Smallest labels travel along edges and labels are replaced by their own labels (pointer jumping), so the number of
    rounds grows with the logarithm of a component's diameter. Minima combine before the shuffle, no group is gathered,
    and every round is checkpointed. Loops and repeated edges are allowed; an edge with a null end is dropped.
    """
    pairs = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).dropna()
    both = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        top = labels.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new = materialise(step.join(top, "component").select("node", F.least("component", "top").alias("component"), (F.least("component", "top") < F.col("old")).alias("moved")))
        labels = new.select("node", "component")
        if new.filter("moved").isEmpty():
            return labels
