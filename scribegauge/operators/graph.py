"""Connected components for clusters that share a member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpointed


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, label``: the smallest node of the component of every node that has an edge.

    Minimum-label hooking with pointer jumping.  State is one row per node,
    written to the checkpoint folder after every round, so a lost executor
    costs at most one round.  Nothing is gathered by key: a round is an
    aggregated join over the edges and a self-join of the labels, and adaptive
    execution can split a hub's rows in both.

    Edges are undirected; repeated edges, self-loops and either direction are
    fine; edges with a null end are ignored; no edges give no rows.  Node
    values may have any orderable type.
    """
    clean = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    both = clean.union(clean.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = checkpointed(both.distinct())
    lowest = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low"))
    labels = checkpointed(lowest.select("node", F.least("low", "node").alias("label")))
    while True:
        far = labels.select(F.col("node").alias("dst"), F.col("label").alias("far"))
        hooked = both.join(far, "dst").groupBy(F.col("src").alias("node")).agg(F.min("far").alias("far"))
        # Written before it is joined with itself, so that it is made once and a hub's rows can be split.
        stepped = checkpointed(
            labels.join(hooked, "node").select("node", F.col("label").alias("old"), F.least("label", "far").alias("step"))
        )
        # A label is itself a node, so take that node's new label.
        jump = stepped.select(F.col("node").alias("step"), F.col("step").alias("jumped"))
        label = F.coalesce(F.least("jumped", "step"), F.col("step"))
        moved = stepped.join(jump, "step", "left").select("node", label.alias("label"), (label != F.col("old")).alias("changed"))
        moved = checkpointed(moved)
        labels = moved.select("node", "label")
        if moved.where("changed").isEmpty():
            return labels
