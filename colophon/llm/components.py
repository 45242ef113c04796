"""Connected components over an edge table, without gathering edges, nodes or components anywhere.

Each round hooks every node to its smallest neighbour, shortens the resulting chains by pointer jumping until all end
at their roots, relabels the edges and drops those inside a component.  Rounds grow with the logarithm of the longest chain, and the edge table shrinks
from round to round.  A hub's neighbours meet only in an aggregation that combines before the shuffle and in joins
that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between labels instead of nodes, without loops or repeats."""
    for end in ("a", "b"):
        edges = (
            edges.join(labels.select(F.col("id").alias(end), F.col("label").alias("l_")), end, "left")
            .withColumn(end, F.coalesce("l_", end))
            .drop("l_")
        )
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(id, label) after adding ``edges`` (a, b) between nodes to the components in ``labels``.

    A label is the smallest id of its component.  Nodes in no edge have no row.  Repeated edges and loops are
    harmless; an empty edge table leaves ``labels`` as it is.
    """
    live = written(relabel(edges, labels) if labels is not None else edges.where("a <> b").distinct(), "edges")
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("up"))
        while True:  # until every chain ends at its root, so that a label is always its own label
            for _ in range(2):
                above = hook.select(F.col("id").alias("up"), F.col("up").alias("up2"))
                hook = hook.join(above, "up", "left").select("id", F.coalesce("up2", "up").alias("up"))
            hook = written(hook, "hooks")
            roots = hook.where("id = up").select(F.col("id").alias("up"))
            if hook.join(roots, "up", "left_anti").isEmpty():
                break
        fresh = hook.select("id", F.col("up").alias("label"))
        if labels is not None:
            moved = (
                labels.join(hook.select(F.col("id").alias("label"), "up"), "label", "left")
                .select("id", F.coalesce("up", "label").alias("label"))
            )
            fresh = moved.unionByName(fresh.join(labels.select("id"), "id", "left_anti"))
        fresh = written(fresh, "labels")
        nxt = written(relabel(live, fresh), "edges")
        drop(live)
        labels, live = fresh, nxt
    if labels is None:
        labels = written(live.select(F.col("a").alias("id"), F.col("b").alias("label")), "labels")
    return labels
