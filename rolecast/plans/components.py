"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.plans.skew import salted_join
from rolecast.session import cut_lineage


def _ordered(edges: DataFrame) -> DataFrame:
    """Each pair of different nodes once, the smaller one first."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)`` that has another; the label is the smallest node reached.

    Each round every node follows its smallest neighbour two steps. Edges are then drawn between the
    labels, and those within one label go, so each round works on a far smaller graph than the one
    before. At the end the rounds' labels are read one through the other. Hub nodes are salted. The
    only driver-side value is whether an edge is left.
    """
    current = cut_lineage(_ordered(edges))
    rounds = []
    while True:
        ends = current.select(F.col("a").alias("node"), F.col("b").alias("peer")).unionByName(
            current.select(F.col("b").alias("node"), F.col("a").alias("peer"))
        )
        # An edge's larger end always has a smaller neighbour; a smallest node keeps itself.
        parent = cut_lineage(ends.groupBy("node").agg(F.min("peer").alias("peer")).select("node", F.least("node", "peer").alias("label")))
        step = parent.select(F.col("node").alias("label"), F.col("label").alias("further"))
        label = cut_lineage(salted_join(parent, step, ["label"], "node").select("node", F.col("further").alias("label")), replaces=parent)
        rounds.append(label)
        left = salted_join(current, label.select(F.col("node").alias("a"), F.col("label").alias("la")), ["a"], "b")
        both = salted_join(left, label.select(F.col("node").alias("b"), F.col("label").alias("lb")), ["b"], "a")
        current = cut_lineage(_ordered(both.select(F.col("la").alias("a"), F.col("lb").alias("b"))), replaces=current)
        if current.isEmpty():
            break
    # From the smallest graph back to the first one.
    found = rounds.pop()
    while rounds:
        further = found.select(F.col("node").alias("label"), F.col("label").alias("last"))
        found = salted_join(rounds.pop(), further, ["label"], "node", "left").select("node", F.coalesce("last", "label").alias("label"))
    return cut_lineage(found)
