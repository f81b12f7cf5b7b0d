"""Connected components of a table of links, by rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, class_id) for every node of ``links`` (a long, b long); class_id is the component's least node.

    Every round points each node at its least neighbour (or itself), follows pointers
    once more and replaces nodes by what they point at, which at least halves every
    component that is left; links within one node go. A component's least node never moves, so
    it is what remains. A hub's neighbours are aggregated, never gathered; each round's
    tables are written to the shared folder. No links give no rows; rows with a null are ignored.
    """
    links = links.filter("a is not null and b is not null and a <> b").select("a", "b")
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    both = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node")))
    total = materialize(both.groupBy("node").agg(F.min("node").alias("class_id")), "classes")
    while not edges.isEmpty():
        directed = edges.union(edges.select("b", "a"))
        least = directed.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        least = materialize(least.select("node", F.least("node", "to").alias("to")), "pointers")
        further = least.select(F.col("node").alias("to"), F.col("to").alias("further"))
        moves = materialize(least.join(further, "to").select("node", F.col("further").alias("to")), "pointers")
        of = lambda name: moves.select(F.col("node").alias(name), F.col("to").alias(f"{name}_to"))
        moved = edges.join(of("a"), "a").join(of("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = materialize(moved.filter("a <> b").distinct(), "links")
        total = materialize(
            total.join(of("class_id"), "class_id", "left").select("node", F.coalesce("class_id_to", "class_id").alias("class_id")), "classes"
        )
    return total
