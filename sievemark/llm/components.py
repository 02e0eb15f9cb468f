"""Connected components by repeated smallest-neighbour hooking; labels and edges stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges (a, b)``; ``label`` is the smallest node of its component.

    Alternates two steps until nothing changes: every node's larger neighbours are linked to its smallest neighbour, then
    every node's neighbours that are not larger. Both keep the components and need one shuffle each; the number of rounds
    grows with the logarithm of the longest path. A node with many edges only sends them to its smallest neighbour, and
    the smallest is taken on the map side first. The result is a table of ``materialise``. Null nodes and edges from a node to itself are left out.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    edges = materialise(edges, "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        down = large.distinct()  # every edge now goes from the larger node down
        smallest = down.groupBy("a").agg(F.min("b").alias("least"))
        small = down.join(smallest, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        new = materialise(small.union(smallest.select("a", F.col("least").alias("b"))).distinct(), "edges")
        same = new.exceptAll(edges).isEmpty() and new.count() == edges.count()
        discard(edges)
        edges = new
        if same:
            break
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    labels = materialise(labels.union(roots), "labels")
    discard(edges)
    return labels
