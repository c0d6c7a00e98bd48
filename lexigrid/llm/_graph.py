"""Connected components by repeated contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is one node of its component.

    Each round every node takes the smallest of itself and its neighbours, and the graph is
    contracted to those. The edge from a node to what it took becomes an edge between the two
    representatives, so no link is lost. Rounds grow with the logarithm of the longest path.
    Groups are only aggregated by ``min``, which combines before the shuffle; joins may be split.
    """
    found = None
    edges = stored(edges.where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        took = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "took")
        left = took.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = took.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = stored(
            edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
        if found is None:
            found = took
        else:
            up = took.select(F.col("node").alias("root"), F.col("root").alias("above"))
            found = stored(found.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "found")
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
