"""Connected components of a distributed edge list, by contraction.

Every round each node is renamed to its neighbour (or itself) that comes first
in a hash order of the node names, and the edges are renamed with it. Hash
order makes the number of nodes fall by a constant factor a round, chains
included, so the rounds grow with the logarithm of the nodes. Nothing is
collected: the driver only learns whether edges are left. A hub with many
edges is reduced by partial aggregation, and its renaming join can be split
(sort-merge join with skew handling), so no node needs one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: two long columns (a, b); self loops, repeats and either
    direction are fine. Returns (node, root), one row for each node that has an
    edge to another node; nodes of one component share the root, which is one
    of them."""
    cur = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    names = None
    while not cur.isEmpty():
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        first = (both.groupBy("a").agg(F.min(order("b")).alias("m"))
                 .select(F.col("a").alias("node"),
                         F.least(F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v")),
                                 F.col("m"))["v"].alias("parent")))
        first = written(first, "parents")
        if names is None:
            names = first.withColumnRenamed("parent", "root")
        else:
            names = (names.join(first, names.root == first.node, "left")
                     .select(names.node, F.coalesce("parent", "root").alias("root")))
        names = written(names, "roots")
        left = first.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = first.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        cur = written(cur.join(left, "a").join(right, "b")
                      .select(F.col("pa").alias("a"), F.col("pb").alias("b"))
                      .where("a <> b").distinct(), "edges")
    if names is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    return names
