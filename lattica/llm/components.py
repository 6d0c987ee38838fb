"""Connected components of a distributed edge list, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Table


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node, root: the least node that its edges reach. Nodes are those of the edges.

    Each round every node takes the least root among its neighbours (a sum by key with a map-side part, so a node with
    very many neighbours is no burden), edges are drawn anew between roots, and those within one root go. Stars, and so
    all groups joined through one member, are done in one round; a path of n nodes takes about log n rounds.
    """
    left = Table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots: DataFrame | None = None
    while not left.read().isEmpty():
        e = left.read()
        both = e.union(e.select("b", "a"))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        step = Table(step, "step")
        # A node's pick may itself have picked another: follow once more, so that chains halve.
        s = step.read()
        up = s.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = Table(s.join(up, "up", "left").select("node", F.coalesce("top", "up").alias("root")), "jumped")
        j = jumped.read()
        if roots is None:
            roots = j
        else:
            moved = j.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = Table(roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots").read()
        ja, jb = j.select(F.col("node").alias("a"), F.col("root").alias("ra")), j.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        drawn = e.join(ja, "a").join(jb, "b").where("ra <> rb")
        left = Table(drawn.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if roots is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    return roots
