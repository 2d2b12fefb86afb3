"""Connected components by alternating star contraction, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Roots of the nodes of an edge table.

    ``edges`` has columns ``u`` and ``v`` of one orderable type; rows with a null or with
    ``u = v`` say nothing and are passed over, repeated rows and both directions are one
    edge. Returns ``node, root``: each node that has an edge, once, and the smallest node
    that it reaches. An empty edge table gives an empty result.

    Each round connects a node's larger neighbours, then its smaller ones, to the smallest
    of them, so a chain halves per round and a hub is met by a combinable ``min`` and one
    join with a unique side (which adaptive execution can split). Rounds end when all edges
    lead straight to a root.
    """
    e = cut(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        label,
    )
    while not _straight(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _straight(e: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or edges from larger ones only."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()
