"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.runtime import checkpoint


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``edges`` with the smallest node of its component.

    Alternates large-star and small-star steps, which need O(log n) rounds whatever the shape of the graph;
    each round is two aggregations over the edges, partial before the shuffle, so a node with very many
    neighbours costs one reduced row per task. Rounds are cut with a reliable checkpoint. Self loops and
    repeated edges are allowed, null ends are dropped; nodes without edges don't appear.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = checkpoint(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour is linked to the smallest one of the neighbourhood
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour, and the node, are linked to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("the components did not settle")
    label = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(label, nodes.node == label.u, "left").select("node", F.coalesce("component", "node").alias("component"))
