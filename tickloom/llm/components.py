"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every larger (or every smaller) neighbour of a node to its smallest neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    joined = both.join(least, "src")
    if large:
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        out = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(
            least.select("src", F.col("m").alias("dst"))
        )
    return out.where("src <> dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge; component is its smallest node.

    edges: columns src, dst (long). Null ends and loops are left out, repeated
    edges count once, no edge gives no row. Every round is stored, so that a
    lost executor costs one round.
    """
    edges = stored(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(),
        "edges",
    )
    before = None
    for _ in range(ROUNDS):
        edges = stored(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {ROUNDS} rounds")
    nodes = edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return nodes.unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
