"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.storage import discard, stored


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())


def connected_components(spark: SparkSession, edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Node ids are long (or any ordered type). Self loops, repeated and null-ended edges are allowed:
    null ends are dropped, a self loop gives a component of one. No edge list ever reaches the driver;
    each round is two aggregations and two joins, written to the shared folder.
    """
    clean = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).dropna()
    current = stored(spark, clean.distinct(), "edges")
    nodes = stored(spark, current.select(F.col("src").alias("node")).union(current.select("dst")).distinct(), "nodes")
    state = None
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("low"))
        small = down.join(low, "src")
        step = small.where("dst != low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        step = step.union(low.select("src", F.col("low").alias("dst"))).where("src != dst").distinct()
        following = stored(spark, step, "edges")
        discard(spark, current)
        current, before, state = following, state, _checksum(following)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = current.groupBy("src").agg(F.min("dst").alias("component"))
    return nodes.join(roots, nodes.node == roots.src, "left").select("node", F.coalesce("component", "node").alias("component"))
