"""Traversals: level-wise joins against the edge table; each level is written before the next reads it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.model import IMPACT_RELATIONS, PropertyGraph
from lattice.operators import stats
from lattice.storage import discard, stored


def hub_threshold(g: PropertyGraph) -> int:
    """max(50, the degree at place int(n * 0.99) of all nodes): one row to the driver."""
    degrees = g.nodes.select("id").join(g.degrees(), "id", "left").fillna(0, ["degree"])
    counts = degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    total = degrees.count()
    rows = sorted(counts.collect())  # distinct degrees only
    seen, place = 0, int(total * 0.99)
    for degree, n in rows:
        seen += n
        if seen > place:
            return max(50, degree)
    return 50


def bfs(spark: SparkSession, g: PropertyGraph, seeds: DataFrame, depth: int = 3, guard: bool = True) -> DataFrame:
    """(id, depth) within ``depth`` hops; hubs that are no seeds are reached but not crossed."""
    edges = g.edges.select("source", "target")
    if not g.directed:
        edges = edges.unionAll(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    seen = stored(spark, seeds.select("id").distinct().withColumn("depth", F.lit(0)), "bfs")
    hubs = g.degrees().where(F.col("degree") >= hub_threshold(g)).select("id") if guard else None
    for level in range(depth):
        front = seen.where(F.col("depth") == level).select(F.col("id").alias("source"))
        if hubs is not None and level:
            front = front.join(hubs.withColumnRenamed("id", "source"), "source", "left_anti")
        step = edges.join(front, "source", "left_semi").select(F.col("target").alias("id")).distinct()
        found = step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(level + 1))
        seen = stored(spark, seen.unionByName(found), "bfs")
    return seen


def affected(spark: SparkSession, g: PropertyGraph, seeds: DataFrame, relations: Iterable[str] = IMPACT_RELATIONS, depth: int = 2) -> DataFrame:
    """Reverse impact: (id, depth, via_relation) of what depends on the seeds; the smallest relation names a tie."""
    edges = g.edges.where(F.col("relation").isin(*relations)).select("source", "target", "relation")
    seen = stored(spark, seeds.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit("").alias("via_relation")), "affected")
    for level in range(depth):
        front = seen.where(F.col("depth") == level).select(F.col("id").alias("target"))
        step = edges.join(front, "target").groupBy(F.col("source").alias("id")).agg(F.min("relation").alias("via_relation"))
        found = step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level + 1).alias("depth"), "via_relation")
        seen = stored(spark, seen.unionByName(found), "affected")
    return seen.where("depth > 0")


def shortest_path(spark: SparkSession, g: PropertyGraph, source: str, target: str, max_hops: int = 8) -> DataFrame:
    """(hop, src, dst) of one shortest undirected path; among parents the smallest id. Empty if there is none."""
    edges = g.edges.select("source", "target")
    both = edges.unionAll(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source != target")
    seen = stored(spark, spark.range(1).select(F.lit(source).alias("id"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("parent")), "path")
    for hop in range(1, max_hops + 1):
        front = seen.where(F.col("hop") == hop - 1).select(F.col("id").alias("source"))
        step = both.join(front, "source").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"))
        found = step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), "parent")
        seen = stored(spark, seen.unionByName(found), "path")
        if seen.where(F.col("id") == target).limit(1).count():
            break
    rows, at = [], target
    for _ in range(max_hops + 1):  # walks back over at most max_hops rows
        row = seen.where(F.col("id") == at).first()
        if row is None or row.parent is None:
            break
        rows.append((row.hop, row.parent, at))
        at = row.parent
    return spark.createDataFrame(sorted(rows), "hop int, src string, dst string")


def _closure(spark: SparkSession, edges: DataFrame, roots: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., id) reached from the roots, until a round adds none: visited rows are not walked again, so cycles end."""
    seen, k = stored(spark, roots.select(*by, "id").distinct().withColumn("round", F.lit(0)), "reach"), 0
    while True:
        front = seen.where(F.col("round") == k).select(*by, F.col("id").alias("source"))
        step = edges.join(front, "source").select(*by, F.col("target").alias("id")).where("id IS NOT NULL").distinct()
        found = stored(spark, step.join(seen.select(*by, "id"), [*by, "id"], "left_anti").withColumn("round", F.lit(k + 1)), "front")
        if not found.limit(1).count():
            discard(spark, found)
            return seen.select(*by, "id")
        before, seen, k = seen, stored(spark, seen.unionByName(found), "reach"), k + 1
        discard(spark, before, found)


def reachable(spark: SparkSession, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids reachable from the roots along (source, target), roots included; stops at the fixed point."""
    return _closure(spark, edges, roots, [])


def reachable_by_entry(spark: SparkSession, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, id) for several roots at once; stops at the fixed point."""
    return _closure(spark, edges, entries.select(F.col("id").alias("entry"), "id"), ["entry"])


def dead_code(spark: SparkSession, g: PropertyGraph, roots: DataFrame, kinds: tuple[str, ...] = ("calls", "passes", "constructs")) -> DataFrame:
    """Nodes that no root reaches over calling edges."""
    edges = g.edges.where(F.col("relation").isin(*kinds)).select("source", "target")
    return g.nodes.join(reachable(spark, edges, roots), "id", "left_anti").select("id", "label", "source_file")


def operations(spark: SparkSession, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, owner, kind): a helper that one entry reaches belongs to it, one that several reach connects them."""
    owners = reachable_by_entry(spark, edges, entries).groupBy("id").agg(F.count_distinct("entry").alias("n"), F.min("entry").alias("owner"))
    return owners.select("id", F.when(F.col("n") == 1, F.col("owner")).alias("owner"), F.when(F.col("n") == 1, "helper").otherwise("connector").alias("kind"))


def cycles(edges: DataFrame, max_length: int = 5, top_n: int = 20) -> DataFrame:
    """Simple directed cycles of 1..max_length, each from its smallest node; shortest first."""
    pairs = edges.select("source", "target").distinct()
    paths = pairs.where("source = target").select(F.array("source").alias("cycle"))
    walk = pairs.where("source < target").select(F.array("source", "target").alias("p"))
    for length in range(2, max_length + 1):
        at = walk.withColumn("source", F.element_at("p", -1)).join(pairs, "source")
        paths = paths.unionAll(at.where("target = p[0]").select(F.col("p").alias("cycle")))
        if length < max_length:
            walk = at.where("target > p[0] AND NOT array_contains(p, target)").select(F.concat("p", F.array("target")).alias("p"))
    return paths.select(F.size("cycle").alias("length"), F.array_join("cycle", "->").alias("cycle")).orderBy("length", "cycle").limit(top_n)


def neighbours(g: PropertyGraph, node: str, relation: str = "") -> DataFrame:
    """Successors and predecessors with their relation."""
    out = g.edges.where(F.col("source") == node).select(F.lit("out").alias("direction"), F.col("target").alias("neighbor"), "relation", "confidence")
    back = g.edges.where(F.col("target") == node).select(F.lit("in").alias("direction"), F.col("source").alias("neighbor"), "relation", "confidence")
    return out.unionAll(back).where(F.contains(F.lower("relation"), F.lit(relation.lower())))


def explain(g: PropertyGraph, node: str, top: int = 20) -> DataFrame:
    """A node's neighbours, best connected first."""
    return neighbours(g, node).join(g.degrees(), F.col("neighbor") == F.col("id")).select("direction", "neighbor", "relation", "degree").orderBy(F.desc("degree"), "neighbor", "relation", "direction").limit(top)


def graph_stats(g: PropertyGraph) -> DataFrame:
    mix = stats.confidence_mix(g).agg(F.sum(F.when(F.col("confidence") == "EXTRACTED", F.col("pct"))).alias("extracted_pct"), F.sum(F.when(F.col("confidence") == "INFERRED", F.col("pct"))).alias("inferred_pct"), F.sum(F.when(F.col("confidence") == "AMBIGUOUS", F.col("pct"))).alias("ambiguous_pct"), F.sum("n").alias("edges"))
    return g.nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("community").alias("communities")).crossJoin(mix)  # two single rows
