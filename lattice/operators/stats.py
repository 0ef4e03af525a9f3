"""Aggregations over a property graph: degrees, mixes, communities, projections and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.functions import predicates as P
from lattice.model import PropertyGraph


def degree_in_out(g: PropertyGraph) -> DataFrame:
    """id, n_in, n_out, w_in, w_out for every node; one aggregation over both ends."""
    ends = g.edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0.0).alias("wi"), F.col("weight").alias("wo"))
    ends = ends.unionAll(g.edges.select("target", F.lit(1), F.lit(0), "weight", F.lit(0.0)))
    sums = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.sum("wi").alias("w_in"), F.sum("wo").alias("w_out"))
    return g.nodes.select("id").join(sums, "id", "left").fillna(0)


def god_nodes(g: PropertyGraph, top_n: int = 10) -> DataFrame:
    """The most connected real entities: file, concept, JSON-key nodes are left out; ties by id."""
    rows = g.nodes.join(g.degrees(), "id")
    noise = P.is_file_node(F.col("label"), F.col("source_file"), F.col("degree")) | P.is_concept_node(F.col("source_file")) | P.is_json_key_node(F.col("label"), F.col("source_file"))
    return rows.where(~noise).orderBy(F.desc("degree"), "id").limit(top_n).select("id", "label", "degree")


def rank_nodes(g: PropertyGraph, top_n: int = 10, kinds: tuple[str, ...] | None = None, confidences: tuple[str, ...] | None = None, hub_files: int = 3) -> DataFrame:
    """Weighted in and out degree, score, and the utility-hub flag (many caller files, little going out)."""
    edges = g.edges
    if kinds:
        edges = edges.where(F.col("relation").isin(*kinds))
    if confidences:
        edges = edges.where(F.col("confidence").isin(*confidences))
    degrees = degree_in_out(PropertyGraph(g.nodes, edges))
    files = edges.groupBy(F.col("target").alias("id")).agg(F.count_distinct("source_file").alias("files"))
    rows = g.nodes.select("id", "label", "source_file").join(degrees, "id").join(files, "id", "left").fillna(0, ["files"])
    hub = (F.col("files") >= hub_files) & (F.col("n_in") >= 3) & (F.col("n_out") <= 1)
    rows = rows.select("id", "label", "n_in", "n_out", (F.col("w_in") + F.col("w_out")).alias("score"), hub.alias("utility_hub"))
    return rows.orderBy(F.desc("score"), "id").limit(top_n)


def confidence_mix(g: PropertyGraph) -> DataFrame:
    every = g.edges.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
    return every.withColumn("pct", F.bround(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 0).cast("int"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def located_edges(g: PropertyGraph) -> DataFrame:
    """Edges with the community of both ends (s_c, t_c)."""
    place = g.nodes.select("id", "community")
    out = g.edges.join(place.select(F.col("id").alias("source"), F.col("community").alias("s_c")), "source")
    return out.join(place.select(F.col("id").alias("target"), F.col("community").alias("t_c")), "target")


def cohesion(g: PropertyGraph) -> DataFrame:
    """Per community: members, inner edges between distinct unordered pairs, and their share of all pairs."""
    pairs = located_edges(g).where("s_c = t_c AND source != target").select("s_c", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    inner = pairs.groupBy(F.col("s_c").alias("community")).agg(F.count(F.lit(1)).alias("inner_edges"))
    sizes = g.nodes.groupBy("community").agg(F.count(F.lit(1)).alias("members"))
    n = F.col("members").cast("double")
    rows = sizes.join(inner, "community", "left").fillna(0, ["inner_edges"])
    return rows.withColumn("cohesion", F.when(n <= 1, 1.0).otherwise(F.round(F.col("inner_edges") / (n * (n - 1) / 2), 6)))


def community_signature(g: PropertyGraph) -> DataFrame:
    """Members and a hash of the sorted ids, each followed by NUL: its first 16 hex digits.

    Sorting and hashing needs a community's ids in one place; ids only, never rows.
    """
    ids = F.sort_array(F.collect_list("id"))
    text = F.concat(F.array_join(ids, "\0"), F.lit("\0"))
    return g.nodes.groupBy("community").agg(F.count(F.lit(1)).alias("members"), F.substring(F.sha2(text, 256), 1, 16).alias("signature"))


def cross_community(g: PropertyGraph) -> DataFrame:
    both = located_edges(g).where("s_c != t_c")
    ends = both.select(F.col("s_c").alias("community"), F.col("t_c").alias("other")).unionAll(both.select("t_c", "s_c"))
    return ends.groupBy("community", "other").agg(F.count(F.lit(1)).alias("n"))


def meta_graph(g: PropertyGraph) -> DataFrame:
    pair = located_edges(g).where("s_c != t_c").groupBy(F.least("s_c", "t_c").alias("low"), F.greatest("s_c", "t_c").alias("high"))
    return pair.agg(F.count(F.lit(1)).alias("n"))


def module_projection(g: PropertyGraph, by: str = "source_file") -> DataFrame:
    """Edges between modules; calls and passes count as calls; edges inside a module are dropped."""
    place = g.nodes.select("id", F.col(by).alias("m"))
    edges = g.edges.select("source", "target", F.when(F.col("relation") == "passes", "calls").otherwise(F.col("relation")).alias("kind"), "weight")
    edges = edges.join(place.select(F.col("id").alias("source"), F.col("m").alias("from_module")), "source").join(place.select(F.col("id").alias("target"), F.col("m").alias("to_module")), "target")
    return edges.where("from_module != to_module").groupBy("from_module", "to_module", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def hub_labels(g: PropertyGraph) -> DataFrame:
    """Each community named after its best connected member, ties by id."""
    rows = g.nodes.join(g.degrees(), "id", "left").fillna(0, ["degree"])
    best = rows.groupBy("community").agg(F.min_by(F.struct("id", "label", "degree"), F.struct(-F.col("degree"), F.col("id"))).alias("b"))
    return best.select("community", "b.id", "b.label", "b.degree")


def top_members(g: PropertyGraph, k: int = 3) -> DataFrame:
    rows = g.nodes.join(g.degrees(), "id", "left").fillna(0, ["degree"])
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("community", "rank", "id", "degree")


def degree_at(g: PropertyGraph, percent: int) -> DataFrame:
    """The degree at position max(0, int(n * p / 100) - 1) of the ascending degrees: no interpolation.

    Degrees are counted first, so the running sum is over distinct degrees, not nodes.
    """
    counts = g.degrees().groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    run = counts.withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    place = F.greatest(F.lit(0), F.floor(F.col("total") * percent / 100) - 1)
    return run.where(F.col("upto") > place).agg(F.min("degree").alias("degree"))


def diagnostics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of defect counts over raw nodes and edges: one pass per table, and two key aggregations."""
    ids = nodes.select("id").distinct().withColumn("known", F.lit(True))
    rows = edges.join(ids.select(F.col("id").alias("source"), F.col("known").alias("ks")), "source", "left")
    rows = rows.join(ids.select(F.col("id").alias("target"), F.col("known").alias("kt")), "target", "left")
    missing = F.col("source").isNull() | F.col("target").isNull()
    loose = ~missing & (F.col("ks").isNull() | F.col("kt").isNull())
    whole = rows.agg(F.count(F.lit(1)).alias("edges"), F.count_if(missing).alias("missing_endpoint"), F.count_if(loose).alias("dangling"), F.count_if(F.col("source") == F.col("target")).alias("self_loops"))
    same = edges.groupBy("source", "target", "relation").agg(F.count(F.lit(1)).alias("n"))
    pairs = same.groupBy("source", "target").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") - 1).alias("extra"))
    pairs = pairs.agg(F.sum("extra").alias("exact_duplicates"), F.count_if(F.col("kinds") > 1).alias("variant_groups"))
    return whole.crossJoin(pairs)  # two single rows


def tree_rollup(paths: DataFrame, column: str = "path") -> DataFrame:
    """Files below each directory prefix."""
    parts = F.filter(F.split(F.col(column), "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return paths.select(F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("total_count"))


def feature_accounting(g: PropertyGraph) -> DataFrame:
    """Per community as feature: inner and outer edge weight, their ratio, and the file most of it lies in."""
    rows = located_edges(g)
    ends = rows.select(F.col("s_c").alias("feature"), (F.col("s_c") == F.col("t_c")).alias("inside"), "weight").unionAll(rows.where("s_c != t_c").select("t_c", F.lit(False), "weight"))
    sums = ends.groupBy("feature").agg(F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0.0)).alias("internal"), F.sum(F.when(F.col("inside"), 0.0).otherwise(F.col("weight"))).alias("external"))
    files = g.nodes.groupBy(F.col("community").alias("feature"), "source_file").agg(F.count(F.lit(1)).alias("n"))
    files = files.groupBy("feature").agg(F.min_by("source_file", F.struct(-F.col("n"), F.col("source_file"))).alias("dominant"), F.round(F.max("n") / F.sum("n"), 3).alias("share"))
    ratio: Column = F.round(F.col("internal") / (F.col("internal") + F.col("external")), 3)
    return sums.join(files, "feature").select("feature", "internal", "external", ratio.alias("cohesion"), "dominant", "share")


