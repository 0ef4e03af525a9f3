"""What a graph is written as: node-link JSON, Cypher and GraphML lines, articles and a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.model import CONFIDENCE_SCORES, PropertyGraph
from lattice.operators import stats

def node_link_rows(g: PropertyGraph) -> DataFrame:
    """kind and one JSON object per node and edge: the distributed form of a node-link document."""
    score = F.element_at(F.create_map(*(F.lit(x) for p in CONFIDENCE_SCORES.items() for x in p)), F.col("confidence"))
    nodes = g.nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*g.nodes.columns)).alias("json"))
    edges = g.edges.withColumn("confidence_score", score)
    return nodes.unionAll(edges.select(F.lit("link"), F.to_json(F.struct(*edges.columns))))


def _quoted(c: str) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher(g: PropertyGraph) -> DataFrame:
    """One MERGE statement per node and edge."""
    label = F.concat(F.upper(F.substring("file_type", 1, 1)), F.substring("file_type", 2, 64))
    nodes = g.nodes.select(F.concat(F.lit("MERGE (n:"), label, F.lit(" {id: "), _quoted("id"), F.lit("}) SET n.label = "), _quoted("label"), F.lit(";")).alias("line"))
    kind = F.upper(F.regexp_replace("relation", "[^A-Za-z0-9_]", "_"))
    edges = g.edges.select(F.concat(F.lit("MATCH (a {id: "), _quoted("source"), F.lit("}), (b {id: "), _quoted("target"), F.lit("}) MERGE (a)-[:"), kind, F.lit(" {confidence: "), _quoted("confidence"), F.lit("}]->(b);")))
    return nodes.unionAll(edges)


def _xml(c: str) -> Column:
    out = F.col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml(g: PropertyGraph) -> DataFrame:
    nodes = g.nodes.select(F.concat(F.lit('<node id="'), _xml("id"), F.lit('"><data key="label">'), _xml("label"), F.lit("</data></node>")).alias("line"))
    return nodes.unionAll(g.edges.select(F.concat(F.lit('<edge source="'), _xml("source"), F.lit('" target="'), _xml("target"), F.lit('"><data key="relation">'), _xml("relation"), F.lit("</data></edge>"))))


def articles(g: PropertyGraph, k: int = 25) -> DataFrame:
    """path, markdown: an article per community with its best connected members and its neighbours."""
    members = stats.top_members(g, k).join(g.nodes.select("id", "label"), "id")
    lines = members.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("- "), F.col("label"), F.lit(" ("), F.col("degree").cast("string"), F.lit(")")).alias("l")))).alias("m"))
    near = stats.cross_community(g).groupBy("community").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "other"))).alias("o"))
    rows = lines.join(near, "community", "left").join(stats.hub_labels(g).select("community", F.col("label").alias("title")), "community")
    others = F.array_join(F.transform(F.slice("o", 1, 10), lambda x: F.concat(F.lit("- community "), x.other.cast("string"), F.lit(": "), (-x.n).cast("string"))), "\n")
    text = F.concat_ws("\n", F.concat(F.lit("# "), F.col("title")), F.array_join(F.transform("m", lambda x: x.l), "\n"), F.lit("## Linked communities"), others)
    return rows.select(F.concat(F.lit("community_"), F.col("community").cast("string"), F.lit(".md")).alias("path"), text.alias("markdown"))


def report(g: PropertyGraph, top_n: int = 10) -> DataFrame:
    """section, line number, text."""
    mix = stats.confidence_mix(g).select(F.lit(1).alias("s"), F.col("confidence").alias("k"), F.concat(F.lit("confidence "), F.col("confidence"), F.lit(": "), F.col("n").cast("string"), F.lit(" ("), F.col("pct").cast("string"), F.lit("%)")).alias("text"))
    gods = stats.god_nodes(g, top_n).select(F.lit(2), F.format_string("%012d", 10**9 - F.col("degree")), F.concat(F.lit("hub "), F.col("label"), F.lit(": "), F.col("degree").cast("string")))
    groups = stats.cohesion(g).select(F.lit(3), F.format_string("%06d", F.col("community") + 1), F.concat(F.lit("community "), F.col("community").cast("string"), F.lit(": "), F.col("members").cast("string"), F.lit(" members")))
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("s").orderBy("k", "text"))
    return mix.unionAll(gods).unionAll(groups).withColumn("line", place).select(F.col("s").alias("section"), "line", "text")
