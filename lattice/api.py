"""The question-answering surface over one graph: what a tool server would expose, as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.functions import predicates as P
from lattice.model import IMPACT_RELATIONS, PropertyGraph
from lattice.operators import analysis, search, stats, traverse
from lattice.operators.merge import graph_diff

# Fixed words of a question that ask for one kind of edge.
CONTEXT_WORDS = {"call": ("call", "calls", "called", "caller", "callers", "invoke", "invokes"), "import": ("import", "imports", "imported"), "field": ("field", "fields", "member"), "parameter_type": ("parameter", "parameters", "argument"), "return_type": ("return", "returns"), "attribute": ("attribute", "attributes"), "export": ("export", "exports", "exported")}
MAX_DEPTH = 6


def contexts_of(question: str) -> list[str]:
    words = set(re.findall(r"\w+", question.lower()))
    return [name for name, cues in CONTEXT_WORDS.items() if words & set(cues)]


def depth_first(spark: SparkSession, g: PropertyGraph, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth, ord) in stack order.

    The order is sequential by definition, so the neighbourhood is first cut out level by level, and its edges, bounded by the
    hub guard and the depth, are walked in one task.
    """
    near = traverse.bfs(spark, g, seeds, depth).select("id")
    edges = g.edges.select("source", "target")
    both = edges if g.directed else edges.unionAll(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    inside = both.join(near.withColumnRenamed("id", "source"), "source", "left_semi").join(near.withColumnRenamed("id", "target"), "target", "left_semi").distinct()
    starts = [r.id for r in seeds.collect()]
    hubs = {r.id for r in g.degrees().where(F.col("degree") >= traverse.hub_threshold(g)).join(near, "id", "left_semi").collect()}

    def walk(pdf):
        import pandas as pd

        out: dict[str, list[str]] = {}
        for s, t in zip(pdf.source, pdf.target, strict=True):
            out.setdefault(s, []).append(t)
        seen, stack = {}, [(s, 0) for s in reversed(starts)]
        while stack:
            node, d = stack.pop()
            if node in seen or d > depth:
                continue
            seen[node] = d
            if node in hubs and node not in starts:
                continue
            stack += [(t, d + 1) for t in sorted(out.get(node, [])) if t not in seen]
        return pd.DataFrame({"id": list(seen), "depth": list(seen.values()), "ord": range(len(seen))})

    walked = inside.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(walk, "id string, depth int, ord int")
    alone = seeds.select("id", F.lit(0).alias("depth"), F.lit(0).alias("ord")).join(inside.select(F.col("source").alias("id")), "id", "left_anti").join(inside.select(F.col("target").alias("id")), "id", "left_anti")
    return walked.unionByName(alone)


class GraphQueries:
    """Ten tools over a graph: each returns a DataFrame."""

    def __init__(self, spark: SparkSession, graph: PropertyGraph):
        self.spark, self.g = spark, graph

    def query_graph(self, question: str, mode: str = "bfs", depth: int = 3, token_budget: int = 2000, context_filter: list[str] | None = None) -> DataFrame:
        """Lines of the neighbourhood of the best matches, seeds first, then by degree, cut at the token budget."""
        wanted = context_filter or contexts_of(question)
        g = self.g if not wanted else PropertyGraph(self.g.nodes, self.g.edges.where(F.col("context").isin(*wanted)), self.g.directed)
        seeds = search.pick_seeds(search.score_nodes(self.g.nodes, question)).select("id")
        reach = depth_first if mode == "dfs" else traverse.bfs
        found = reach(self.spark, g, seeds, min(depth, MAX_DEPTH)).select("id", "depth")
        about = found.join(self.g.nodes, "id").join(g.degrees(), "id", "left").fillna(0, ["degree"])
        at = lambda c: P.sanitise(F.coalesce(F.col(c).cast("string"), F.lit("")))
        lines = about.select(F.lit("node").alias("kind"), F.when(F.col("depth") == 0, 0).otherwise(1).alias("a"), (-F.col("degree")).alias("b"), "id", F.lit("").alias("dst"), F.concat(F.lit("NODE "), at("label"), F.lit(" [src="), at("source_file"), F.lit(" community="), at("community"), F.lit("]")).alias("line"))
        ids = found.select("id")
        inner = g.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        edge = F.concat(F.lit("EDGE "), at("source"), F.lit(" --"), at("relation"), F.lit(" ["), at("confidence"), F.lit("]--> "), at("target"))
        lines = lines.unionAll(inner.select(F.lit("edge"), F.lit(2), F.lit(0), "source", "target", edge))
        return search.within_budget(lines, "line", ["a", "b", "id", "dst", "line"], token_budget).select("kind", "line", "cum_chars")

    def get_node(self, label: str) -> DataFrame:
        hit = (F.col("id") == label) | F.contains(F.lower("label"), F.lit(label.lower()))
        return self.g.nodes.where(hit).join(self.g.degrees(), "id", "left").fillna(0, ["degree"])

    def get_neighbors(self, node: str, relation: str = "") -> DataFrame:
        return traverse.neighbours(self.g, node, relation)

    def get_community(self, community: int) -> DataFrame:
        return self.g.nodes.where(F.col("community") == community).select("id", "label", "source_file")

    def god_nodes(self, top_n: int = 10) -> DataFrame:
        return stats.god_nodes(self.g, top_n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "id")))

    def graph_stats(self) -> DataFrame:
        return traverse.graph_stats(self.g)

    def shortest_path(self, source: str, target: str, max_hops: int = 8) -> DataFrame:
        """Hops with the relation and whether the edge runs forward."""
        ends = [search.resolve_seed(self.g.nodes, q).first() for q in (source, target)]
        if None in ends:
            return self.spark.createDataFrame([], "hop int, src string, dst string, relation string, confidence string, forward boolean")
        hops = traverse.shortest_path(self.spark, self.g, ends[0].id, ends[1].id, max_hops)
        e = self.g.edges.select("source", "target", "relation", "confidence")
        rows = hops.join(e, ((F.col("source") == F.col("src")) & (F.col("target") == F.col("dst"))) | ((F.col("source") == F.col("dst")) & (F.col("target") == F.col("src"))))
        best = F.min(F.struct((F.col("source") != F.col("src")).alias("back"), "relation", "confidence"))
        return rows.groupBy("hop", "src", "dst").agg(best.alias("b")).select("hop", "src", "dst", "b.relation", "b.confidence", (~F.col("b.back")).alias("forward"))

    def affected(self, query: str, relations: tuple[str, ...] = IMPACT_RELATIONS, depth: int = 2) -> DataFrame:
        return traverse.affected(self.spark, self.g, search.resolve_seed(self.g.nodes, query), relations, depth).join(self.g.nodes.select("id", "label", "source_file"), "id")

    def surprising_connections(self, top_n: int = 5) -> DataFrame:
        several = self.g.nodes.where("coalesce(source_file, '') != ''").select("source_file").distinct().limit(2).count() > 1
        return analysis.surprises(self.g, top_n) if several else analysis.community_surprises(self.g, top_n)

    def diff(self, newer: PropertyGraph) -> DataFrame:
        """Added and removed nodes and edges; undirected graphs compare pairs without direction."""
        order = (lambda df: df.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "relation")) if not self.g.directed else (lambda df: df.select(F.col("source").alias("a"), F.col("target").alias("b"), "relation"))
        nodes = graph_diff(self.g.nodes, newer.nodes, ["id"]).select("change", F.lit("node").alias("kind"), F.col("id").alias("key"))
        edges = graph_diff(order(self.g.edges), order(newer.edges), ["a", "b", "relation"])
        return nodes.unionAll(edges.select("change", F.lit("edge"), F.concat_ws(" ", "a", "relation", "b")))
