"""Communities: Louvain on module graphs, full clustering with its split rules, remapping, betweenness."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.operators.components import connected_components
from lattice.storage import stored

# How much an edge of each confidence counts; passes and least gain of local moving; when clusters are split.
CONFIDENCE_WEIGHT = {"EXTRACTED": 1.0, "INFERRED": 0.6, "AMBIGUOUS": 0.3}
PASSES, EPSILON = 50, 1e-12
MAX_SHARE, MIN_SPLIT, THIN_COHESION, THIN_SIZE = 0.25, 10, 0.05, 50
#: A component's edges are moved in one task; beyond this many they would not fit it.
MAX_TASK_EDGES = 20_000_000


class _Adjacency:
    """Undirected weighted edges between 0 .. n - 1 as sorted arrays; loops count in strengths, not as neighbours."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, loops: np.ndarray | None = None):
        self.n, self.loops = n, np.zeros(n) if loops is None else loops
        tail, head, weight = np.r_[a, b], np.r_[b, a], np.r_[w, w]
        order = np.lexsort((head, tail))
        self.head, self.weight = head[order], weight[order]
        self.cut = np.searchsorted(tail[order], np.arange(n + 1))
        self.strength = np.bincount(tail, weight, n) + 2 * self.loops

    def moved(self, total: float, resolution: float = 1.0, passes: int = PASSES) -> np.ndarray:
        """Communities after moving nodes, in order, to the neighbouring one that gains most; ties go to the smallest number.

        ``total`` is the sum of strengths of the graph that modularity is taken over.
        """
        place, mass = np.arange(self.n), self.strength.copy()
        for _ in range(passes):
            before = place.copy()
            for v in np.flatnonzero(np.diff(self.cut)).tolist():
                part = slice(self.cut[v], self.cut[v + 1])
                around, at = np.unique(np.r_[place[self.head[part]], place[v]], return_inverse=True)
                ties = np.bincount(at, np.r_[self.weight[part], 0.0])
                mass[place[v]] -= self.strength[v]
                gain = ties - resolution * mass[around] * self.strength[v] / total
                stay = gain[at[-1]]
                if gain.max() > stay + EPSILON:
                    place[v] = around[np.flatnonzero(gain >= gain.max() - EPSILON)[0]]
                mass[place[v]] += self.strength[v]
            if (place == before).all():
                break
        return np.unique(place, return_inverse=True)[1]

    def folded(self, place: np.ndarray) -> _Adjacency:
        """The graph of the communities."""
        n = int(place.max()) + 1
        tail, head = place[np.repeat(np.arange(self.n), np.diff(self.cut))], place[self.head]
        inside = np.bincount(tail[tail == head], self.weight[tail == head], n) / 2 + np.bincount(place, self.loops, n)
        up = tail < head
        code, at = np.unique(tail[up] * n + head[up], return_inverse=True)
        return _Adjacency(n, code // n, code % n, np.bincount(at, self.weight[up], len(code)), inside)


def _numbered(ids: list[str], links: list[tuple[str, str, float]]) -> tuple[list[str], _Adjacency]:
    names = sorted(ids)
    at = {v: i for i, v in enumerate(names)}
    rows = [(at[a], at[b], w) for a, b, w in links if a != b]
    a, b, w = (np.array([r[k] for r in rows], t) for k, t in ((0, np.int64), (1, np.int64), (2, float)))
    return names, _Adjacency(len(names), a, b, w)


def louvain_labels(ids: list[str], links: list[tuple[str, str, float]]) -> dict[str, int]:
    """One level of local moving; communities numbered by falling size, then smallest member."""
    names, graph = _numbered(ids, links)
    total = graph.strength.sum()
    place = graph.moved(total) if total else np.arange(len(names))
    members = pd.Series(names).groupby(place).agg(["size", "min"]).sort_values(["size", "min"], ascending=[False, True])
    rank = {c: i for i, c in enumerate(members.index)}
    return {v: rank[c] for v, c in zip(names, place.tolist(), strict=True)}


def partition_labels(ids: list[str], links: list[tuple[str, str, float]], total: float | None = None, resolution: float = 1.0, levels: int = 10) -> dict[str, int]:
    """Louvain over several levels: communities are folded into nodes and moved again until nothing joins."""
    names, graph = _numbered(ids, links)
    total = total or graph.strength.sum()
    place = np.arange(len(names))
    for _ in range(levels if total else 0):
        step = graph.moved(total, resolution)
        if step.max(initial=-1) + 1 == graph.n:
            break
        place, graph = step[place], graph.folded(step)
    return dict(zip(names, place.tolist(), strict=True))


def _by_part(pairs: DataFrame, part: str, label) -> DataFrame:
    """(id, part, local): the labels that ``label(ids, links)`` gives each part of the pairs (part, a, b, w); one task a part."""
    kind = dict(pairs.dtypes)[part]
    if (pairs.groupBy(part).count().agg(F.max("count")).first()[0] or 0) > MAX_TASK_EDGES:
        raise ValueError("a component has more edges than one task can hold; cluster a projected graph, or exclude its hubs")

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        found = label(sorted({*pdf.a, *pdf.b}), list(zip(pdf.a, pdf.b, pdf.w, strict=True)))
        return pd.DataFrame({"id": list(found), "part": pdf[part].iloc[0], "local": list(found.values())})

    return pairs.select(part, "a", "b", "w").groupBy(part).applyInPandas(move, f"id string, part {kind}, local int")


def _global_rank(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``rank`` from 0 by the order, which must be total: ranges of rows are counted, then numbered apart."""
    spark = rows.sparkSession
    dealt = stored(spark, rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "dealt")
    before = F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    ahead = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).select("_p", F.coalesce(before, F.lit(0)).alias("_ahead"))
    here = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.join(F.broadcast(ahead), "_p").withColumn("rank", (here + F.col("_ahead")).cast("int")).drop("_p", "_ahead")


def louvain(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community) on a graph of modules.

    Modularity moves depend on one another, so they run per connected component, one task each: apply it to
    projected module graphs, whose components are small, not to raw entity graphs. nodes: id; edges: source, target, weight,
    confidence. Isolated nodes are communities of their own.
    """
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in CONFIDENCE_WEIGHT.items() for x in p)), F.col("confidence")), F.lit(0.5))
    pairs = edges.where("source != target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum(F.col("weight") * weight).alias("w"))
    pairs = stored(spark, pairs, "pairs")
    local = _by_part(pairs.join(connected_components(spark, pairs, "a", "b").toDF("a", "component"), "a"), "component", louvain_labels)
    every = nodes.select("id").join(local, "id", "left").select("id", F.coalesce("part", "id").alias("part"), F.coalesce("local", F.lit(0)).alias("local"))
    return _renumbered(every)


def _renumbered(every: DataFrame) -> DataFrame:
    """(id, community) from (id, part, local): numbered by falling size, then smallest member."""
    sizes = every.groupBy("part", "local").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low"))
    ranked = _global_rank(sizes, F.desc("size"), F.asc("low"))
    return every.join(ranked.select("part", "local", F.col("rank").alias("community")), ["part", "local"]).select("id", "community")


def _split(spark: SparkSession, every: DataFrame, pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """(id, part, local) with the communities in ``wide`` (part, local) cut by a clustering of their own subgraphs."""
    wide = stored(spark, wide.select("part", "local", F.concat_ws("/", "part", "local").alias("inner")), "wide")
    if wide.isEmpty():
        return every
    inside = every.join(F.broadcast(wide) if wide.count() < 10_000 else wide, ["part", "local"])
    ends = inside.select("id", "inner")
    cut = pairs.join(ends.toDF("a", "inner"), "a").join(ends.toDF("b", "other"), "b").where("inner = other").drop("other")
    found = _by_part(cut, "inner", partition_labels).withColumnRenamed("local", "l")
    # without an edge inside its community a node stands alone
    anew = inside.join(found.select("id", "l"), "id", "left").select("id", F.when(F.col("l").isNull(), F.concat_ws("/", "inner", "id")).otherwise(F.col("inner")).alias("part"), F.coalesce("l", F.lit(0)).alias("local"))
    rest = every.join(wide.select("part", "local"), ["part", "local"], "left_anti")
    return stored(spark, rest.select("id", "part", "local").unionByName(anew), "split")


def cluster(spark: SparkSession, nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, exclude_hubs_percentile: float | None = None) -> DataFrame:
    """(id, community): the full clustering of an entity graph; nodes: id, edges: source, target (directions do not count).

    Hubs, nodes over the degree at ``exclude_hubs_percentile``, take no part in the moves and join the community that most of their
    other neighbours are in (ties: the smallest; hubs among themselves do not vote). Isolated nodes stand alone. A
    community over a quarter of the graph (ten nodes at least) is clustered again by itself, and so is one of fifty
    or more with a cohesion under 0.05. Numbers fall with size, then follow the smallest member. Moves run per connected component
    with the whole graph's modularity, so a component has to fit a task; a larger one raises.
    """
    nodes = nodes.select("id").distinct()
    n = nodes.count()
    pairs = edges.where("source != target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    known = lambda end: nodes.withColumnRenamed("id", end)
    pairs = stored(spark, pairs.join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi").withColumn("w", F.lit(1.0)), "pairs")
    ends = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    calm, hubs = pairs, None
    if exclude_hubs_percentile is not None:
        degrees = nodes.join(ends.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "id", "left").fillna(0, ["degree"])
        place, seen, limit = max(0, int(n * exclude_hubs_percentile / 100) - 1), 0, 0
        for degree, count in sorted(degrees.groupBy("degree").agg(F.count(F.lit(1))).collect()):  # distinct degrees only
            limit, seen = degree, seen + count
            if seen > place:
                break
        hubs = stored(spark, degrees.where(F.col("degree") > limit).select("id"), "hubs")
        calm = pairs.join(hubs.toDF("a"), "a", "left_anti").join(hubs.toDF("b"), "b", "left_anti")
        calm = stored(spark, calm, "calm")
    total = 2.0 * calm.count()
    label = lambda ids, links: partition_labels(ids, links, total, resolution)
    local = _by_part(calm.join(connected_components(spark, calm, "a", "b").toDF("a", "component"), "a"), "component", label)
    every = nodes.join(local, "id", "left").select("id", F.coalesce("part", "id").alias("part"), F.coalesce("local", F.lit(0)).alias("local"))
    every = stored(spark, every, "moved")
    if hubs is not None:
        votes = ends.join(hubs.toDF("a"), "a", "left_semi").join(every.toDF("b", "part", "local").join(hubs.toDF("b"), "b", "left_anti"), "b")
        low = every.groupBy("part", "local").agg(F.min("id").alias("low"))
        votes = votes.groupBy("a", "part", "local").agg(F.count(F.lit(1)).alias("votes")).join(low, ["part", "local"])
        won = votes.groupBy(F.col("a").alias("id")).agg(F.min_by(F.struct("part", "local"), F.struct(-F.col("votes"), "low")).alias("to"))
        every = every.join(won, "id", "left").select("id", F.coalesce("to.part", "part").alias("part"), F.coalesce("to.local", "local").alias("local"))
        every = stored(spark, every, "joined")
    sizes = every.groupBy("part", "local").agg(F.count(F.lit(1)).alias("size"))
    every = _split(spark, every, pairs, sizes.where(F.col("size") > max(MIN_SPLIT, int(n * MAX_SHARE))))
    sizes = every.groupBy("part", "local").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= THIN_SIZE)
    inner = pairs.join(every.toDF("a", "part", "local"), "a").join(every.toDF("b", "p", "l"), "b").where("part = p AND local = l")
    inner = inner.groupBy("part", "local").agg(F.count(F.lit(1)).alias("inner"))
    thin = sizes.join(inner, ["part", "local"], "left").where(F.coalesce("inner", F.lit(0)) / (F.col("size") * (F.col("size") - 1) / 2) < THIN_COHESION)
    return _renumbered(_split(spark, every, pairs, thin))


def remap_communities(old: DataFrame, new: DataFrame) -> dict[int, int]:
    """New community ids to stable ones: greedy by shared members, then fresh ids by size; one row per pair to the driver."""
    shared = old.toDF("id", "o").join(new.toDF("id", "n"), "id").groupBy("n", "o").agg(F.count(F.lit(1)).alias("k"))
    out: dict[int, int] = {}
    taken: set[int] = set()
    for r in shared.orderBy(F.desc("k"), "o", "n").collect():
        if r.n not in out and r.o not in taken:
            out[r.n] = r.o
            taken.add(r.o)
    fresh = 0
    for r in new.toDF("id", "n").groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "n").collect():
        if r.n not in out:
            while fresh in taken:
                fresh += 1
            out[r.n] = fresh
            taken.add(fresh)
    return out


def betweenness(spark: SparkSession, nodes: DataFrame, edges: DataFrame, max_edges: int = 2_000_000, exact_nodes: int = 1000, pivots: int = 100) -> DataFrame:
    """(id, betweenness), undirected and normalised: Brandes from each source, sources spread over tasks.

    The adjacency is broadcast, so its size is checked; above ``exact_nodes`` nodes, ``pivots`` sources chosen by a hash
    stand for all and the sums are scaled.
    """
    pairs = edges.select("source", "target").where("source != target").distinct()
    if pairs.count() > max_edges:
        raise ValueError("betweenness is for projected graphs; the edge list exceeds max_edges")
    near: dict[str, set[str]] = defaultdict(set)
    for a, b in pairs.collect():
        near[a].add(b)
        near[b].add(a)
    n = nodes.count()
    sources = nodes.select("id").orderBy(F.xxhash64("id"), "id").limit(pivots) if n > exact_nodes else nodes.select("id")
    scale = (n / pivots if n > exact_nodes else 1.0) / max(1.0, (n - 1) * (n - 2))
    shared = spark.sparkContext.broadcast({k: sorted(v) for k, v in near.items()})

    def run(batches):
        for pdf in batches:
            total: dict[str, float] = defaultdict(float)
            for s in pdf.id:
                order, preds, paths, depth = [s], defaultdict(list), {s: 1.0}, {s: 0}
                for v in order:
                    for w in shared.value.get(v, ()):
                        if w not in depth:
                            depth[w] = depth[v] + 1
                            paths[w] = 0.0
                            order.append(w)
                        if depth[w] == depth[v] + 1:
                            paths[w] += paths[v]
                            preds[w].append(v)
                flow: dict[str, float] = defaultdict(float)
                for w in reversed(order):
                    for v in preds[w]:
                        flow[v] += paths[v] / paths[w] * (1 + flow[w])
                    if w != s:
                        total[w] += flow[w]
            yield pd.DataFrame({"id": list(total), "part": list(total.values())}).astype({"id": "object", "part": "float64"})

    parts = sources.mapInPandas(run, "id string, part double").groupBy("id").agg((F.sum("part") * scale).alias("b"))
    return nodes.select("id").join(parts, "id", "left").select("id", F.round(F.coalesce("b", F.lit(0.0)), 9).alias("betweenness"))
