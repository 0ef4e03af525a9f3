"""Registered queries over the driver tables, first part: the star graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.functions import predicates as P
from lattice.model import PropertyGraph
from lattice.operators import analysis, merge, resolve, search, stats, traverse
from lattice.operators.components import connected_components
from lattice.plans import sinks
from lattice.plans.star import STAR_SQL, read, star_graph

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

DEGREES = "g_deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM g_edges UNION ALL SELECT target FROM g_edges) GROUP BY id)"
LOCATED = "g_loc AS (SELECT e.*, a.community AS s_c, b.community AS t_c FROM g_edges e JOIN g_nodes a ON a.id = e.source JOIN g_nodes b ON b.id = e.target)"


def query(sql: str | None = None, star: bool = True, extra: str = ""):
    """Register a query; its SQL follows the star graph's table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {STAR_SQL}{', ' + extra if extra else ''} {sql}" if star else sql
        return f

    return add


@query("SELECT id, label, degree FROM g_deg JOIN g_nodes USING (id) ORDER BY degree DESC, id LIMIT 10", extra=DEGREES)
def god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.god_nodes(star_graph(spark, sf_dir), 10)


@query("SELECT n.id, coalesce(sum(i), 0)::BIGINT AS n_in, coalesce(sum(o), 0)::BIGINT AS n_out, coalesce(sum(wi), 0)::DOUBLE AS w_in, coalesce(sum(wo), 0)::DOUBLE AS w_out FROM g_nodes n LEFT JOIN (SELECT source AS id, 0 AS i, 1 AS o, 0.0::DOUBLE AS wi, weight AS wo FROM g_edges UNION ALL SELECT target, 1, 0, weight, 0 FROM g_edges) e USING (id) GROUP BY n.id")
def degree_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.degree_in_out(star_graph(spark, sf_dir))


@query("SELECT n.id, n.label, coalesce(i, 0) AS n_in, coalesce(o, 0) AS n_out, (coalesce(wi, 0) + coalesce(wo, 0))::DOUBLE AS score, coalesce(f, 0) >= 1 AND coalesce(i, 0) >= 3 AND coalesce(o, 0) <= 1 AS utility_hub FROM g_nodes n LEFT JOIN (SELECT target AS id, count(*) AS i, sum(weight) AS wi, count(DISTINCT source_file) AS f FROM g_edges GROUP BY 1) a USING (id) LEFT JOIN (SELECT source AS id, count(*) AS o, sum(weight) AS wo FROM g_edges GROUP BY 1) b USING (id) ORDER BY score DESC, n.id LIMIT 20")
def rank_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rank_nodes(star_graph(spark, sf_dir), 20, hub_files=1)


@query("SELECT confidence, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 0)::INT AS pct FROM g_edges GROUP BY confidence")
def confidence_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.confidence_mix(star_graph(spark, sf_dir))


@query("SELECT relation AS kind, count(*) AS n FROM g_edges GROUP BY relation UNION ALL SELECT source_file, count(*) FROM g_nodes GROUP BY source_file")
def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    return stats.histogram(g.edges, "relation").unionAll(stats.histogram(g.nodes, "source_file"))


@query("SELECT s.community, s.members, coalesce(i.k, 0) AS inner_edges, CASE WHEN s.members <= 1 THEN 1.0 ELSE round(coalesce(i.k, 0) / (s.members::DOUBLE * (s.members - 1) / 2), 6) END::DOUBLE AS cohesion FROM (SELECT community, count(*) AS members FROM g_nodes GROUP BY 1) s LEFT JOIN (SELECT s_c, count(*) AS k FROM (SELECT DISTINCT s_c, least(source, target), greatest(source, target) FROM g_loc WHERE s_c = t_c AND source <> target) GROUP BY 1) i ON i.s_c = s.community", extra=LOCATED)
def cohesion_by_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cohesion(star_graph(spark, sf_dir))


@query("SELECT community, count(*) AS members, left(sha256(string_agg(id, chr(0) ORDER BY id) || chr(0)), 16) AS signature FROM g_nodes GROUP BY community")
def community_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.community_signature(star_graph(spark, sf_dir))


@query("SELECT community, other, count(*) AS n FROM (SELECT s_c AS community, t_c AS other FROM g_loc WHERE s_c <> t_c UNION ALL SELECT t_c, s_c FROM g_loc WHERE s_c <> t_c) GROUP BY ALL", extra=LOCATED)
def cross_community_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cross_community(star_graph(spark, sf_dir))


@query("SELECT least(s_c, t_c) AS low, greatest(s_c, t_c) AS high, count(*) AS n FROM g_loc WHERE s_c <> t_c GROUP BY ALL", extra=LOCATED)
def meta_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.meta_graph(star_graph(spark, sf_dir))


@query("SELECT a.source_file AS from_module, b.source_file AS to_module, relation AS kind, count(*) AS n, sum(weight)::DOUBLE AS weight FROM g_edges e JOIN g_nodes a ON a.id = e.source JOIN g_nodes b ON b.id = e.target WHERE a.source_file <> b.source_file GROUP BY ALL")
def module_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.module_projection(star_graph(spark, sf_dir))


@query("SELECT community, id, label, degree FROM (SELECT community, id, label, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, id) AS k FROM g_nodes LEFT JOIN g_deg USING (id)) WHERE k = 1", extra=DEGREES)
def community_hub_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hub_labels(star_graph(spark, sf_dir))


@query("SELECT community, rank::INT AS rank, id, degree FROM (SELECT community, id, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, id) AS rank FROM g_nodes LEFT JOIN g_deg USING (id)) WHERE rank <= 3", extra=DEGREES)
def community_top_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_members(star_graph(spark, sf_dir), 3)


@query("SELECT degree FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS place, count(*) OVER () AS total FROM g_deg) WHERE place = greatest(0, floor(total * 99 / 100) - 1)", extra=DEGREES)
def degree_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.degree_at(star_graph(spark, sf_dir), 99)


@query("SELECT f.feature, internal, external, round(internal / (internal + external), 3) AS cohesion, dominant, share FROM (SELECT feature, sum(CASE WHEN inside THEN weight ELSE 0 END)::DOUBLE AS internal, sum(CASE WHEN inside THEN 0 ELSE weight END)::DOUBLE AS external FROM (SELECT s_c AS feature, s_c = t_c AS inside, weight FROM g_loc UNION ALL SELECT t_c, false, weight FROM g_loc WHERE s_c <> t_c) GROUP BY 1) f JOIN (SELECT feature, arg_min(source_file, (-n) || source_file) AS x, first(source_file ORDER BY n DESC, source_file) AS dominant, round(max(n) / sum(n), 3)::DOUBLE AS share FROM (SELECT community AS feature, source_file, count(*) AS n FROM g_nodes GROUP BY ALL) GROUP BY 1) d USING (feature)", extra=LOCATED)
def feature_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.feature_accounting(star_graph(spark, sf_dir))


def _defective(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The star graph with planted defects: lost, repeated, reversed, mangled and looping edges."""
    g = star_graph(spark, sf_dir)
    e = g.edges.select("source", "target", "relation", "source_file").where("relation != 'uses'")
    bad = e.where("relation = 'references'").select("source", F.concat("target", F.lit("x")).alias("target"), "relation", "source_file")
    again = e.where("source_file = 'nation.parquet'")
    loop = again.select("source", F.col("source").alias("target"), "relation", "source_file")
    lost = again.select(F.lit(None).cast("string").alias("source"), "target", "relation", "source_file")
    other = again.select("source", "target", F.lit("imports").alias("relation"), "source_file")
    shout = e.where("relation = 'calls'").select(F.upper("source").alias("source"), "target", "relation", "source_file")
    return g.nodes, e.unionAll(bad).unionAll(again).unionAll(loop).unionAll(lost).unionAll(other).unionAll(shout)


DEFECTS = """d_base AS (SELECT source, target, relation, source_file FROM g_edges WHERE relation <> 'uses'),
d_edges AS (SELECT * FROM d_base UNION ALL SELECT source, target || 'x', relation, source_file FROM d_base WHERE relation = 'references'
 UNION ALL SELECT * FROM d_base WHERE source_file = 'nation.parquet' UNION ALL SELECT source, source, relation, source_file FROM d_base WHERE source_file = 'nation.parquet'
 UNION ALL SELECT NULL, target, relation, source_file FROM d_base WHERE source_file = 'nation.parquet' UNION ALL SELECT source, target, 'imports', source_file FROM d_base WHERE source_file = 'nation.parquet'
 UNION ALL SELECT upper(source), target, relation, source_file FROM d_base WHERE relation = 'calls')"""


@query("SELECT (SELECT count(*) FROM d_edges) AS edges, (SELECT count(*) FROM d_edges WHERE source IS NULL OR target IS NULL) AS missing_endpoint, (SELECT count(*) FROM d_edges WHERE source IS NOT NULL AND target IS NOT NULL AND (source NOT IN (SELECT id FROM g_nodes) OR target NOT IN (SELECT id FROM g_nodes))) AS dangling, (SELECT count(*) FROM d_edges WHERE source = target) AS self_loops, (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM d_edges GROUP BY source, target, relation)) AS exact_duplicates, (SELECT count(*) FROM (SELECT 1 FROM d_edges GROUP BY source, target HAVING count(DISTINCT relation) > 1)) AS variant_groups", extra=DEFECTS)
def diagnostics_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.diagnostics(*_defective(spark, sf_dir))


@query("SELECT source, target, relation FROM d_edges WHERE source IN (SELECT id FROM g_nodes) AND target IN (SELECT id FROM g_nodes)", extra=DEFECTS)
def edge_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _defective(spark, sf_dir)
    return merge.known_edges(edges, nodes).select("source", "target", "relation")


@query("SELECT source, target, relation FROM d_edges WHERE source IS NULL OR source NOT IN (SELECT id FROM g_nodes) OR target NOT IN (SELECT id FROM g_nodes)", extra=DEFECTS)
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _defective(spark, sf_dir)
    return merge.dangling_edges(edges, nodes).select("source", "target", "relation")


@query("SELECT coalesce(a.id, source) AS source, coalesce(b.id, target) AS target, relation FROM d_edges LEFT JOIN g_nodes a ON a.id = lower(source) LEFT JOIN g_nodes b ON b.id = lower(target)", extra=DEFECTS)
def endpoint_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _defective(spark, sf_dir)
    return merge.repair_endpoints(edges, nodes, F.lower).select("source", "target", "relation")


@query("SELECT source, target, relation, n FROM (SELECT source, target, relation, source_file, count(*) AS n FROM d_edges GROUP BY ALL)", extra=DEFECTS)
def edge_weight_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _defective(spark, sf_dir)
    return edges.groupBy("source", "target", "relation", "source_file").agg(F.count(F.lit(1)).alias("n")).drop("source_file")


@query("SELECT kind, problem, count(*) AS n FROM (SELECT 'edge' AS kind, 'source: missing' AS problem FROM d_edges WHERE source IS NULL UNION ALL SELECT 'edge', 'confidence: unknown' FROM d_edges WHERE source_file = 'order.parquet' UNION ALL SELECT 'node', 'file_type: unknown' FROM g_nodes WHERE source_file = 'region.parquet') GROUP BY ALL", extra=DEFECTS)
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _defective(spark, sf_dir)
    nodes = nodes.withColumn("file_type", F.when(F.col("source_file") == "region.parquet", "nonsense").otherwise(F.col("file_type")))
    edges = edges.withColumn("confidence", F.when(F.col("source_file") == "order.parquet", "SURE").otherwise("EXTRACTED"))
    return merge.violations(nodes, edges).groupBy("kind", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT e.source, e.target, coalesce(a.source_file, b.source_file) AS source_file FROM g_edges e LEFT JOIN g_nodes a ON a.id = e.source LEFT JOIN g_nodes b ON b.id = e.target")
def source_file_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    edges = g.edges.withColumn("source_file", F.lit(""))
    return merge.backfill_source_file(edges, g.nodes).select("source", "target", "source_file")


@query("SELECT id, label, source_file FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM g_nodes) WHERE k = 1")
def node_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_graph(spark, sf_dir).nodes.withColumn("ord", F.col("id"))
    return merge.first_wins(rows, ["label"]).select("id", "label", "source_file")


@query("SELECT id, label, source_file FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id DESC) AS k FROM g_nodes) WHERE k = 1")
def node_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_graph(spark, sf_dir).nodes.withColumn("ord", F.col("id"))
    return merge.last_wins(rows, ["label"]).select("id", "label", "source_file")


@query("SELECT o_custkey AS id, last(o_orderpriority ORDER BY o_orderkey) AS priority, last(CASE WHEN o_totalprice > 100000 THEN o_totalprice END ORDER BY CASE WHEN o_totalprice > 100000 THEN o_orderkey END NULLS FIRST) AS price FROM orders GROUP BY 1", star=False)
def compose_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"))
    return merge.last_attributes(rows, ["id"]).select("id", "priority", "price")


COLLAPSE = """c_edges AS (SELECT source, target, relation, confidence, weight FROM g_edges WHERE relation = 'references' UNION ALL SELECT target, source, relation, confidence, weight FROM g_edges WHERE source_file = 'customer.parquet'
 UNION ALL SELECT target, source, 'imports', confidence, weight + 1 FROM g_edges WHERE source_file = 'supplier.parquet' AND relation = 'references'),
c_first AS (SELECT *, min(source) OVER (PARTITION BY least(source, target), greatest(source, target)) AS s0, least(source, target) AS a, greatest(source, target) AS b FROM c_edges),
c_live AS (SELECT * FROM c_first x WHERE source = s0 OR NOT EXISTS (SELECT 1 FROM c_first y WHERE y.a = x.a AND y.b = x.b AND y.source = y.s0 AND y.relation = x.relation))"""


@query("SELECT s0 AS source, CASE WHEN s0 = a THEN b ELSE a END AS target, last(relation ORDER BY source, target, relation) AS relation, last(confidence ORDER BY source, target, relation) AS confidence, last(weight ORDER BY source, target, relation) AS weight, count(*) AS merged FROM c_live GROUP BY a, b, s0", extra=COLLAPSE)
def undirected_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star_graph(spark, sf_dir).edges.select("source", "target", "relation", "confidence", "weight", "source_file")
    back = lambda df, r, w: df.select(F.col("target").alias("source"), F.col("source").alias("target"), r.alias("relation"), "confidence", w.alias("weight"), "source_file")
    rows = e.where("relation = 'references'").unionAll(back(e.where("source_file = 'customer.parquet'"), F.col("relation"), F.col("weight")))
    rows = rows.unionAll(back(e.where("source_file = 'supplier.parquet' AND relation = 'references'"), F.lit("imports"), F.col("weight") + 1))
    return merge.undirected_collapse(rows)


def _slices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("source"), F.concat(F.lit("customer:"), "o_custkey").alias("target"), F.lower("o_orderstatus").alias("relation"), F.concat(F.lit("week"), (F.col("o_orderkey") % 20).cast("string")).alias("source_file"))
    return o.where("source_file != 'week3'"), o.where("source_file != 'week5' AND source_file != 'week6'")


SLICES = """o_all AS (SELECT 'order:' || o_orderkey AS source, 'customer:' || o_custkey AS target, lower(o_orderstatus) AS relation, 'week' || (o_orderkey % 20) AS source_file FROM orders),
o_old AS (SELECT * FROM o_all WHERE source_file <> 'week3'), o_new AS (SELECT * FROM o_all WHERE source_file NOT IN ('week5', 'week6'))"""


@query(f"WITH {SLICES} SELECT 'added' AS change, source, target, relation FROM (SELECT source, target, relation FROM o_new EXCEPT SELECT source, target, relation FROM o_old) UNION ALL SELECT 'removed', * FROM (SELECT source, target, relation FROM o_old EXCEPT SELECT source, target, relation FROM o_new)", star=False)
def graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.graph_diff(*_slices(spark, sf_dir), ["source", "target", "relation"]).select("change", "source", "target", "relation")


@query(f"WITH {SLICES} SELECT source, target, relation, source_file FROM o_old WHERE source_file NOT IN (SELECT source_file FROM o_new) AND source_file <> 'week6' UNION ALL SELECT * FROM o_new WHERE source_file <> 'week7'", star=False)
def merge_replace_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _slices(spark, sf_dir)
    gone = spark.createDataFrame([("week6",), ("week7",)], "source_file string")
    return merge.replace_by_source(old, new.where("source_file != 'week7'"), gone).select("source", "target", "relation", "source_file")


@query(f"WITH {SLICES} SELECT DISTINCT source AS id FROM o_old WHERE source NOT IN (SELECT source FROM o_new) AND source_file <> 'week5'", star=False)
def shrink_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _slices(spark, sf_dir)
    named = lambda df: df.select(F.col("source").alias("id"), "source_file")
    return merge.lost_unexplained(named(old), named(new), spark.createDataFrame([("week5",)], "source_file string"))


@query(f"WITH {SLICES} SELECT 'week' AS part, (SELECT count(*) FROM (SELECT * FROM o_old EXCEPT SELECT * FROM o_new)) = 0 AS same", star=False)
def topology_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _slices(spark, sf_dir)
    ids = lambda df: df.select(F.col("source").alias("id"))
    a, b = merge.topology_hash(ids(old), old), merge.topology_hash(ids(new), new)
    return a.join(b.toDF("part", "n2", "hash2"), "part").agg(F.lit("week").alias("part"), F.bool_and(F.col("hash") == F.col("hash2")).alias("same"))


@query("SELECT 'star::' || id AS id, 'star' AS repo, id AS local_id FROM g_nodes WHERE source_file <> 'order.parquet'")
def prefix_and_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    nodes, _ = merge.prefixed(g.nodes, g.edges, "star")
    return nodes.where("source_file != 'order.parquet'").select("id", "repo", "local_id")


@query("SELECT CASE source WHEN 'supplier:2' THEN 'supplier:1' WHEN 'nation:2' THEN 'nation:1' ELSE source END AS source, CASE target WHEN 'supplier:2' THEN 'supplier:1' WHEN 'nation:2' THEN 'nation:1' ELSE target END AS target, relation FROM g_edges")
def remap_rewire(spark: SparkSession, sf_dir: str) -> DataFrame:
    remap = spark.createDataFrame([("supplier:2", "supplier:1"), ("nation:2", "nation:1")], "id string, winner string")
    return merge.rewire(star_graph(spark, sf_dir).edges, remap).select("source", "target", "relation")


SEARCH_SQL = """terms AS (SELECT * FROM (VALUES ('{a}'), ('{b}')) t(t)), s_nodes AS (SELECT id, lower(label) AS l, label, lower(source_file) AS f FROM g_nodes),
idf AS (SELECT t, ln(1 + (SELECT count(*) FROM s_nodes)::DOUBLE / (1 + (SELECT count(*) FROM s_nodes WHERE contains(l, t)))) AS w FROM terms),
s_score AS (SELECT id, label, (SELECT sum(CASE WHEN l = t THEN 1000 * w WHEN starts_with(l, t) THEN 100 * w WHEN contains(l, t) THEN w ELSE 0 END + CASE WHEN contains(f, t) THEN 0.5 * w ELSE 0 END) FROM idf)
 + CASE WHEN l = '{a} {b}' OR lower(id) = '{a} {b}' THEN 10000 ELSE CASE WHEN starts_with(l, '{a} {b}') THEN 1000 ELSE 0 END END * (SELECT max(w) FROM idf) AS score FROM s_nodes)"""


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.score_nodes(star_graph(spark, sf_dir).nodes, "part green")


@query("SELECT id, label, round(score, 6)::DOUBLE AS score FROM s_score WHERE score > 0 ORDER BY score DESC, length(label), id LIMIT 20", extra=SEARCH_SQL.format(a="part", b="green"))
def idf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(_searched(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("SELECT id, round(score, 6)::DOUBLE AS score FROM (SELECT *, max(score) OVER () AS top FROM (SELECT * FROM s_score WHERE score > 0 ORDER BY score DESC, length(label), id LIMIT 3)) WHERE score >= 0.2 * top", extra=SEARCH_SQL.format(a="part", b="green"))
def seed_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pick_seeds(_searched(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


@query("SELECT id, round(score, 6)::DOUBLE AS score, round(nxt, 6)::DOUBLE AS runner_up, coalesce((score - nxt) / score < 0.1, false) AS ambiguous FROM (SELECT id, score, lead(score) OVER w AS nxt, row_number() OVER w AS k FROM s_score WHERE score > 0 WINDOW w AS (ORDER BY score DESC, length(label), id)) WHERE k = 1", extra=SEARCH_SQL.format(a="part", b="green"))
def match_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ambiguity(_searched(spark, sf_dir)).withColumns({"score": F.round("score", 6), "runner_up": F.round("runner_up", 6)})


@query("SELECT id, label, CASE WHEN lower(label) = 'asia' THEN 1 WHEN starts_with(lower(label), 'asia') THEN 2 ELSE 3 END AS tier FROM g_nodes WHERE contains(lower(label), 'asia')")
def find_node_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_node(star_graph(spark, sf_dir).nodes, "ASIA")


@query("SELECT id, CASE WHEN lower(label) = 'asia' THEN 1 ELSE 4 END AS tier FROM g_nodes WHERE lower(label) = 'asia'")
def resolve_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.resolve_seed(star_graph(spark, sf_dir).nodes, "Asia")


@query("SELECT id, lower(regexp_replace(label, '^[()]+|[()]+$', '', 'g')) AS name FROM g_nodes WHERE trim(label) <> ''")
def resolvable_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = star_graph(spark, sf_dir).nodes
    return nodes.where(P.is_resolvable(F.col("file_type"), F.col("label"))).select("id", P.callable_name(F.col("label")).alias("name"))


@query("SELECT id FROM g_nodes WHERE contains(lower(label), 'hot')")
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = star_graph(spark, sf_dir).nodes
    hits = search.trigram_candidates(search.trigram_index(nodes), "hot").join(nodes.select("id", "label"), "id")
    return hits.where(F.contains(F.lower("label"), F.lit("hot"))).select("id")


@query("SELECT id, cum_chars FROM (SELECT id, sum(length(label) + 1) OVER (ORDER BY id)::BIGINT AS cum_chars FROM g_nodes) WHERE cum_chars <= 6000")
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.within_budget(star_graph(spark, sf_dir).nodes, "label", ["id"], 2000).select("id", "cum_chars")


@query("SELECT source, target, relation, context FROM g_edges WHERE context IN ('call', 'field')")
def context_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).edges.where(F.col("context").isin("call", "field")).select("source", "target", "relation", "context")


@query("SELECT 'out' AS direction, target AS neighbor, relation, confidence FROM g_edges WHERE source = 'nation:3' UNION ALL SELECT 'in', source, relation, confidence FROM g_edges WHERE target = 'nation:3'")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.neighbours(star_graph(spark, sf_dir), "nation:3")


@query("SELECT direction, neighbor, relation, degree FROM (SELECT 'out' AS direction, target AS neighbor, relation FROM g_edges WHERE source = 'nation:3' UNION ALL SELECT 'in', source, relation FROM g_edges WHERE target = 'nation:3') JOIN g_deg ON id = neighbor ORDER BY degree DESC, neighbor, relation, direction LIMIT 20", extra=DEGREES)
def explain_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.explain(star_graph(spark, sf_dir), "nation:3")


@query("SELECT (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(DISTINCT community) FROM g_nodes) AS communities, round_even(100.0 * count(*) FILTER (confidence = 'EXTRACTED') / count(*), 0)::BIGINT AS extracted_pct, round_even(100.0 * count(*) FILTER (confidence = 'INFERRED') / count(*), 0)::BIGINT AS inferred_pct, round_even(100.0 * count(*) FILTER (confidence = 'AMBIGUOUS') / count(*), 0)::BIGINT AS ambiguous_pct, count(*) AS edges FROM g_edges")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.graph_stats(star_graph(spark, sf_dir))


def _seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query("SELECT id, min(depth)::INT AS depth FROM (SELECT 'region:1' AS id, 0 AS depth UNION ALL SELECT e.source, 1 FROM g_edges e WHERE e.target = 'region:1' UNION ALL SELECT f.source, 2 FROM g_edges e JOIN g_edges f ON f.target = e.source WHERE e.target = 'region:1') GROUP BY id", extra=DEGREES)
def bfs_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    return traverse.bfs(spark, PropertyGraph(g.nodes, g.edges.select(F.col("target").alias("source"), F.col("source").alias("target")), True), _seeds(spark, "region:1"), 2, guard=False)


@query("SELECT id, min(depth)::INT AS depth, arg_min(via, depth * 100 + ascii(via)) AS via_relation FROM (SELECT e.source AS id, 1 AS depth, relation AS via FROM g_edges e WHERE target = 'nation:1' AND relation IN ('calls', 'references', 'uses') UNION ALL SELECT f.source, 2, f.relation FROM g_edges e JOIN g_edges f ON f.target = e.source AND f.relation IN ('calls', 'references', 'uses') WHERE e.target = 'nation:1' AND e.relation IN ('calls', 'references', 'uses')) GROUP BY id")
def impact_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.affected(spark, star_graph(spark, sf_dir), _seeds(spark, "nation:1"))


@query("SELECT 1::INT AS hop, 'customer:1' AS src, (SELECT target FROM g_edges WHERE source = 'customer:1' AND relation = 'references') AS dst")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    target = g.edges.where("source = 'customer:1' AND relation = 'references'").first().target
    return traverse.shortest_path(spark, g, "customer:1", target)


@query("SELECT n.id, n.label, n.source_file FROM g_nodes n WHERE n.id NOT IN (SELECT id FROM reach)", extra="reach AS (SELECT id FROM g_nodes WHERE source_file = 'order.parquet' AND community < 5 UNION SELECT e.target FROM reach JOIN g_edges e ON e.source = reach.id AND e.relation IN ('calls', 'references'))")
def dead_code_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    return traverse.dead_code(spark, g, g.nodes.where("source_file = 'order.parquet' AND community < 5"), ("calls", "references"))


@query("SELECT node, min(component) AS component FROM (SELECT a.id AS node, b.id AS component FROM (SELECT id, grp FROM member) a JOIN (SELECT grp, min(id) AS id FROM member GROUP BY grp) b USING (grp)) GROUP BY node", extra="member AS (SELECT source AS id, target AS grp FROM g_edges WHERE source_file = 'nation.parquet' UNION SELECT target, target FROM g_edges WHERE source_file = 'nation.parquet' UNION SELECT s.source, n.target FROM g_edges s JOIN g_edges n ON n.source = s.target AND n.source_file = 'nation.parquet' WHERE s.relation = 'references')")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = star_graph(spark, sf_dir).edges.where("source_file = 'nation.parquet' OR relation = 'references'")
    return connected_components(spark, e, "source", "target")


@query("SELECT source, target, relation, confidence, (base + apart + edge)::BIGINT AS score FROM (SELECT source, target, relation, confidence, CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN a.source_file <> b.source_file THEN 2 ELSE 0 END AS base, CASE WHEN a.community <> b.community THEN 1 ELSE 0 END AS apart, CASE WHEN least(da.degree, db.degree) <= 2 AND greatest(da.degree, db.degree) >= 5 THEN 1 ELSE 0 END AS edge FROM g_edges e JOIN g_nodes a ON a.id = e.source JOIN g_nodes b ON b.id = e.target JOIN g_deg da ON da.id = e.source JOIN g_deg db ON db.id = e.target WHERE relation NOT IN ('contains', 'imports') AND a.source_file <> b.source_file)", extra=DEGREES)
def surprise_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.surprise_scores(star_graph(spark, sf_dir)).drop("why")


@query()
def suggest_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.questions(star_graph(spark, sf_dir))


@query("SELECT low, high, source, target, relation, confidence FROM (SELECT least(s_c, t_c) AS low, greatest(s_c, t_c) AS high, source, target, relation, confidence, CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END AS r, row_number() OVER (PARTITION BY least(s_c, t_c), greatest(s_c, t_c) ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, source, target) AS k FROM g_loc WHERE relation NOT IN ('contains') AND s_c <> t_c) WHERE k = 1 ORDER BY r, low, high LIMIT 5", extra=LOCATED)
def community_surprises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.community_surprises(star_graph(spark, sf_dir))


@query("SELECT e.source, e.target, relation, CASE WHEN a.community < 0 OR b.community < 0 THEN 'orphan' WHEN a.community = b.community THEN 'intra' ELSE 'inter' END AS kind FROM g_edges e JOIN g_nodes a ON a.id = e.source JOIN g_nodes b ON b.id = e.target")
def section_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    rows = analysis.section_edges(g, g.nodes.where("community >= 0").select("id", F.col("community").alias("section")))
    return rows.select("source", "target", "relation", "kind")


@query("SELECT id, phase FROM (SELECT id, 0 AS phase FROM d_first UNION ALL SELECT DISTINCT id, 1 FROM (SELECT unnest([source, target]) AS id FROM (SELECT source, target FROM g_edges WHERE confidence = 'EXTRACTED' ORDER BY weight DESC, source, target LIMIT 20)) WHERE id NOT IN (SELECT id FROM d_first)) ORDER BY phase, id LIMIT 20", extra="d_first AS (SELECT n.id FROM g_nodes n LEFT JOIN (SELECT id, sum(d) AS d FROM (SELECT source AS id, 1 AS d FROM g_edges UNION ALL SELECT target, -1 FROM g_edges) GROUP BY id) e USING (id) ORDER BY coalesce(d, 0) DESC, n.id LIMIT 5)")
def diagram_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.diagram_nodes(star_graph(spark, sf_dir))


@query("SELECT 'pr' || (l_orderkey % 10) AS pr, count(DISTINCT p_size % 25) AS communities_touched, count(DISTINCT p_partkey) AS nodes_affected FROM (SELECT DISTINCT l_orderkey % 10 AS l_orderkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1", star=False)
def pr_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed paths end in a part's path; the match is by suffix on whole parts."""
    files = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("repo/src/p"), "l_partkey", F.lit(".py")).alias("path"), F.concat(F.lit("pr"), (F.col("l_orderkey") % 10).cast("string")).alias("pr")).distinct()
    nodes = read(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), (F.col("p_size") % 25).alias("community"), F.concat(F.lit("src/p"), "p_partkey", F.lit(".py")).alias("source_file"))
    return resolve.impact_of(files, nodes, "pr")


@query("SELECT count(*) AS n, count(DISTINCT kind) AS kinds FROM (SELECT 'node' AS kind FROM g_nodes UNION ALL SELECT 'link' FROM g_edges)")
def node_link_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.node_link_rows(star_graph(spark, sf_dir)).where("json IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("kinds"))


@query("SELECT 'MERGE (n:Code {id: ''' || id || '''}) SET n.label = ''' || replace(replace(label, chr(92), chr(92) || chr(92)), '''', chr(92) || '''') || ''';' AS line FROM g_nodes UNION ALL SELECT 'MATCH (a {id: ''' || source || '''}), (b {id: ''' || target || '''}) MERGE (a)-[:' || upper(relation) || ' {confidence: ''' || confidence || '''}]->(b);' FROM g_edges")
def cypher_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.cypher(star_graph(spark, sf_dir))


@query("SELECT '<node id=\"' || id || '\"><data key=\"label\">' || replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</data></node>' AS line FROM g_nodes UNION ALL SELECT '<edge source=\"' || source || '\" target=\"' || target || '\"><data key=\"relation\">' || relation || '</data></edge>' FROM g_edges")
def graphml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.graphml(star_graph(spark, sf_dir))


@query()
def wiki_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.articles(star_graph(spark, sf_dir))


@query()
def graph_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report(star_graph(spark, sf_dir))
