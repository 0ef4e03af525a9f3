"""Registered queries, third part: fragment cleanup, rebuilds, scopes and dispatch, the query surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.api import GraphQueries
from lattice.operators import cleanup, merge, resolve, traverse
from lattice.plans.star import STAR_SQL, read, star_graph
from lattice.sources import formats

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _fragment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as nodes, labelled by their whole text; each explains or cites the next one of its source."""
    docs = read(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("code", "document", "rationale", "concept", "paper"))), (F.col("doc_id") % 5 + 1).cast("int"))
    ident = lambda c: F.concat(F.lit("doc:"), c.cast("string"))
    nodes = docs.select(ident(F.col("doc_id")).alias("id"), F.col("text").alias("label"), kind.alias("file_type"))
    edges = docs.select(ident(F.col("doc_id")).alias("source"), ident(F.col("doc_id") + 1).alias("target"), F.when(F.col("doc_id") % 3 == 0, "rationale_for").otherwise("cites").alias("relation"))
    return nodes, edges


FRAGMENT_SQL = """f_nodes AS (SELECT 'doc:' || doc_id AS id, text AS label, ['code', 'document', 'rationale', 'concept', 'paper'][doc_id % 5 + 1] AS file_type FROM documents),
f_edges AS (SELECT 'doc:' || doc_id AS source, 'doc:' || (doc_id + 1) AS target, CASE WHEN doc_id % 3 = 0 THEN 'rationale_for' ELSE 'cites' END AS relation FROM documents),
f_prose AS (SELECT *, trim(label) AS t, (length(trim(label)) >= 80 OR len(list_filter(regexp_split_to_array(trim(label), '\\s+'), lambda w: w <> '')) >= 8) AND regexp_matches(trim(label), '[.!?:]') AS prose FROM f_nodes),
f_out AS (SELECT * FROM f_prose WHERE file_type IN ('rationale', 'concept') OR (prose AND id IN (SELECT source FROM f_edges WHERE relation = 'rationale_for')))"""


@query(f"WITH {FRAGMENT_SQL} SELECT id, file_type, (SELECT max(o.t) FROM f_out o JOIN f_edges e ON e.source = o.id AND e.relation = 'rationale_for' WHERE o.prose AND e.target = n.id) AS rationale FROM f_nodes n WHERE id NOT IN (SELECT id FROM f_out)")
def clean_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _fragment(spark, sf_dir)
    return cleanup.clean_fragment(nodes, edges)[0].select("id", "file_type", "rationale")


@query(f"WITH {FRAGMENT_SQL} SELECT source, target, relation FROM f_edges WHERE source NOT IN (SELECT id FROM f_out) AND target NOT IN (SELECT id FROM f_out)")
def clean_fragment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _fragment(spark, sf_dir)
    return cleanup.clean_fragment(nodes, edges)[1]


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'pkg_m' ELSE 'm' END || doc_id || '_run' AS id, 'src_pkg_m' || doc_id || '_run' AS winner FROM documents WHERE doc_id % 3 <> 2")
def stale_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the ids are right already; the rest start with the bare or the one-parent stem."""
    i = F.col("doc_id").cast("string")
    docs = read(spark, sf_dir, "documents")
    old = F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("src_pkg_m"), i)).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("pkg_m"), i)).otherwise(F.concat(F.lit("m"), i))
    nodes = docs.select(F.concat(old, F.lit("_run")).alias("id"), F.lit(False).alias("parsed"), F.concat(F.lit("src/pkg/m"), i, F.lit(".py")).alias("source_file"))
    return cleanup.stale_ids(nodes).select("id", "winner")


@query("SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE NOT (l_linenumber % 2 = 1 AND l_suppkey % 3 <> l_partkey % 3)")
def cross_language_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts live in Python, TypeScript or Go files; odd lines are guessed calls."""
    ends = F.element_at(F.array(F.lit(".py"), F.lit(".ts"), F.lit(".go")), (F.col("k") % 3 + 1).cast("int"))
    node = lambda t, k, p: read(spark, sf_dir, t).select(F.concat(F.lit(p), k).alias("id"), F.col(k).alias("k")).select("id", F.concat(F.lit("src/x"), ends).alias("source_file"))
    nodes = node("supplier", "s_suppkey", "s").unionAll(node("part", "p_partkey", "p"))
    line = read(spark, sf_dir, "lineitem")
    edges = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.lit("calls").alias("relation"), F.when(F.col("l_linenumber") % 2 == 1, "INFERRED").otherwise("EXTRACTED").alias("confidence"))
    return cleanup.drop_cross_language_calls(edges, nodes).select("id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 1 THEN 'new' ELSE 'old' END AS state FROM orders WHERE o_orderkey % 4 <> 2 AND NOT (o_orderkey % 4 = 1 AND o_orderkey % 3 = 0)")
def rebuild_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File 1 is read anew without every third node, file 2 is deleted, the others survive."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), (F.col("o_orderkey") % 4).cast("string")).alias("source_file"), F.lit(True).alias("parsed"), F.lit("old").alias("state"))
    new = rows.where("source_file = 'f1' AND id % 3 != 0").withColumn("state", F.lit("new"))
    edges = rows.select(F.col("id").alias("source"), F.col("id").alias("target"), "source_file").limit(0)
    name = lambda n: spark.createDataFrame([(n,)], "source_file string")
    return cleanup.rebuild(rows, edges, new, edges, name("f1"), name("f2"), full=False)[0].select("id", "state")


@query("SELECT 'part:' || p_partkey AS id, w AS winner FROM part JOIN (SELECT p_brand, min('part:' || p_partkey) AS w FROM part GROUP BY 1) USING (p_brand) WHERE 'part:' || p_partkey <> w")
def merge_externals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without a source file are one per label, here the brand."""
    nodes = read(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_brand").alias("label"), F.lit("").alias("source_file"))
    return resolve.merge_externals(nodes).select("id", "winner")


@query("SELECT 'g' || p_partkey AS id, 'r' || m AS winner FROM part JOIN (SELECT p_name, min(p_partkey) AS m, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) USING (p_name) WHERE p_partkey % 2 = 1 AND n = 1")
def ghost_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = F.col("p_partkey") % 2 == 0
    nodes = read(spark, sf_dir, "part").select(F.concat(F.when(real, "r").otherwise("g"), "p_partkey").alias("id"), F.col("p_name").alias("label"), real.alias("parsed"), F.lit("a/f.py").alias("source_file"))
    return merge.merge_ghosts(nodes)


@query("SELECT 'h' || o_custkey AS id, count(*) AS members FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY o_custkey HAVING count(*) >= 2")
def hyperedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as one hyperedge; odd orders are no nodes."""
    orders = read(spark, sf_dir, "orders")
    order = F.concat(F.lit("order:"), "o_orderkey")
    hyper = orders.groupBy(F.concat(F.lit("h"), "o_custkey").alias("id")).agg(F.collect_set(order).alias("nodes"))
    kept = merge.surviving_hyperedges(hyper, orders.where("o_orderkey % 2 = 0").select(order.alias("id")))
    return kept.select("id", F.size("nodes").cast("long").alias("members"))


@query("SELECT DISTINCT l_orderkey * 1000000 + l_partkey AS use_id, CASE WHEN l_partkey % 5 = 0 THEN 'inner' ELSE 'outer' END || (l_partkey % 5) AS value FROM lineitem")
def scope_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name is bound in the outer scope, name 0 in the inner one too."""
    scopes = spark.createDataFrame([("inner", "outer"), ("outer", None)], "scope string, parent string")
    bound = [("outer", f"n{i}", f"outer{i}") for i in range(5)] + [("inner", "n0", "inner0")]
    line = read(spark, sf_dir, "lineitem")
    uses = line.select((F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("use_id"), F.lit("inner").alias("scope"), F.concat(F.lit("n"), (F.col("l_partkey") % 5).cast("string")).alias("name")).distinct()
    return resolve.scope_lookup(scopes, spark.createDataFrame(bound, "scope string, name string, value string"), uses)


@query("SELECT p_partkey AS id, 'p' || least(99, p_partkey % 100 + 8) AS resolved FROM part")
def alias_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p0 is p1, p1 is p2 and so on to p99: eight hops at most."""
    aliases = spark.range(99).select(F.lit("f").alias("file"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("p"), (F.col("id") + 1).cast("string")).alias("target"))
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("f").alias("file"), F.concat(F.lit("p"), (F.col("p_partkey") % 100).cast("string")).alias("name"))
    return resolve.alias_targets(aliases, names).select("id", "resolved")


@query("SELECT l_orderkey * 10 + l_linenumber AS call_id, 'm' || l_suppkey AS target FROM lineitem WHERE l_suppkey % 2 = 0")
def member_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are classes; odd ones share one label, so calls on them stay open."""
    line = read(spark, sf_dir, "lineitem")
    label = lambda k: F.when(F.col(k) % 2 == 0, F.concat(F.lit("C"), k)).otherwise("Same")
    calls = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), label("l_suppkey").alias("receiver_type"), F.lit("run").alias("callee"))
    supplier = read(spark, sf_dir, "supplier")
    classes = supplier.select(F.concat(F.lit("c"), "s_suppkey").alias("id"), label("s_suppkey").alias("label"))
    methods = supplier.select(F.concat(F.lit("m"), "s_suppkey").alias("id"), F.concat(F.lit("c"), "s_suppkey").alias("class_id"), F.lit("run").alias("name"))
    return resolve.member_calls(calls, classes, methods)


@query("SELECT 'x' || c_custkey AS caller, 'fn' || c_nationkey AS target FROM customer WHERE c_nationkey % 5 <> 0")
def sourced_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's script sources its nation's library; every fifth library lacks the function."""
    cust, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    file = F.concat(F.lit("x"), "c_custkey")
    sources = cust.select(file.alias("file"), F.concat(F.lit("lib"), "c_nationkey").alias("sourced"))
    functions = nation.where("n_nationkey % 5 != 0").select(F.concat(F.lit("lib"), "n_nationkey").alias("file"), F.lit("go").alias("name"), F.concat(F.lit("fn"), "n_nationkey").alias("id"))
    return resolve.sourced_calls(sources, functions, cust.select(file.alias("caller"), F.lit("go").alias("callee"), file.alias("file")))


@query(f"WITH {STAR_SQL}, entry AS (SELECT * FROM (VALUES ('nation:1'), ('nation:2')) t(e)), near AS (SELECT e, e AS id FROM entry UNION SELECT e, source FROM entry JOIN g_edges ON target = e) SELECT id, CASE WHEN count(DISTINCT e) = 1 THEN min(e) END AS owner, CASE WHEN count(DISTINCT e) = 1 THEN 'helper' ELSE 'connector' END AS kind FROM near GROUP BY id")
def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    edges = g.edges.where("relation = 'references'").select(F.col("target").alias("source"), F.col("source").alias("target"))
    return traverse.operations(spark, edges, spark.createDataFrame([("nation:1",), ("nation:2",)], "id string"))


@query()
def python_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small generated sources through the extractor registry."""
    body = F.concat(F.lit("import os\nclass N"), F.col("n_nationkey").cast("string"), F.lit(":\n    def run(self):\n        go()\n"))
    return formats.extract(read(spark, sf_dir, "nation").select(F.concat(F.lit("m"), "n_nationkey", F.lit(".py")).alias("path"), body.alias("text")))


@query()
def query_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GraphQueries(spark, star_graph(spark, sf_dir)).query_graph("asia", depth=1)


@query()
def query_graph_dfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GraphQueries(spark, star_graph(spark, sf_dir)).query_graph("asia", mode="dfs", depth=2, context_filter=["field"])
