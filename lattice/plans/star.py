"""The relational tables as a property graph: nodes and directed edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.model import PropertyGraph

lit = F.lit


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, kind: str, key: str, label, community) -> DataFrame:
    return df.select(F.concat(lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), label.alias("label"), lit("code").alias("file_type"), lit(f"{kind}.parquet").alias("source_file"), community.cast("int").alias("community"))


def _edges(df: DataFrame, source, target, relation: str, file: str, context: str, weight=None, confidence=None) -> DataFrame:
    return df.select(source.alias("source"), target.alias("target"), lit(relation).alias("relation"), (confidence if confidence is not None else lit("EXTRACTED")).alias("confidence"), (weight if weight is not None else lit(1)).cast("double").alias("weight"), lit(context).alias("context"), lit(file).alias("source_file"))


def _id(kind: str, key: str):
    return F.concat(lit(f"{kind}:"), F.col(key).cast("string"))


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts and orders, linked by their keys.

    A supplier uses a part as often as line items say: three times or more is EXTRACTED, twice INFERRED,
    once AMBIGUOUS.
    """
    t = {n: read(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    owners = t["customer"].select("c_custkey", "c_nationkey")
    orders = t["orders"].join(owners, t["orders"].o_custkey == owners.c_custkey, "left")
    nodes = (
        _nodes(t["region"], "region", "r_regionkey", F.col("r_name"), lit(-1)),
        _nodes(t["nation"], "nation", "n_nationkey", F.col("n_name"), F.col("n_nationkey")),
        _nodes(t["supplier"], "supplier", "s_suppkey", F.col("s_name"), F.col("s_nationkey")),
        _nodes(t["customer"], "customer", "c_custkey", F.col("c_name"), F.col("c_nationkey")),
        _nodes(t["part"], "part", "p_partkey", F.col("p_name"), F.col("p_size") % 25),
        _nodes(orders, "order", "o_orderkey", F.concat(lit("order "), F.col("o_orderkey").cast("string")), F.col("c_nationkey")),
    )
    supply = t["lineitem"].groupBy("l_suppkey", "l_partkey").agg(F.count(lit(1)).alias("n"))
    sure = F.when(F.col("n") >= 3, "EXTRACTED").when(F.col("n") == 2, "INFERRED").otherwise("AMBIGUOUS")
    parts = t["lineitem"].select("l_orderkey", "l_partkey").distinct()
    edges = (
        _edges(t["nation"], _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "contains", "nation.parquet", "field"),
        _edges(t["customer"], _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "references", "customer.parquet", "field"),
        _edges(t["supplier"], _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "references", "supplier.parquet", "field"),
        _edges(t["orders"], _id("order", "o_orderkey"), _id("customer", "o_custkey"), "calls", "order.parquet", "call"),
        _edges(supply, _id("supplier", "l_suppkey"), _id("part", "l_partkey"), "uses", "supplier.parquet", "parameter_type", F.col("n"), sure),
        _edges(parts, _id("order", "l_orderkey"), _id("part", "l_partkey"), "contains", "order.parquet", "import"),
    )
    return PropertyGraph(reduce(DataFrame.unionAll, nodes), reduce(DataFrame.unionAll, edges), directed=True)


#: The same graph for DuckDB, as common table expressions; tables g_nodes and g_edges.
STAR_SQL = """
g_nodes AS (
  SELECT 'region:'||r_regionkey AS id, r_name AS label, 'code' AS file_type, 'region.parquet' AS source_file, -1 AS community FROM region
  UNION ALL SELECT 'nation:'||n_nationkey, n_name, 'code', 'nation.parquet', n_nationkey FROM nation
  UNION ALL SELECT 'supplier:'||s_suppkey, s_name, 'code', 'supplier.parquet', s_nationkey FROM supplier
  UNION ALL SELECT 'customer:'||c_custkey, c_name, 'code', 'customer.parquet', c_nationkey FROM customer
  UNION ALL SELECT 'part:'||p_partkey, p_name, 'code', 'part.parquet', p_size % 25 FROM part
  UNION ALL SELECT 'order:'||o_orderkey, 'order '||o_orderkey, 'code', 'order.parquet', c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey
),
g_edges AS (
  SELECT 'nation:'||n_nationkey AS source, 'region:'||n_regionkey AS target, 'contains' AS relation, 'EXTRACTED' AS confidence, 1.0::DOUBLE AS weight, 'field' AS context, 'nation.parquet' AS source_file FROM nation
  UNION ALL SELECT 'customer:'||c_custkey, 'nation:'||c_nationkey, 'references', 'EXTRACTED', 1.0, 'field', 'customer.parquet' FROM customer
  UNION ALL SELECT 'supplier:'||s_suppkey, 'nation:'||s_nationkey, 'references', 'EXTRACTED', 1.0, 'field', 'supplier.parquet' FROM supplier
  UNION ALL SELECT 'order:'||o_orderkey, 'customer:'||o_custkey, 'calls', 'EXTRACTED', 1.0, 'call', 'order.parquet' FROM orders
  UNION ALL SELECT 'supplier:'||l_suppkey, 'part:'||l_partkey, 'uses', CASE WHEN count(*) >= 3 THEN 'EXTRACTED' WHEN count(*) = 2 THEN 'INFERRED' ELSE 'AMBIGUOUS' END, count(*)::DOUBLE, 'parameter_type', 'supplier.parquet' FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT DISTINCT 'order:'||l_orderkey, 'part:'||l_partkey, 'contains', 'EXTRACTED', 1.0::DOUBLE, 'import', 'order.parquet' FROM lineitem
)"""
