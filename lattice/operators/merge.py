"""Building one graph from raw rows: canonical nodes, endpoint repair, first and last wins, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.functions import predicates as P

# Synonyms of file types.
FILE_TYPE_SYNONYMS = {"markdown": "document", "text": "document", "doc": "document", "tool": "code", "function": "code", "class": "code", "module": "code", "pdf": "paper", "figure": "image", "diagram": "image", "idea": "concept"}
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")


def canonical_nodes(nodes: DataFrame, root: str = "") -> DataFrame:
    """Known file types (synonyms folded, else concept), slashed relative paths, empty strings as null."""
    kind = F.lower(F.trim("file_type"))
    table = F.create_map(*(F.lit(x) for pair in FILE_TYPE_SYNONYMS.items() for x in pair))
    known = F.when(kind.isin(*FILE_TYPES), kind).otherwise(F.coalesce(F.try_element_at(table, kind), F.lit("concept")))
    return nodes.withColumns({"file_type": known, "source_file": P.normalise_path(F.nullif(F.trim("source_file"), F.lit("")), root)})


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, key, problem): validation reports, it never drops."""
    def bad(df: DataFrame, kind: str, key: Column, column: str, test: Column, text: str) -> DataFrame:
        return df.where(test).select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.lit(f"{column}: {text}").alias("problem"))

    key = F.concat_ws("->", "source", "target")
    out = bad(nodes, "node", F.col("id"), "id", F.col("id").isNull(), "missing")
    out = out.unionAll(bad(nodes, "node", F.col("id"), "label", F.col("label").isNull(), "missing"))
    out = out.unionAll(bad(nodes, "node", F.col("id"), "file_type", ~F.coalesce(F.col("file_type").isin(*FILE_TYPES), F.lit(False)), "unknown"))
    for column in ("source", "target", "relation"):
        out = out.unionAll(bad(edges, "edge", key, column, F.col(column).isNull(), "missing"))
    sure = F.coalesce(F.col("confidence").isin("EXTRACTED", "INFERRED", "AMBIGUOUS"), F.lit(False))
    return out.unionAll(bad(edges, "edge", key, "confidence", ~sure, "unknown"))


def first_wins(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first whole row per key; pre-aggregated, so a hot key costs one row a task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def last_wins(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The last whole row per key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def last_attributes(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Per key and attribute the last value that is not null: composing attribute maps."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest))


def undirected_collapse(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair, in (source, target, relation) order.

    The first row gives the direction; a reversed row with the same relation is ignored, any other overwrites.
    """
    low, high = F.least("source", "target"), F.greatest("source", "target")
    rows = edges.select("source", "target", "relation", "confidence", "weight", low.alias("a"), high.alias("b"))
    order = F.struct("source", "target", "relation")
    # rows that come with the pair's first direction always apply; reversed ones only with a relation that it lacks
    first = rows.groupBy("a", "b").agg(F.min("source").alias("source_0"))
    ahead = rows.join(first, ["a", "b"]).withColumn("forward", F.col("source") == F.col("source_0"))
    best = ahead.where("forward").groupBy("a", "b").agg(F.collect_set("relation").alias("seen"))
    live = ahead.join(best, ["a", "b"]).where("forward OR NOT array_contains(seen, relation)")
    last = live.groupBy("a", "b", "source_0").agg(F.max_by(F.struct("relation", "confidence", "weight"), order).alias("l"), F.count(F.lit(1)).alias("merged"))
    target = F.when(F.col("source_0") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    return last.select(F.col("source_0").alias("source"), target.alias("target"), "l.relation", "l.confidence", "l.weight", "merged")


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes: two left-semi joins."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    lost = edges.join(ids, edges.source == ids.id, "left_anti")
    kept = edges.join(ids, edges.source == ids.id, "left_semi")
    return lost.unionAll(kept.join(ids, kept.target == ids.id, "left_anti"))


def repair_endpoints(edges: DataFrame, nodes: DataFrame, normal) -> DataFrame:
    """Ends that are no id are looked up by normal form: an exact id wins, a form shared by two ids repairs nothing."""
    alias = nodes.select(normal(F.col("id")).alias("form"), "id").groupBy("form").agg(F.min("id").alias("fixed"), F.count_distinct("id").alias("n")).where("n = 1").drop("n")
    ids = nodes.select("id").distinct()
    for end in ("source", "target"):
        exact = ids.select(F.col("id").alias(end), F.lit(True).alias("_exact"))
        edges = edges.join(exact, end, "left").withColumn("_form", normal(F.col(end)))
        edges = edges.join(alias.withColumnsRenamed({"form": "_form", "fixed": "_fixed"}), "_form", "left")
        edges = edges.withColumn(end, F.when(F.col("_exact"), F.col(end)).otherwise(F.coalesce("_fixed", end))).drop("_exact", "_form", "_fixed")
    return edges


def backfill_source_file(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """An edge without a source file takes its source node's, else its target's."""
    files = nodes.select("id", F.col("source_file").alias("f"))
    out = edges.join(files.toDF("source", "_s"), "source", "left").join(files.toDF("target", "_t"), "target", "left")
    return out.withColumn("source_file", F.coalesce(F.nullif("source_file", F.lit("")), "_s", "_t")).drop("_s", "_t").select(*edges.columns)


def rewire(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Ends mapped by (id, winner); edges that become self loops are dropped, original self loops too."""
    for end in ("source", "target"):
        edges = edges.join(remap.select(F.col("id").alias(end), F.col("winner").alias("_w")), end, "left").withColumn(end, F.coalesce("_w", end)).drop("_w")
    return edges.where("source != target")


def merge_ghosts(nodes: DataFrame) -> DataFrame:
    """(id, winner): nodes not from a parser join the one parsed node with their file name and label, if it is one.

    ``parsed`` marks nodes from a parser.
    """
    key = nodes.withColumn("base", P.basename(F.col("source_file")))
    real = key.where("parsed").groupBy("base", "label").agg(F.min("id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return key.where("NOT parsed").join(real, ["base", "label"]).select("id", "winner")


def prefixed(nodes: DataFrame, edges: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """A graph's rows for a shared store: ids as tag::id."""
    named = lambda c: F.concat(F.lit(f"{tag}::"), F.col(c))
    return nodes.withColumns({"local_id": F.col("id"), "repo": F.lit(tag), "id": named("id")}), edges.withColumns({"source": named("source"), "target": named("target"), "repo": F.lit(tag)})


def graph_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(change, keys): anti joins both ways on distinct keys."""
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    added = b.join(a, keys, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")))


def replace_by_source(old: DataFrame, new: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Incremental merge: every source file in ``new`` replaces its old rows; deleted files go."""
    kept = old.join(new.select("source_file").distinct(), "source_file", "left_anti")
    if deleted is not None:
        kept = kept.join(deleted.select("source_file").distinct(), "source_file", "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def lost_unexplained(old: DataFrame, new: DataFrame, gone_files: DataFrame) -> DataFrame:
    """Shrink guard: ids that are no longer there though their file neither went nor was read anew."""
    return old.join(new.select("id"), "id", "left_anti").join(gone_files, "source_file", "left_anti").select("id")


def topology_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An order-free fingerprint: equal graphs give equal rows whatever their partitioning."""
    digest = lambda df, *c: df.distinct().agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*c).cast("decimal(38,0)")).cast("string").alias("hash"))
    a = digest(nodes.select("id"), "id").select(F.lit("nodes").alias("part"), "n", "hash")
    b = digest(edges.select("source", "target", "relation"), "source", "target", "relation").select(F.lit("edges").alias("part"), "n", "hash")
    return a.unionAll(b)


def attach_hyperedges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append by id: ids that are already there stay as they are."""
    return first_wins(old.withColumn("ord", F.lit(0)).unionByName(new.withColumn("ord", F.lit(1))), ["id"]).drop("ord")


def surviving_hyperedges(hyperedges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members that are nodes; a hyperedge with fewer than two of them goes."""
    members = hyperedges.select("id", F.posexplode("nodes").alias("pos", "node")).join(nodes.select(F.col("id").alias("node")), "node", "left_semi")
    whole = members.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda m: m.node).alias("nodes")).where("size(nodes) >= 2")
    return hyperedges.drop("nodes").join(whole, "id")


def latest_per(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row per key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")
