"""Fragments from outside: sentence-like nodes, stale ids, cross-language guesses, rebuild survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.functions import predicates as P
from lattice.functions import text as T
from lattice.operators.merge import rewire, surviving_hyperedges

# Fixed thresholds: from how many characters or words on a label can be prose.
PROSE_CHARS, PROSE_WORDS = 80, 8


def is_prose(label: Column) -> Column:
    """Long or many-worded, and punctuated like a sentence."""
    text = F.trim(F.coalesce(label, F.lit("")))
    long = (F.length(text) >= PROSE_CHARS) | (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= PROSE_WORDS)
    return long & F.regexp_like(text, F.lit("[.!?:]"))


def clean_fragment(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Untrusted rows without rationale and concept nodes, or prose nodes that are a rationale for something.

    Their text becomes the ``rationale`` of the node that they point at by ``rationale_for``; their edges go; hyperedges
    keep members that stay, if two do.
    """
    known = nodes.where("coalesce(id, '') != ''")
    reasons = edges.where("relation = 'rationale_for'").select("source", "target").distinct()
    speaks = reasons.select(F.col("source").alias("id")).distinct().withColumn("_says", F.lit(True))
    marked = known.join(speaks, "id", "left")
    typed = F.coalesce(F.col("file_type").isin("rationale", "concept"), F.lit(False))
    marked = marked.withColumn("_prose", is_prose(F.col("label"))).withColumn("_out", typed | (F.coalesce("_says", F.lit(False)) & F.col("_prose")))
    kept, gone = marked.where("NOT _out"), marked.where("_out")
    told = gone.where("_prose").select(F.col("id").alias("source"), F.trim("label").alias("t")).join(reasons, "source")
    told = told.groupBy(F.col("target").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("source", "t")))["t"], "\n").alias("rationale"))
    kept = kept.select(*nodes.columns).join(told, "id", "left")
    ids = gone.select("id")
    wired = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select(*edges.columns)
    return kept, wired, surviving_hyperedges(hyperedges, kept) if hyperedges is not None else None


def stale_ids(nodes: DataFrame, root: str = "") -> DataFrame:
    """(id, winner): ids that start with a file's bare or one-parent stem get its full-path stem.

    The new id comes from ``source_file``; parsed nodes (``parsed``) are right already, and absolute paths stay.
    """
    path = P.normalise_path(F.col("source_file"), root)
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    parts = F.split(stem, "/")
    near = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.size(parts) - 1, F.lit(2)), "_"))
    rows = nodes.where("NOT parsed AND coalesce(source_file, '') != ''").where(~F.startswith(path, F.lit("/")))
    rows = rows.select("id", T.norm_id_udf("id").alias("i"), T.norm_id_udf(stem).alias("full"), T.norm_id_udf(F.coalesce(near, F.lit(""))).alias("near"), T.norm_id_udf(F.element_at(parts, -1)).alias("bare"))
    right = (F.col("i") == F.col("full")) | F.startswith("i", F.concat("full", F.lit("_")))

    def moved(old: str) -> Column:
        o = F.col(old)
        rest = F.substring(F.col("i"), F.length(o) + 1, F.length("i"))
        fits = (o != "") & (o != F.col("full")) & ((F.col("i") == o) | F.startswith("i", F.concat(o, F.lit("_"))))
        return F.when(fits, F.concat("full", rest))

    out = rows.where(~right).select("id", F.coalesce(moved("near"), moved("bare")).alias("winner"))
    return out.where("winner IS NOT NULL AND winner != id")


def rekey(nodes: DataFrame, edges: DataFrame, remap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes under their new ids and edges that follow."""
    moved = nodes.join(remap, "id", "left").withColumn("id", F.coalesce("winner", "id")).drop("winner").select(*nodes.columns)
    return moved, rewire(edges, remap).select(*edges.columns)


def drop_cross_language_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """INFERRED calls between language families go; where both files have a suffix, an unknown family counts as its own."""
    ends = nodes.select("id", P.suffix(F.col("source_file")).alias("x"), P.language_family(F.col("source_file")).alias("f"))
    rows = edges.join(ends.toDF("source", "x_s", "f_s"), "source", "left").join(ends.toDF("target", "x_t", "f_t"), "target", "left")
    guess = (F.col("relation") == "calls") & (F.col("confidence") == "INFERRED") & (F.coalesce("x_s", F.lit("")) != "") & (F.coalesce("x_t", F.lit("")) != "")
    return rows.where(~(guess & ~F.col("f_s").eqNullSafe(F.col("f_t")))).select(*edges.columns)


def rebuild(old_nodes: DataFrame, old_edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, read: DataFrame, deleted: DataFrame, full: bool) -> tuple[DataFrame, DataFrame]:
    """After reading files anew: their rows replace the old ones, deleted files' rows go, all others survive.

    A full rebuild also drops parsed nodes that it did not find again. An edge belongs to the file that it was read from.
    """
    gone = (read if not full else read.limit(0)).unionByName(deleted).select("source_file").distinct()
    kept = old_nodes.join(new_nodes.select("id"), "id", "left_anti").join(gone, "source_file", "left_anti")
    if full:
        kept = kept.where("NOT parsed")
    nodes = new_nodes.unionByName(kept.select(*new_nodes.columns))
    ids = nodes.select("id")
    owned = read.unionByName(deleted).select("source_file").distinct()
    edges = old_edges.join(owned, "source_file", "left_anti").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, new_edges.unionByName(edges.select(*new_edges.columns))
