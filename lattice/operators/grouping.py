"""Grouping modules into categories and features: folders, tiers, domains, ubiquity, cross links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.functions import predicates as P

# Fixed word lists of the tiers and of the domain dictionaries.
COMMON_DIRS = ("common", "shared", "utils", "util", "lib", "libs", "helpers", "core", "config", "types", "constants")
LAYER_DIRS = ("controllers", "services", "models", "views", "routes", "middleware", "handlers", "repositories")
COMMON_NAMES = r"(?i)^(utils?|helpers?|constants?|types?|config|logger|errors?|index)$"
VERBS = ("create", "get", "list", "update", "delete", "remove", "add", "find", "send", "process", "handle", "validate")
DOMAINS = {
    "commerce": {"cart": "cart", "order": "order", "checkout": "checkout", "product": "product", "price": "price", "customer": "customer", "payment": "payment"},
    "content": {"article": "article", "author": "author", "comment": "comment", "page": "page", "media": "media"},
    "identity": {"login": "login", "user": "user", "role": "role", "session": "session", "token": "token"},
}


def name_tokens(name: Column) -> Column:
    """Lower-case parts of camelCase, snake_case and kebab-case."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " +"), lambda t: t != "")


def common_dir(files: DataFrame) -> str:
    """The directory that all paths share: the shared prefix of the smallest and the largest path."""
    low, high = files.agg(F.min("path"), F.max("path")).first()
    if low is None:
        return ""
    parts = []
    for a, b in zip(low.split("/")[:-1], high.split("/")[:-1], strict=False):
        if a != b:
            break
        parts.append(a)
    return "/".join(parts)


def folder_partition(files: DataFrame) -> DataFrame:
    """path, category, feature: first and second directory under the shared one; root files by their name."""
    root = common_dir(files)
    inside = F.substring(F.col("path"), F.lit(len(root) + 2 if root else 1), F.length("path"))
    parts = F.split(inside, "/")
    stem = F.regexp_replace(P.basename(F.col("path")), r"\.[^.]*$", "")
    category = F.when(F.size(parts) > 1, parts[0]).otherwise(stem)
    feature = F.when(F.size(parts) > 2, parts[1]).otherwise(stem)
    return files.select("path", category.alias("category"), feature.alias("feature"))


def tier_of(path: Column, is_barrel: Column) -> Column:
    """structural, then common by name, then layer by directory, then barrel, else business."""
    parts = F.split(F.lower(path), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    stem = F.regexp_replace(P.basename(path), r"\.[^.]*$", "")
    has = lambda words: F.arrays_overlap(folders, F.array(*(F.lit(w) for w in words)))
    return F.when(has(COMMON_DIRS), "common").when(F.regexp_like(stem, F.lit(COMMON_NAMES)), "common").when(has(LAYER_DIRS), "layer").when(is_barrel, "barrel").otherwise("business")


def file_tiers(files: DataFrame, defs: DataFrame) -> DataFrame:
    """path, tier, n_defs: a barrel defines nothing itself. defs: path."""
    counts = defs.groupBy("path").agg(F.count(F.lit(1)).alias("n_defs"))
    rows = files.join(counts, "path", "left").fillna(0, ["n_defs"])
    return rows.select("path", tier_of(F.col("path"), F.col("n_defs") == 0).alias("tier"), "n_defs")


def detect_domain(names: DataFrame, least: int = 3, domains: dict = DOMAINS) -> DataFrame:
    """domain, hits: dictionaries of which at least ``least`` distinct features occur in the names."""
    spark = names.sparkSession
    table = spark.createDataFrame([(d, t, f) for d, words in domains.items() for t, f in words.items()], "domain string, token string, feature string")
    tokens = names.select(F.explode(name_tokens(F.col("name"))).alias("token")).distinct()
    hits = tokens.join(F.broadcast(table), "token").groupBy("domain").agg(F.count_distinct("feature").alias("hits"))  # a fixed dictionary
    return hits.where(F.col("hits") >= least)


def entry_points(functions: DataFrame) -> DataFrame:
    """Functions named verb + noun: id, verb, noun."""
    t = name_tokens(F.col("name"))
    rows = functions.select("id", t[0].alias("verb"), F.array_join(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), " ").alias("noun"))
    return rows.where(F.col("verb").isin(*VERBS) & (F.col("noun") != ""))


def ubiquitous(edges: DataFrame, features: DataFrame, floor: int = 5, share: float = 0.5) -> DataFrame:
    """Modules that max(floor, ceil(share * features)) distinct features use. features: module, feature."""
    total = features.select(F.count_distinct("feature").alias("total"))
    fan = edges.join(features.toDF("source", "f"), "source").join(features.toDF("target", "own"), "target").where("f != own").groupBy("target").agg(F.count_distinct("f").alias("fan_in"))
    return fan.crossJoin(total).where(F.col("fan_in") >= F.greatest(F.lit(floor), F.ceil(F.col("total") * share))).select(F.col("target").alias("module"), "fan_in")  # one row of totals


def cross_links(edges: DataFrame, tiers: DataFrame, features: DataFrame) -> DataFrame:
    """Common modules with the business features that use them."""
    common, business = tiers.where("tier = 'common'").select("path"), features.toDF("source", "feature")
    uses = edges.join(common.toDF("target"), "target", "left_semi").join(business, "source")
    return uses.groupBy(F.col("target").alias("module")).agg(F.sort_array(F.collect_set("feature")).alias("used_by"))
