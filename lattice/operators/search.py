"""Ranked text search over node labels, seeds, and budgeted rendering."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.functions.text import strip_marks

EXACT, PREFIX, SUBSTRING, SOURCE = 1000.0, 100.0, 1.0, 0.5


def norm_label(label: Column) -> Column:
    return F.lower(F.coalesce(label, F.lit("")))


def bare(label: Column) -> Column:
    return F.regexp_replace(label, r"[()]+$", "")


def label_tokens(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def tokens(question: str) -> list[str]:
    import re

    return [t for t in re.findall(r"\w+", question.lower()) if len(t) > 1]


def segments(term: str) -> list[str]:
    """Chinese terms as overlapping pairs of characters, with the whole term last; other terms as they are."""
    if not any("\u4e00" <= c <= "\u9fff" for c in term):
        return [term]
    pairs = [term[i : i + 2] for i in range(len(term) - 1)]
    return list(dict.fromkeys([*pairs, term]))


def search_terms(question: str) -> list[str]:
    """Words without marks, lower-cased and segmented; ASCII words of two letters or fewer do not count."""
    import re

    words = re.findall(r"\w+", strip_marks(question).lower())
    terms = [t for w in words for t in segments(w)]
    return [t for t in dict.fromkeys(terms) if len(t) > 2 or not (t.isascii() and t.isalpha())]


def idf(nodes: DataFrame, terms: list[str]) -> dict[str, float]:
    """ln(1 + N / (1 + df)) of each query term; one conditional aggregation, one row to the driver."""
    label = norm_label(F.col("label"))
    row = nodes.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.contains(label, F.lit(t))).alias(f"t{i}") for i, t in enumerate(terms))).first()
    return {t: math.log(1 + max(row["n"], 1) / (1 + row[f"t{i}"])) for i, t in enumerate(terms)}


def score_nodes(nodes: DataFrame, question: str) -> DataFrame:
    """id, label, score > 0: full-query, exact, prefix, substring and source tiers, weighted by idf."""
    terms = tokens(question)
    weights = idf(nodes, terms) if terms else {}
    label, joined = norm_label(F.col("label")), " ".join(terms)
    plain, words, ident = bare(label), label_tokens(F.col("label")), F.lower("id")
    source = F.lower(F.coalesce("source_file", F.lit("")))
    parts = [F.lit(0.0)]
    if joined:
        top = max(weights.values())
        whole = (label == joined) | (plain == joined) | (words == joined) | (ident == joined)
        leads = F.startswith(label, F.lit(joined)) | F.startswith(plain, F.lit(joined)) | F.startswith(words, F.lit(joined))
        parts.append(F.when(whole, EXACT * 10 * top).when(leads, PREFIX * 10 * top).otherwise(0.0))
    for t in terms:
        w, at = weights[t], F.lit(t)
        parts.append(F.when((label == t) | (plain == t), EXACT * w).when(F.startswith(label, at) | F.startswith(plain, at), PREFIX * w).when(F.contains(label, at), SUBSTRING * w).otherwise(0.0))
        parts.append(F.when(F.contains(source, at), SOURCE * w).otherwise(0.0))
    return nodes.select("id", "label", reduce(Column.__add__, parts).alias("score")).where("score > 0")


def ranked(scored: DataFrame, limit: int = 20) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.length(F.coalesce("label", "id")), "id").limit(limit)


def pick_seeds(scored: DataFrame, max_k: int = 3, gap: float = 0.2) -> DataFrame:
    """At most ``max_k`` best nodes, cut where the score falls under ``gap`` of the best."""
    best = ranked(scored, max_k)
    return best.withColumn("top", F.max("score").over(Window.partitionBy(F.lit(0)))).where(F.col("score") >= F.col("top") * gap).drop("top")


def find_node(nodes: DataFrame, text: str) -> DataFrame:
    """id and tier: 0 source path, 1 exact, 2 prefix, 3 substring."""
    term = " ".join(tokens(text))
    label, words, ident = norm_label(F.col("label")), label_tokens(F.col("label")), F.lower("id")
    plain, at = bare(label), F.lit(term)
    tier = F.when(label_tokens(F.col("source_file")) == term, 0).when((label == term) | (plain == term) | (words == term) | (ident == term), 1)
    tier = tier.when(F.startswith(label, at) | F.startswith(plain, at) | F.startswith(words, at) | F.startswith(ident, at), 2)
    tier = tier.when(F.contains(label, at) | F.contains(words, at), 3)
    return nodes.select("id", "label", tier.alias("tier")).where("tier IS NOT NULL")


def resolve_seed(nodes: DataFrame, query: str) -> DataFrame:
    """The node meant by an impact query: the first of five tiers with exactly one match."""
    q = query.rstrip("/\\").lower()
    label, source = norm_label(F.col("label")), F.lower(F.coalesce("source_file", F.lit("")))
    tests = (F.col("id") == query.rstrip("/\\"), label == q, bare(label) == bare(F.lit(q)), source == q, F.contains(label, F.lit(q)))
    tiers = F.filter(F.array(*(F.when(t, F.lit(i)) for i, t in enumerate(tests))), lambda x: x.isNotNull())
    hits = nodes.select("id", F.explode(tiers).alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return hits.where("n = 1").orderBy("tier").limit(1).select("id", "tier")


def trigram_index(nodes: DataFrame) -> DataFrame:
    """(gram, id): an inverted table for label search; a label under three characters is its own gram."""
    label = norm_label(F.col("label"))
    grams = F.when(F.length(label) < 3, F.array(label)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(label) - 2, F.lit(1))), lambda i: F.substring(label, i, F.lit(3))))
    return nodes.select(F.explode(F.array_distinct(grams)).alias("gram"), "id")


def trigram_candidates(index: DataFrame, text: str) -> DataFrame:
    """Ids that hold every trigram of the text: a superset of its substring matches."""
    grams = sorted({text[i : i + 3] for i in range(max(1, len(text) - 2))})
    hits = index.where(F.col("gram").isin(*grams)).groupBy("id").agg(F.count_distinct("gram").alias("n"))
    return hits.where(F.col("n") == len(grams)).select("id")


def within_budget(rows: DataFrame, text: str, order: list[str], budget: int, chars_per_token: int = 3) -> DataFrame:
    """The prefix of the ordered lines that fits the token budget, with the running characters."""
    most = budget * chars_per_token
    rows = rows.orderBy(*order).limit(most)  # every line takes a character at least, so no more lines fit
    run = F.sum(F.length(text) + 1).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("cum_chars", run).where(F.col("cum_chars") <= budget * chars_per_token)


def ambiguity(scored: DataFrame) -> DataFrame:
    """The best match and whether the runner-up is within a tenth of it."""
    order = Window.orderBy(F.desc("score"), F.length(F.coalesce("label", "id")), "id")
    best = ranked(scored, 2).withColumn("runner_up", F.lead("score").over(order)).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return best.select("id", "score", "runner_up", F.coalesce((F.col("score") - F.col("runner_up")) / F.col("score") < 0.1, F.lit(False)).alias("ambiguous"))
