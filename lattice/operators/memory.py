"""Feedback memory: time-decayed scores per node, verdicts, and what was learned last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HALF_LIFE_DAYS, MIN_CORROBORATION, DIGITS = 30.0, 2, 6


def events_of(docs: DataFrame, now, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """One row per (doc, node): sign and weight. docs: doc, date (timestamp), question, outcome, source_nodes."""
    sign = F.when(F.col("outcome") == "useful", 1).when(F.col("outcome").isin("dead_end", "corrected"), -1).otherwise(0)
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("date")) / 86400e6)
    weight = F.when(F.col("date").isNull() | F.lit(half_life_days <= 0), 1.0).otherwise(F.pow(F.lit(0.5), age / half_life_days))
    rows = docs.select("doc", "date", "question", "outcome", sign.alias("sign"), weight.alias("weight"), F.explode(F.array_distinct("source_nodes")).alias("node"))
    return rows.where("sign != 0")


def node_scores(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per node (and ``by``): pos, neg, score, last; additive, so partial aggregation applies."""
    return events.groupBy(*by, "node").agg(F.count_if(F.col("sign") > 0).alias("pos"), F.count_if(F.col("sign") < 0).alias("neg"), F.round(F.sum(F.col("sign") * F.col("weight")), DIGITS).alias("score"), F.max("date").alias("last"))


def lessons(scores: DataFrame, min_corroboration: int = MIN_CORROBORATION) -> DataFrame:
    """bucket (preferred, tentative or contested) and verdict; nodes with bad marks only are left to dead ends."""
    bucket = F.when((F.col("pos") > 0) & (F.col("neg") > 0), "contested").when(F.col("pos") >= min_corroboration, "preferred").when(F.col("pos") > 0, "tentative")
    verdict = F.when(F.col("score") > 0, "useful").when(F.col("score") < 0, "dead end").otherwise("even")
    return scores.withColumn("bucket", bucket).where("bucket IS NOT NULL").withColumn("verdict", F.when(F.col("bucket") == "contested", verdict))


def plurality_community(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per doc the community that most of its nodes are in; the smaller label wins a tie; none: Uncategorized."""
    cited = docs.select("doc", F.explode_outer(F.array_distinct("source_nodes")).alias("id")).join(nodes.select("id", "community"), "id", "left")
    counts = cited.groupBy("doc", "community").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("doc").agg(F.min_by("community", F.when(F.col("community").isNotNull(), F.struct(-F.col("n"), F.col("community")))).alias("community"))
    return best.select("doc", F.coalesce(F.col("community").cast("string"), F.lit("Uncategorized")).alias("community"))


def latest_per_question(docs: DataFrame) -> DataFrame:
    """The newest doc of each question."""
    return docs.groupBy("question").agg(F.max_by(F.struct("doc", "date", "outcome"), F.struct("date", "doc")).alias("l")).select("question", "l.*")


def provenance(events: DataFrame, keep: int = 5) -> DataFrame:
    """The most recent useful or corrected citations of each node."""
    rows = events.where("outcome IN ('useful', 'corrected')")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("date"), "question", "doc"))
    return rows.withColumn("rank", place).where(F.col("rank") <= keep).select("node", "rank", "date", "question", "outcome")
