"""Mixing sources to target weights: iterative proportional fitting, in DataFrame operations only.

Token counts are summed per (source, lang, topic) cell; the cells are raked to the three target marginals in
turn; the weights are raked again under the tokens that each cell has within the token budget, so that values with too few
tokens for their target are kept whole and the others follow theirs; documents are then kept with a probability calibrated
so that the expected kept tokens of each cell follow these weights. The draw is a hash of the document id, so reruns agree.

Edge cases: null source, lang or text count as the value '' and no words; a null doc_id draws by its text;
repeated rows share their draw; texts without words weigh one token so they can be kept; an empty table gives
an empty result; a target for a value that no document has is ignored and the others are rescaled. A column ``topic`` of the
documents is the third axis (null: ''); without one, a register of the text stands in. Further columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.llm.columns import spare
from lattice.storage import stored

AXES = ("source", "lang", "topic")
#: Cells (distinct source, lang, topic) up to this many are broadcast to the documents; beyond, a shuffle join.
BROADCAST_CELLS = 100_000


def topic_of(text: Column, words: Column) -> Column:
    """A register of the whole text, standing in for a topic where the corpus has none."""
    kind = F.when(F.contains(text, F.lit(" | ")), F.lit("list")).when(words < 100, F.lit("short")).when(words < 400, F.lit("medium"))
    return kind.otherwise(F.lit("long"))


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")).cast("long")


def draw_key() -> Column:
    """What a document is drawn by: its id, or its text where it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))


def draw_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), key)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _topic(docs: DataFrame, text: Column, words: Column) -> Column:
    return F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else topic_of(text, words)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens and the draw u in [0, 1)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = count_words(text)
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), _topic(docs, text, words).alias("topic"), words.alias("_w"), draw_of(draw_key()).alias("u"))
    return rows.select("doc_id", *AXES, F.greatest("_w", F.lit(1)).alias("n_tokens"), "u")


def _settled(cells: DataFrame, name: str, few: bool) -> DataFrame:
    """Cells written and read again; few of them in one partition, where windows by any axis need no exchange."""
    cells = stored(cells.sparkSession, cells, name)
    return cells.coalesce(1) if few else cells


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = 0.7, rounds: int = 8, few: bool = False) -> DataFrame:
    """Adds ``weight`` to (source, lang, topic, tokens): raked so that each axis follows its target shares.

    Without a target for an axis, its shares are the corpus shares to the power ``temperature``, rescaled.
    """
    total = Window.partitionBy(F.lit(0))
    for axis in AXES:
        if targets and axis in targets:
            cells = cells.join(targets[axis].select(axis, F.col("share").cast("double").alias(f"_{axis}")), axis, "left").fillna(0.0, [f"_{axis}"])
        else:
            share = F.pow(F.sum("tokens").over(Window.partitionBy(axis)) / F.sum("tokens").over(total), F.lit(temperature))
            cells = cells.withColumn(f"_{axis}", share)
    for axis in AXES:  # shares of the values that occur sum to 1
        one = F.row_number().over(Window.partitionBy(axis).orderBy(*AXES))
        cells = cells.withColumn("_one", F.when(one == 1, F.col(f"_{axis}")).otherwise(0.0))
        cells = cells.withColumn(f"_{axis}", F.coalesce(F.try_divide(f"_{axis}", F.sum("_one").over(total)), F.lit(0.0))).drop("_one")
    cells = cells.withColumn("weight", F.col("tokens") / F.sum("tokens").over(total))
    for _ in range(rounds):
        for axis in AXES:
            have = F.sum("weight").over(Window.partitionBy(axis))
            cells = cells.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"_{axis}") / have).otherwise(0.0))
        cells = _settled(cells, "raked", few)
    return cells.drop(*(f"_{axis}" for axis in AXES))


def _filled(cells: DataFrame, want: str, most: str, room: str, by: list[Column], name: str) -> DataFrame:
    """Adds ``name``: ``want`` times one factor per group ``by``, so that least(it, ``most``) sums to ``room``; ``most`` if that is less."""
    group = Window.partitionBy(*by)
    here = group.orderBy(F.desc("_need"), *AXES).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_need", F.coalesce(F.try_divide(want, most), F.lit(0.0)))
    cells = cells.withColumn("_over", F.col(room) - F.coalesce(F.sum(most).over(here), F.lit(0.0)))
    cells = cells.withColumn("_rest", F.sum(want).over(group) - F.coalesce(F.sum(want).over(here), F.lit(0.0)))
    cells = cells.withColumn("_c", F.when(F.col("_rest") > 1e-15, F.greatest(F.col("_over"), F.lit(0.0)) / F.col("_rest")))
    good = F.when((F.col("_c") * F.col("_need") <= 1) & (F.col("_over") >= 0), F.col("_c"))
    # no factor does where the whole group is no more than the room, but for rounding
    factor = F.when(F.col(room) < F.sum(most).over(group) * (1 - 1e-9), F.max(good).over(group))
    filled = F.when(factor.isNotNull(), factor * F.col(want)).otherwise(F.greatest(want, most))
    return cells.withColumn(name, F.when(F.col(want) > 0, filled).otherwise(0.0)).drop("_need", "_over", "_rest", "_c")


def rake_within(cells: DataFrame, keep: float = 0.8, rounds: int = 8, few: bool = False) -> DataFrame:
    """Re-rakes ``weight`` so that no cell gets more than its tokens within the budget ``keep``.

    A value whose tokens are fewer than its share of the budget is kept whole; the others of its axis follow their shares
    among themselves. The axis shares are those of the weights given.
    """
    every = Window.partitionBy(F.lit(0))
    cells = cells.withColumn("_most", F.when(F.col("weight") > 0, F.col("tokens") / (F.sum("tokens").over(every) * keep)).otherwise(0.0)).withColumn("_one", F.lit(1.0))
    for axis in AXES:
        value = Window.partitionBy(axis)
        first = F.row_number().over(Window.partitionBy(axis).orderBy(*AXES)) == 1
        cells = cells.withColumn("_w", F.when(first, F.sum("weight").over(value)).otherwise(0.0)).withColumn("_m", F.when(first, F.sum("_most").over(value)).otherwise(0.0))
        cells = _filled(cells, "_w", "_m", "_one", [F.lit(0)], "_t")
        cells = cells.withColumn(f"_{axis}", F.max(F.least("_t", "_m")).over(value)).drop("_w", "_m", "_t")
    for _ in range(rounds):
        for axis in AXES:
            cells = _filled(cells, "weight", "_most", f"_{axis}", [F.col(axis)], "weight")
        cells = _settled(cells, "within", few)
    return cells.withColumn("weight", F.least("weight", "_most")).drop("_most", "_one", *(f"_{axis}" for axis in AXES))


def calibrate(cells: DataFrame, keep: float = 0.8) -> DataFrame:
    """Adds ``probability``: min(1, c * weight / tokens), with c so that ``keep`` of all tokens are expected."""
    # cells in falling order of need; the first that are saturated are kept whole, the rest share what is left
    order = Window.orderBy(F.desc("_need"), *AXES)
    here = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    cells = cells.withColumn("_need", F.col("weight") / F.col("tokens"))
    cells = cells.withColumn("_full", F.coalesce(F.sum("tokens").over(here), F.lit(0)).cast("double"))
    cells = cells.withColumn("_rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(here), F.lit(0.0)))
    cells = cells.withColumn("_c", (keep * F.sum("tokens").over(every) - F.col("_full")) / F.when(F.col("_rest") > 1e-12, F.col("_rest")))
    good = F.when((F.col("_c") * F.col("_need") <= 1) & (F.col("_c") >= 0), F.col("_c"))
    cells = cells.withColumn("_scale", F.max(good).over(every))
    probability = F.least(F.lit(1.0), F.coalesce(F.col("_scale"), F.lit(1e300)) * F.col("_need"))
    return cells.withColumn("probability", F.when(F.col("weight") > 0, probability).otherwise(0.0)).drop("_need", "_full", "_rest", "_c", "_scale")


def shares_of(spark: SparkSession, rows: DataFrame, targets, temperature: float, rounds: int, keep: float) -> DataFrame:
    """(source, lang, topic, tokens, target, probability) of each cell; target: its raked weight before the budget bounds it."""
    cells = stored(spark, rows.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")), "cells")
    few = cells.count() <= BROADCAST_CELLS
    raked = rake(cells.coalesce(1) if few else cells, targets, temperature, rounds, few).withColumn("target", F.col("weight"))
    raked = stored(spark, calibrate(rake_within(raked, keep, rounds, few), keep).select(*AXES, "tokens", "target", "probability"), "shares")
    return F.broadcast(raked) if few else raked


def marginals(shares: DataFrame) -> DataFrame:
    """(axis, value, target, reached): target share of each value, and its expected share of the kept tokens."""
    total = shares.agg(F.sum(F.col("tokens") * F.col("probability")).alias("all"))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in AXES))).alias("v")
    sums = shares.select(each, "target", (F.col("tokens") * F.col("probability")).alias("kept")).groupBy("v").agg(F.sum("target").alias("target"), F.sum("kept").alias("kept"))
    return sums.join(F.broadcast(total)).select("v.axis", "v.value", "target", F.coalesce(F.try_divide("kept", "all"), F.lit(0.0)).alias("reached"))


def sample(spark: SparkSession, docs: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = 0.7, rounds: int = 8, keep: float = 0.8) -> DataFrame:
    """The kept documents with their own columns, whatever these are called."""
    *own, p = spare(docs.columns, *(f"_{a}" for a in AXES), "_p")
    shares = shares_of(spark, measure(docs), targets, temperature, rounds, keep).select(*(F.col(a).alias(o) for a, o in zip(AXES, own, strict=True)), F.col("probability").alias(p))
    text = F.coalesce(F.col("text"), F.lit(""))
    values = (F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), _topic(docs, text, count_words(text)))
    return docs.withColumns(dict(zip(own, values, strict=True))).join(shares, own).where(draw_of(draw_key()) < F.col(p)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = 0.7, rounds: int = 8, keep: float = 0.8) -> DataFrame:
    """Kept documents: doc_id, source, lang, topic, n_tokens, probability, weight (1 / probability)."""
    rows = measure(docs)
    shares = shares_of(spark, rows, targets, temperature, rounds, keep).select(*AXES, "probability")
    kept = rows.join(shares, list(AXES)).where("u < probability")
    return kept.select("doc_id", *AXES, "n_tokens", "probability", (1 / F.col("probability")).alias("weight"))
