"""What is worth telling about a graph: surprising edges, questions, sections, diagrams, token reduction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.functions import predicates as P
from lattice.model import STRUCTURAL_RELATIONS, PropertyGraph
from lattice.operators import stats
from lattice.storage import stored


def _described(g: PropertyGraph) -> DataFrame:
    """Edges with label, source file, community and degree of both ends (u_, v_)."""
    about = g.nodes.join(g.degrees(), "id", "left").fillna(0, ["degree"]).select("id", "label", "source_file", "community", "degree")
    side = lambda end, p: about.select(F.col("id").alias(end), *(F.col(c).alias(p + c) for c in about.columns[1:]))
    return g.edges.drop("source_file").join(side("source", "u_"), "source").join(side("target", "v_"), "target")


def surprise_scores(g: PropertyGraph) -> DataFrame:
    """Edges between real entities of different files with an additive score and its reasons."""
    rows = _described(g).where(~F.col("relation").isin(*STRUCTURAL_RELATIONS) & (F.col("u_source_file") != F.col("v_source_file")))
    rows = rows.where(~P.is_concept_node(F.col("u_source_file")) & ~P.is_concept_node(F.col("v_source_file")))
    conf, kind_u, kind_v = F.col("confidence"), P.file_category(F.col("u_source_file")), P.file_category(F.col("v_source_file"))
    code_doc = F.array_sort(F.array(kind_u, kind_v)) == F.array(F.lit("code"), F.lit("doc"))
    mute = (conf == "INFERRED") & F.col("relation").isin("calls", "uses") & (P.cross_language(F.col("u_source_file"), F.col("v_source_file")) | code_doc)
    base = F.when(mute, 0).when(conf == "AMBIGUOUS", 3).when(conf == "INFERRED", 2).otherwise(1)
    kinds = ~mute & (kind_u != kind_v)
    dirs = ~mute & (P.top_dir(F.col("u_source_file")) != P.top_dir(F.col("v_source_file")))
    apart = ~mute & F.coalesce(F.col("u_community") != F.col("v_community"), F.lit(False))
    similar = F.col("relation") == "semantically_similar_to"
    edge = (F.least("u_degree", "v_degree") <= 2) & (F.greatest("u_degree", "v_degree") >= 5)
    score = base + F.when(kinds, 2).otherwise(0) + F.when(dirs, 2).otherwise(0) + F.when(apart, 1).otherwise(0)
    score = F.when(similar, F.floor(score * 1.5)).otherwise(score) + F.when(edge, 1).otherwise(0)
    why = F.concat_ws(
        "; ",
        F.when(conf.isin("AMBIGUOUS", "INFERRED"), F.concat(F.lower(conf), F.lit(" connection"))),
        F.when(kinds, F.concat(F.lit("crosses file types "), kind_u, F.lit(" and "), kind_v)),
        F.when(dirs, F.lit("crosses top directories")),
        F.when(apart, F.lit("bridges communities")),
        F.when(similar, F.lit("similar without a link")),
        F.when(edge, F.lit("a peripheral node reaches a hub")),
    )
    return rows.select("source", "target", "relation", "confidence", score.cast("long").alias("score"), why.alias("why"))


def surprises(g: PropertyGraph, top_n: int = 5) -> DataFrame:
    return surprise_scores(g).orderBy(F.desc("score"), "source", "target", "relation").limit(top_n)


def community_surprises(g: PropertyGraph, top_n: int = 5) -> DataFrame:
    """One edge per pair of communities, the least certain first: for graphs of one source."""
    rows = stats.located_edges(g).where(~F.col("relation").isin(*STRUCTURAL_RELATIONS) & (F.col("s_c") != F.col("t_c")))
    rank = P.confidence_rank(F.col("confidence"))
    best = rows.groupBy(F.least("s_c", "t_c").alias("low"), F.greatest("s_c", "t_c").alias("high")).agg(F.min(F.struct(rank.alias("r"), "source", "target", "relation", "confidence")).alias("b"))
    return best.orderBy("b.r", "low", "high").limit(top_n).select("low", "high", "b.source", "b.target", "b.relation", "b.confidence")


def questions(g: PropertyGraph, bridges: DataFrame | None = None, top_n: int = 7) -> DataFrame:
    """(seq, type, question): ambiguous edges, bridges, unsure hubs, loose nodes, loose communities; else no_signal."""
    spark = g.nodes.sparkSession
    about = _described(g)
    unsure = about.where("confidence = 'AMBIGUOUS'").orderBy("source", "target", "relation").limit(top_n)
    parts = [unsure.select(F.lit(1).alias("seq"), F.concat_ws("|", "source", "target", "relation").alias("key"), F.lit("ambiguous_edge").alias("type"), F.concat(F.lit("What is the exact relationship between `"), F.col("u_label"), F.lit("` and `"), F.col("v_label"), F.lit("`?")).alias("question"))]
    if bridges is not None:
        top = bridges.where("betweenness > 0").orderBy(F.desc("betweenness"), "id").limit(3).join(g.nodes.select("id", "label"), "id")
        parts.append(top.select(F.lit(2), F.col("id"), F.lit("bridge_node"), F.concat(F.lit("Why does `"), F.col("label"), F.lit("` connect several communities?"))))
    gods = stats.god_nodes(g, 5)
    guessed = g.ends().where("confidence = 'INFERRED'").join(gods, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").join(gods, "id")
    parts.append(guessed.select(F.lit(3), F.col("id"), F.lit("verify_inferred"), F.concat(F.lit("Are the "), F.col("n").cast("string"), F.lit(" inferred relationships of `"), F.col("label"), F.lit("` correct?"))))
    loose = g.nodes.join(g.degrees(), "id", "left").where("coalesce(degree, 0) <= 1").where(~P.is_concept_node(F.col("source_file")))
    loose = loose.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n > 0")
    parts.append(loose.select(F.lit(4), F.col("id"), F.lit("isolated_nodes"), F.concat(F.lit("What connects `"), F.col("id"), F.lit("` and "), (F.col("n") - 1).cast("string"), F.lit(" other loose nodes to the rest?"))))
    thin = stats.cohesion(g).where("cohesion < 0.15 AND members >= 5")
    parts.append(thin.select(F.lit(5), F.col("community").cast("string"), F.lit("low_cohesion"), F.concat(F.lit("Should community "), F.col("community").cast("string"), F.lit(" be split?"))))
    parts.append(spark.range(1).select(F.lit(9), F.lit(""), F.lit("no_signal"), F.lit(None).cast("string")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    rows = rows.orderBy("seq", "key").limit(top_n + 1)
    place = F.row_number().over(Window.orderBy("seq", "key"))
    return rows.withColumn("place", place).where(f"(type != 'no_signal' OR place = 1) AND place <= {top_n}").select("place", "type", "question")


def section_edges(g: PropertyGraph, sections: DataFrame) -> DataFrame:
    """Edges by where their ends lie: intra, inter or orphan. sections: id, section."""
    rows = g.edges.join(sections.toDF("source", "s"), "source", "left").join(sections.toDF("target", "t"), "target", "left")
    kind = F.when(F.col("s").isNull() | F.col("t").isNull(), "orphan").when(F.col("s") == F.col("t"), "intra").otherwise("inter")
    return rows.select("source", "target", "relation", "s", "t", kind.alias("kind"))


def diagram_edges(g: PropertyGraph, least_score: float = 0.85) -> DataFrame:
    """EXTRACTED edges, and INFERRED ones that score enough (0.5 where no score is given)."""
    score = F.col("confidence_score") if "confidence_score" in g.edges.columns else F.lit(0.5)
    return g.edges.where((F.col("confidence") == "EXTRACTED") | ((F.col("confidence") == "INFERRED") & (F.coalesce(score, F.lit(0.5)) >= least_score)))


def diagram_nodes(g: PropertyGraph, entries: int = 5, limit: int = 20) -> DataFrame:
    """Entry candidates by out minus in degree, then the ends of the strongest edges."""
    d = stats.degree_in_out(g)
    first = d.orderBy(F.desc(F.col("n_out") - F.col("n_in")), "id").limit(entries).select("id", F.lit(0).alias("phase"))
    strong = diagram_edges(g).orderBy(F.desc("weight"), "source", "target").limit(limit)
    rest = strong.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(first.select("id"), "id", "left_anti").select("id", F.lit(1).alias("phase"))
    return first.unionAll(rest).orderBy("phase", "id").limit(limit)


def question_contexts(spark: SparkSession, g: PropertyGraph, questions: dict[str, list[str]], depth: int = 3, seeds: int = 3) -> DataFrame:
    """(question, chars) of the text that answers each question: a line per node and per edge walked.

    A question's seeds are the nodes whose labels hold most of its terms (ties: the largest id); all nodes within ``depth``
    steps come along, hubs too. All questions walk together, a row for each question and node, and every frontier is written
    once. A question that no label matches has no row.
    """
    label = F.lower(F.coalesce("label", F.lit("")))
    asked = [(q, sum((F.when(F.contains(label, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))) for q, terms in questions.items()]
    hits = g.nodes.select("id", F.explode(F.array(*(F.struct(F.lit(q).alias("question"), n.alias("hits")) for q, n in asked))).alias("h")).select("h.question", "h.hits", "id").where("hits > 0")
    best = Window.partitionBy("question").orderBy(F.desc("hits"), F.desc("id"))
    front = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= seeds).select("question", "id")
    there = g.edges.select("source", "target", "relation")
    back = there.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation")
    near = stored(spark, there.unionAll(back).where("source != target").groupBy("source", "target").agg(F.min("relation").alias("relation")), "near")
    levels, walked = [stored(spark, front, "front")], []
    for _ in range(depth):
        step = near.join(levels[-1].withColumnRenamed("id", "source"), "source")
        for seen in levels:
            step = step.join(seen.withColumnRenamed("id", "target"), ["question", "target"], "left_anti")
        walked.append(stored(spark, step.select("question", "source", "target", "relation"), "walked"))
        levels.append(stored(spark, walked[-1].select("question", F.col("target").alias("id")).distinct(), "front"))
    place = F.coalesce("source_location", F.lit("")) if "source_location" in g.nodes.columns else F.lit("")
    about = g.nodes.select("id", F.coalesce("label", "id").alias("label"), F.concat(F.lit("NODE "), F.coalesce("label", "id"), F.lit(" src="), F.coalesce("source_file", F.lit("")), F.lit(" loc="), place).alias("line"))
    side = lambda c, n: about.select(F.col("id").alias(c), F.col("label").alias(n))
    lines = reduce(DataFrame.unionAll, levels).join(about, "id").select("question", "line")
    edges = reduce(DataFrame.unionAll, walked).join(side("source", "u"), "source").join(side("target", "v"), "target")
    lines = lines.unionAll(edges.select("question", F.concat(F.lit("EDGE "), "u", F.lit(" --"), F.coalesce("relation", F.lit("")), F.lit("--> "), "v").alias("line")))
    return lines.groupBy("question").agg((F.sum(F.length("line") + 1) - 1).alias("chars"))


def token_reduction(words: DataFrame, contexts: DataFrame) -> DataFrame:
    """corpus tokens (words * 100 div 75) against each question's context tokens (chars div 4).

    words: one row, n_words; contexts: question, chars.
    """
    corpus = words.select(F.expr("n_words * 100 div 75").alias("corpus_tokens"))
    rows = contexts.select("question", F.greatest(F.lit(1), F.expr("chars div 4")).alias("query_tokens")).crossJoin(corpus)  # one row
    return rows.withColumn("reduction", F.bround(F.col("corpus_tokens") / F.col("query_tokens"), 1))
