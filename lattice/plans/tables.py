"""Registered queries over the driver tables, second part: files, text, entities, resolution, memory, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.functions import predicates as P
from lattice.functions import text as T
from lattice.model import PropertyGraph
from lattice.operators import analysis, communities, entity, grouping, memory, merge, resolve, search, stats, traverse
from lattice.plans.star import STAR_SQL, read, star_graph
from lattice.sources import files, formats
from lattice.storage import bound_batches, stored
from lattice.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = "2026-01-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- files and text ----

PATHS_SQL = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'src/app/mod' || doc_id || '.py' WHEN 1 THEN 'docs/' || source || '/note' || doc_id || '.md' WHEN 2 THEN 'tests/test_' || doc_id || '.py' WHEN 3 THEN 'assets/' || lang || doc_id || '.png' WHEN 4 THEN 'src/' || source || '/secrets/k' || doc_id || '.json' ELSE 'papers/' || doc_id || '.pdf' END AS path, text FROM documents"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    path = F.when(k == 0, F.concat(F.lit("src/app/mod"), i, F.lit(".py"))).when(k == 1, F.concat(F.lit("docs/"), "source", F.lit("/note"), i, F.lit(".md"))).when(k == 2, F.concat(F.lit("tests/test_"), i, F.lit(".py")))
    path = path.when(k == 3, F.concat(F.lit("assets/"), "lang", i, F.lit(".png"))).when(k == 4, F.concat(F.lit("src/"), "source", F.lit("/secrets/k"), i, F.lit(".json"))).otherwise(F.concat(F.lit("papers/"), i, F.lit(".pdf")))
    return read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")


@query(f"SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'code' WHEN 2 THEN 'code' WHEN 3 THEN 'image' WHEN 5 THEN 'paper' WHEN 1 THEN 'document' END AS kind FROM ({PATHS_SQL})")
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = files.classify(F.col("path"), F.col("text"))
    return _paths(spark, sf_dir).select("doc_id", kind.alias("kind"))


@query(f"SELECT doc_id, path FROM ({PATHS_SQL}) WHERE doc_id % 6 = 4")
def sensitive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(files.sensitive(F.col("path"))).select("doc_id", "path")


@query(f"SELECT doc_id, path FROM ({PATHS_SQL}) WHERE doc_id % 6 IN (0, 1, 2) AND (doc_id % 6 <> 1 OR path LIKE 'docs/src1/%')")
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.apply_ignore(_paths(spark, sf_dir), ["# generated", "assets/", "secrets/", "*.pdf", "docs/*/*.md", "!docs/src1/*.md"]).select("doc_id", "path")


@query(f"SELECT doc_id FROM ({PATHS_SQL}) WHERE doc_id % 6 = 2")
def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).where(P.is_test_path(F.col("path"))).select("doc_id")


@query(f"SELECT split_part(path, '/', 1) AS top, regexp_extract(path, '\\.([a-z]+)$', 1) AS suffix, count(*) AS n FROM ({PATHS_SQL}) GROUP BY ALL")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).groupBy(P.top_dir(F.col("path")).alias("top"), P.suffix(F.col("path")).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS n_words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", files.word_count(F.col("text")).alias("n_words"))


@query("SELECT count(*) AS files, sum(w)::BIGINT AS words, CASE WHEN sum(w) >= 500000 OR count(*) >= 500 THEN 'large' WHEN sum(w) < 50000 THEN 'small' ELSE 'medium' END AS verdict FROM (SELECT len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS w FROM documents)")
def corpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.corpus_size(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), files.word_count(F.col("text")).alias("words")))


@query("SELECT doc_id, " + " + ".join(f"regexp_matches(h, '{p}')::INT" for p in files.PAPER_SIGNALS).replace("\\n", "\\n") + " AS signals FROM (SELECT doc_id, left(text, 3000) AS h FROM documents)")
def paper_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", files.paper_signals(F.col("text")).alias("signals"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'deleted' WHEN a.m = b.m OR a.h = b.h THEN 'unchanged' ELSE 'changed' END AS state FROM (SELECT doc_id, doc_id % 7 AS m, md5(text) AS h FROM documents WHERE doc_id % 10 <> 3) a FULL JOIN (SELECT doc_id, doc_id % 5 AS m, md5(CASE WHEN doc_id % 4 = 1 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 4) b ON a.doc_id = b.doc_id")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    now = docs.where("doc_id % 10 != 3").select(F.col("doc_id").alias("path"), (F.col("doc_id") % 7).alias("mtime"), F.md5("text").alias("hash"))
    then = docs.where("doc_id % 10 != 4").select(F.col("doc_id").alias("path"), (F.col("doc_id") % 5).alias("mtime"), F.md5(F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return files.manifest_diff(now, then)


@query(f"SELECT doc_id, path, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS value FROM ({PATHS_SQL})")
def extraction_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir).select("doc_id", "path", files.cache_key(F.col("path"), F.col("text")).alias("key"))
    cache = rows.where("doc_id % 3 = 0").select("key", F.col("doc_id").alias("value"))
    hits, misses = files.cache_split(rows, cache)
    return hits.select("doc_id", "path", "value").unionAll(misses.select("doc_id", "path", F.lit(None).cast("long")))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0")
def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir).select("doc_id", files.cache_key(F.col("path"), F.col("text")).alias("key"))
    return files.cache_prune(rows.where("doc_id % 3 = 0"), rows.where("doc_id % 2 = 0")).select("doc_id")


def _slice_end(at: str) -> str:
    """Where the slice from ``at`` stops: before the last heading, after the last blank line, after the last newline, or full."""
    last = lambda mark, n: f"{2000 - n} - length(string_split(substr(t, {at} + 1, 2000), {mark})[-1])"
    heading, blank, line = last("chr(10) || '#'", 2), last("chr(10) || chr(10)", 2), last("chr(10)", 1)
    return f"CASE WHEN n - {at} <= 2000 THEN n WHEN {heading} > 0 THEN {at} + {heading} + 1 WHEN {blank} > 0 THEN {at} + {blank} + 2 WHEN {line} > 0 THEN {at} + {line} + 1 ELSE {at} + 2000 END"


@query(f"""WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, t, n, 0 AS idx, 0 AS start, {_slice_end("0")} AS stop FROM docs UNION ALL SELECT doc_id, t, n, idx + 1, stop, {_slice_end("stop")} FROM s WHERE stop < n)
SELECT doc_id, idx::INT AS idx, start::INT AS start, stop::INT AS stop FROM s""")
def doc_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.slices(read(spark, sf_dir, "documents"), 2000)


@query(f"""WITH RECURSIVE f AS (SELECT path, greatest(1, length(coalesce(text, '')) // 4) AS tokens, ends_with(path, '.png') AS image, row_number() OVER (ORDER BY string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), path) AS k FROM ({PATHS_SQL})),
w AS (SELECT k, path, 0 AS chunk, tokens AS used, image::INT AS images FROM f WHERE k = 1
 UNION ALL SELECT f.k, f.path, CASE WHEN w.used + f.tokens > 4000 OR (f.image AND w.images >= 20) THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.used + f.tokens > 4000 OR (f.image AND w.images >= 20) THEN f.tokens ELSE w.used + f.tokens END, CASE WHEN w.used + f.tokens > 4000 OR (f.image AND w.images >= 20) THEN f.image::INT ELSE w.images + f.image::INT END FROM w JOIN f ON f.k = w.k + 1)
SELECT path, chunk::INT AS chunk FROM w""")
def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.pack(_paths(spark, sf_dir).select("path", F.greatest(F.lit(1), F.expr("length(coalesce(text, '')) div 4")).alias("tokens")), 4000)


@query("SELECT page_id, CASE WHEN contains(lower(url), 'twitter.com') OR contains(lower(url), 'x.com') THEN 'tweet' WHEN contains(lower(url), 'github.com') THEN 'github' ELSE 'webpage' END AS kind FROM pages")
def url_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", files.url_type(F.col("url")).alias("kind"))


@query("SELECT page_id, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 8000) AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", files.html_to_text(F.col("html")).alias("text"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.links(read(spark, sf_dir, "pages"))


@query("SELECT prefix, count(*) AS total_count FROM (SELECT unnest(list_transform(range(0, len(p) + 1), lambda k: array_to_string(p[1:k], '/'))) AS prefix FROM (SELECT list_filter(string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages)) GROUP BY prefix")
def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tree_rollup(read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path")))


QUESTIONS = {
    "which customers live in asia": ["customers", "live", "asia"],
    "what is green and hot": ["green", "hot"],
    "who supplies china and japan": ["supplies", "china", "japan"],
    "how does order 77 reach europe": ["order 77", "europe"],
    "how does authentication work": ["authentication"],
}


def _reduction_sql(depth: int = 3) -> str:
    """Seeds, three levels, and the lines of nodes and walked edges, for all questions at once."""
    terms = ", ".join(f"('{q}', '{t}')" for q, ts in QUESTIONS.items() for t in ts)
    sql = f"""WITH {STAR_SQL}, terms AS (SELECT * FROM (VALUES {terms}) v(question, t)),
d0 AS (SELECT question, id FROM (SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY count(*) DESC, id DESC) AS r FROM g_nodes JOIN terms ON contains(lower(label), t) GROUP BY question, id) WHERE r <= 3),
near AS (SELECT a, b, min(relation) AS relation FROM (SELECT source AS a, target AS b, relation FROM g_edges UNION ALL SELECT target, source, relation FROM g_edges) GROUP BY a, b)"""
    for k in range(depth):
        seen = " UNION ALL ".join(f"SELECT question, id FROM d{i}" for i in range(k + 1))
        sql += f", w{k} AS (SELECT question, a, b, relation FROM d{k} JOIN near ON a = id WHERE (question, b) NOT IN ({seen})), d{k + 1} AS (SELECT DISTINCT question, b AS id FROM w{k})"
    nodes = " UNION ALL ".join(f"SELECT question, id FROM d{k}" for k in range(depth + 1))
    edges = " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(depth))
    return sql + f""", lines AS (SELECT question, length('NODE ' || label || ' src=' || source_file || ' loc=') AS n FROM ({nodes}) JOIN g_nodes USING (id)
 UNION ALL SELECT question, length('EDGE ' || u.label || ' --' || relation || '--> ' || v.label) FROM ({edges}) JOIN g_nodes u ON u.id = a JOIN g_nodes v ON v.id = b),
c AS (SELECT question, greatest(1, (sum(n + 1) - 1) // 4)::BIGINT AS query_tokens FROM lines GROUP BY question),
w AS (SELECT sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::BIGINT * 100 // 75 AS corpus_tokens FROM documents)
SELECT question, query_tokens, corpus_tokens::BIGINT AS corpus_tokens, round_even(corpus_tokens / query_tokens, 1)::DOUBLE AS reduction FROM c, w"""


@query(_reduction_sql())
def token_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus against the text that a depth-3 walk from each question's seeds renders, over the star graph."""
    words = read(spark, sf_dir, "documents").agg(F.sum(files.word_count(F.col("text"))).alias("n_words"))
    return analysis.token_reduction(words, analysis.question_contexts(spark, star_graph(spark, sf_dir), QUESTIONS))


@query("SELECT source, count(*) AS files, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM documents GROUP BY source")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.greatest(F.lit(1), F.expr("length(text) div 4"))).alias("tokens"))


@query("SELECT doc_id, left(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g'), 256) AS label FROM documents")
def sanitise_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", P.sanitise(F.col("text")).alias("label"))


@query("SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'code' WHEN 2 THEN 'concept' WHEN 3 THEN 'paper' ELSE 'concept' END AS file_type, 'C:/x/' || source AS source_file FROM documents")
def canonical_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*(F.lit(x) for x in ("Markdown", "tool", "whatever", "pdf", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), raw.alias("file_type"), F.concat(F.lit("C:\\x\\"), "source").alias("source_file"))
    return merge.canonical_nodes(rows).select("id", "file_type", "source_file")


# ---- entities ----

ENTITY_SQL = "SELECT 'doc:' || doc_id AS id, text AS label, CASE WHEN doc_id % 9 = 0 THEN 'code' ELSE 'concept' END AS file_type, source || '.md' AS source_file, doc_id AS ord FROM documents"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities, labelled by their whole text."""
    bound_batches(spark)
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.col("text").alias("label"), F.when(F.col("doc_id") % 9 == 0, "code").otherwise("concept").alias("file_type"), F.concat("source", F.lit(".md")).alias("source_file"), F.col("doc_id").alias("ord"))


@query(f"SELECT source_file, ids FROM (SELECT source_file, list_sort(list(DISTINCT id)) AS ids, trim(regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS norm FROM ({ENTITY_SQL}) WHERE file_type <> 'code' GROUP BY source_file, norm HAVING count(DISTINCT id) > 1 AND norm <> '')")
def dedup_exact_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.exact_groups(_entities(spark, sf_dir).withColumn("norm", T.norm_udf("label"))).select("source_file", "ids")


@query()
def dedup_lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as classes, one row per band and member (``entity.candidate_blocks``)."""
    nodes = _entities(spark, sf_dir).select("id", "label", "file_type", "ord")
    return entity.candidate_blocks(spark, entity.candidates(nodes.withColumn("norm", T.norm_udf("label"))))


@query()
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select("id", T.minhash_udf(T.norm_udf("label")).alias("signature"))


@query()
def dedup_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _entities(spark, sf_dir)
    edges = nodes.select(F.col("id").alias("source"), F.lead("id").over(_by("source_file", "ord")).alias("target"), F.lit("follows").alias("relation"))
    return entity.deduplicate(spark, nodes, edges)[2]


def _by(*order: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(order[0]).orderBy(*order[1:])


PAIRS_SQL = "SELECT a.p_partkey AS a, b.p_partkey AS b, lower(a.p_name) AS x, lower(b.p_name) AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey"


CLASS_KEYS = 256  # keys in one row of a class: rows stay small however many parts share a name


def _part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_brand, p_size, name, p_partkey) in lower case; pairs need all but the name, so rows without them are left out."""
    part = read(spark, sf_dir, "part").select("p_brand", "p_size", F.lower("p_name").alias("name"), "p_partkey")
    return part.dropna(subset=["p_brand", "p_size", "p_partkey"])


@query(f"SELECT a, b, round(jaro_similarity(x, y), 6) AS jaro, round(jaro_winkler_similarity(x, y), 6) AS jaro_winkler FROM ({PAIRS_SQL})")
def jaro_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are compared once per two classes of parts with equal name, brand and size; then the classes' keys are paired."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("p_brand", "p_size", "name").orderBy("p_partkey"))
    dealt = _part_classes(spark, sf_dir).withColumn("piece", F.floor((place - 1) / CLASS_KEYS))
    rows = dealt.groupBy("p_brand", "p_size", "name", "piece").agg(F.collect_list("p_partkey").alias("keys"), F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high")).drop("piece")
    a, b = rows.toDF("p_brand", "p_size", "x", "a_keys", "a_low", "a_high"), rows.toDF("p_brand", "p_size", "y", "b_keys", "b_low", "b_high")
    both = a.join(b, ["p_brand", "p_size"]).where("a_low < b_high").withColumn("s", T.jaro_both_udf("x", "y"))
    scored = both.select("a_keys", "b_keys", F.round("s.jaro", 6).alias("jaro"), F.round("s.jaro_winkler", 6).alias("jaro_winkler"))
    return scored.withColumn("a", F.explode("a_keys")).withColumn("b", F.explode("b_keys")).where("a < b").select("a", "b", "jaro", "jaro_winkler")


@query(f"SELECT veto, count(*) AS n FROM (SELECT CASE WHEN greatest(length(x), length(y)) < 12 AND NOT (jaro_winkler_similarity(x, y) >= 0.97 AND length(x) = length(y) AND damerau_levenshtein(x, y) <= 1) THEN 'short' WHEN x <> y AND (starts_with(x, y) OR starts_with(y, x)) THEN 'prefix' WHEN list_sort(list_transform(regexp_extract_all(x, '[0-9]+'), lambda d: regexp_replace(d, '^0+([0-9])', '\\1'))) <> list_sort(list_transform(regexp_extract_all(y, '[0-9]+'), lambda d: regexp_replace(d, '^0+([0-9])', '\\1'))) THEN 'digits' END AS veto FROM ({PAIRS_SQL})) WHERE coalesce(veto, '') <> 'short' GROUP BY veto")
def dedup_veto_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts are made once per two names and counted by class sizes, so no pair of parts is written out.

    Two classes have a pair for each two keys that differ, in one direction or the other: as many as the product of their
    sizes less the equal keys. Where a verdict depends on the direction, which greedy matching allows, keys are paired.
    """
    part = _part_classes(spark, sf_dir)
    x, y = F.col("x"), F.col("y")

    def products(*by: str) -> DataFrame:
        sized = part.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("n"))
        left, right = sized.toDF(*by, "x", "n"), sized.toDF(*by, "y", "k")
        return left.join(right, list(by)).groupBy("x", "y").agg(F.sum(F.col("n") * F.col("k")).alias("n"))

    equal = products("p_brand", "p_size", "p_partkey").withColumn("n", -F.col("n"))
    pairs = products("p_brand", "p_size").unionAll(equal).groupBy("x", "y").agg(F.sum("n").alias("n")).where("n > 0")
    sides = lambda x, y: {c: v for s, t in (("a", x), ("b", y)) for c, v in ((f"norm_{s}", t), (f"source_file_{s}", F.lit("part.parquet")), (f"file_type_{s}", F.lit("concept")))}
    there = entity.judge_pairs(pairs.withColumns(sides(x, y))).select("x", "y", "n", "veto")
    both = entity.judge_pairs(there.withColumnRenamed("veto", "there").withColumns(sides(y, x))).select("x", "y", "n", "there", F.col("veto").alias("back"))
    both = stored(spark, both, "verdicts")
    alike = both.where("there <=> back").groupBy(F.col("there").alias("veto")).agg(F.sum("n").alias("n")).withColumn("n", F.expr("n div 2"))
    torn = both.where("NOT there <=> back").select("x", "y", "there")
    a, b = part.toDF("p_brand", "p_size", "x", "a"), part.toDF("p_brand", "p_size", "y", "b")
    a, b = (side.join(torn.select(name).distinct(), side[name].eqNullSafe(torn[name]), "left_semi") for side, name in ((a, "x"), (b, "y")))
    keyed = a.join(b, ["p_brand", "p_size"]).where("a < b").alias("p").join(torn.alias("t"), F.expr("p.x <=> t.x AND p.y <=> t.y")).groupBy(F.col("there").alias("veto")).agg(F.count(F.lit(1)).alias("n"))
    return alike.unionAll(keyed).where("coalesce(veto, '') NOT IN ('short', 'variant')").groupBy("veto").agg(F.sum("n").alias("n"))


# ---- reference resolution: line items call parts by name, from their supplier's file ----

CALLS_SQL = "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS call_id, 'f' || (l_suppkey % 40) || '/m' || (l_partkey % 7) || '.py' AS file, lower(p_name) AS callee FROM lineitem JOIN part ON p_partkey = l_partkey"
SYMBOLS_SQL = "SELECT 'part:' || p_partkey AS id, lower(p_name) AS name, 'f' || (p_partkey % 40) || '/m' || (p_size % 7) || '.py' AS file FROM part"
IMPORTS_SQL = "SELECT DISTINCT 'f' || (l_suppkey % 40) || '/m' || (l_partkey % 7) || '.py' AS file, lower(p_name) AS name, 'f' || (p_partkey % 40) || '/m' || (p_size % 7) || '.py' AS from_file FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 2"


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part")
    place = lambda a, b: F.concat(F.lit("f"), (F.col(a) % 40).cast("string"), F.lit("/m"), (F.col(b) % 7).cast("string"), F.lit(".py"))
    line = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    calls = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), place("l_suppkey", "l_partkey").alias("file"), F.lower("p_name").alias("callee")).distinct()
    symbols = part.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.lower("p_name").alias("name"), place("p_partkey", "p_size").alias("file"))
    imports = line.where("l_linenumber = 2").select(place("l_suppkey", "l_partkey").alias("file"), F.lower("p_name").alias("name"), place("p_partkey", "p_size").alias("from_file")).distinct()
    return calls, symbols, imports


@query(f"""WITH c AS ({CALLS_SQL}), s AS ({SYMBOLS_SQL}), i AS ({IMPORTS_SQL}),
u AS (SELECT file, name, min(id) AS id FROM s GROUP BY ALL HAVING count(DISTINCT id) = 1),
t AS (SELECT call_id, c.file, callee, id AS target, 0 AS prio FROM c JOIN u ON u.file = c.file AND u.name = c.callee
 UNION ALL SELECT call_id, c.file, callee, u.id, 1 FROM c JOIN i ON i.file = c.file AND i.name = c.callee JOIN u ON u.file = i.from_file AND u.name = i.name
),
h AS (SELECT call_id, file, callee, count(DISTINCT target) AS n, min(target) AS first FROM (SELECT *, rank() OVER (PARTITION BY call_id, file, callee ORDER BY prio) AS r FROM t) WHERE r = 1 GROUP BY call_id, file, callee),
z AS (SELECT name, count(DISTINCT id) AS n, min(id) AS one FROM s GROUP BY name)
SELECT call_id, CASE WHEN h.n IS NOT NULL THEN 'EXTRACTED' WHEN z.n = 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence, coalesce(h.n, z.n) AS n_targets, coalesce(first, CASE WHEN z.n = 1 THEN one END) AS target FROM c LEFT JOIN h USING (call_id, file, callee) JOIN z ON z.name = c.callee""")
def resolve_call_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items; several equal names stay a class, told by their number."""
    best = resolve.best_tiers(*_calls(spark, sf_dir))
    return best.select("call_id", "confidence", "n_targets", F.get("targets", F.lit(0)).alias("target"))


@query(f"WITH c AS ({CALLS_SQL}), s AS ({SYMBOLS_SQL}), i AS ({IMPORTS_SQL}), u AS (SELECT file, name, min(id) AS id FROM s GROUP BY ALL HAVING count(DISTINCT id) = 1) SELECT DISTINCT c.file AS caller, u.id AS target FROM c JOIN i ON i.file = c.file AND i.name = c.callee JOIN u ON u.file = i.from_file AND u.name = i.name")
def import_guided_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, symbols, imports = _calls(spark, sf_dir)
    imports = imports.select("file", F.col("name").alias("local_name"), F.col("name").alias("imported_name"), F.col("from_file").alias("module_stem"))
    return resolve.import_guided(calls.select(F.col("file").alias("caller"), "callee", "file"), imports, symbols.withColumnRenamed("file", "module_stem"))


@query(f"""WITH c AS ({CALLS_SQL}), s AS (SELECT DISTINCT id, name, file FROM ({SYMBOLS_SQL})), p AS (SELECT call_id, callee, s.id AS target, c.file AS cf, s.file AS tf FROM c JOIN s ON s.name = c.callee),
g AS (SELECT *, count(*) OVER (PARTITION BY call_id, cf, callee) AS many, CASE WHEN cf = tf THEN 1000 WHEN split_part(cf, '/', 1) = split_part(tf, '/', 1) THEN 999 ELSE 0 END AS near FROM p),
t AS (SELECT *, CASE WHEN many = 1 THEN 2000 ELSE near END AS tier FROM g), b AS (SELECT *, max(tier) OVER (PARTITION BY call_id, cf, callee) AS best FROM t)
SELECT call_id, target FROM (SELECT *, count(*) OVER (PARTITION BY call_id, cf, callee) AS k FROM b WHERE tier = best AND tier > 0) WHERE k = 1""")
def bare_name_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, symbols, _ = _calls(spark, sf_dir)
    return resolve.bare_name(calls.withColumnRenamed("file", "call_file"), symbols)


@query("SELECT n_name AS ref, CASE WHEN n_nationkey % 2 = 0 THEN 'nation:' || n_nationkey END AS id FROM nation")
def resolve_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    nodes = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return resolve.citations(nation.select(F.col("n_name").alias("ref")), nodes)


@query("SELECT a.n_nationkey AS class_id, 'm' || b.n_regionkey AS name, min('nation:' || b.n_nationkey) AS target FROM nation a JOIN nation b ON b.n_nationkey = 0 OR b.n_nationkey = a.n_nationkey GROUP BY ALL HAVING count(*) = 1 OR a.n_nationkey = 0 UNION ALL SELECT a.n_nationkey, 'm' || a.n_regionkey, 'nation:' || a.n_nationkey FROM nation a WHERE a.n_nationkey <> 0 AND a.n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 0)")
def method_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation is a class below nation 0; each defines one method named after its region."""
    nation = read(spark, sf_dir, "nation")
    classes = nation.select(F.col("n_nationkey").alias("class_id"))
    inherits = nation.where("n_nationkey != 0").select(F.col("n_nationkey").alias("class_id"), F.lit(0).alias("base_id"))
    methods = nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.concat(F.lit("m"), "n_regionkey").alias("name"), F.col("n_nationkey").alias("class_id"))
    return resolve.dispatch(resolve.class_closure(inherits, classes), methods)


# ---- memory ----

MEMORY_SQL = "SELECT doc_id AS doc, TIMESTAMP '2025-01-01 00:00:00' + to_days((doc_id % 365)::INT) AS date, 'q' || (doc_id % 50) AS question, CASE WHEN toxic = 1 THEN 'dead_end' WHEN quality = 1 THEN 'useful' ELSE 'corrected' END AS outcome, ['part:' || (doc_id % 97), 'part:' || (doc_id % 13)] AS source_nodes FROM labels"
EVENTS_SQL = f"SELECT doc, date, question, outcome, CASE outcome WHEN 'useful' THEN 1 ELSE -1 END AS sign, 0.5 ** (greatest(0, date_diff('microsecond', date, TIMESTAMP '{NOW}') / 86400e6) / 30) AS weight, unnest(list_distinct(source_nodes)) AS node FROM ({MEMORY_SQL})"


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    outcome = F.when(F.col("toxic") == 1, "dead_end").when(F.col("quality") == 1, "useful").otherwise("corrected")
    date = F.to_timestamp(F.lit("2025-01-01 00:00:00")) + F.make_dt_interval(days=(d % 365).cast("int"))
    return read(spark, sf_dir, "labels").select(d.alias("doc"), date.alias("date"), F.concat(F.lit("q"), (d % 50).cast("string")).alias("question"), outcome.alias("outcome"), F.array(F.concat(F.lit("part:"), (d % 97).cast("string")), F.concat(F.lit("part:"), (d % 13).cast("string"))).alias("source_nodes"))


def _memory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.events_of(_memory(spark, sf_dir), F.to_timestamp(F.lit(NOW)))


@query(f"SELECT node, count(*) FILTER (sign > 0) AS pos, count(*) FILTER (sign < 0) AS neg, round(sum(sign * weight), 6)::DOUBLE AS score, strftime(max(date), '%Y-%m-%d') AS last FROM ({EVENTS_SQL}) GROUP BY node")
def lesson_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.node_scores(_memory_events(spark, sf_dir)).withColumn("last", F.date_format("last", "yyyy-MM-dd"))


@query(f"SELECT node, CASE WHEN pos > 0 AND neg > 0 THEN 'contested' WHEN pos >= 2 THEN 'preferred' ELSE 'tentative' END AS bucket, CASE WHEN pos > 0 AND neg > 0 THEN CASE WHEN score > 0 THEN 'useful' WHEN score < 0 THEN 'dead end' ELSE 'even' END END AS verdict FROM (SELECT node, count(*) FILTER (sign > 0) AS pos, count(*) FILTER (sign < 0) AS neg, round(sum(sign * weight), 6) AS score FROM ({EVENTS_SQL}) GROUP BY node) WHERE pos > 0")
def preferred_contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.lessons(memory.node_scores(_memory_events(spark, sf_dir))).select("node", "bucket", "verdict")


@query(f"SELECT doc, coalesce(arg_min(c, (1000 - n) * 1000 + c)::VARCHAR, 'Uncategorized') AS community FROM (SELECT doc, p_size % 25 AS c, count(*) AS n FROM (SELECT doc, unnest(list_distinct(source_nodes)) AS node FROM ({MEMORY_SQL})) LEFT JOIN part ON node = 'part:' || p_partkey GROUP BY ALL) GROUP BY doc")
def plurality_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.plurality_community(_memory(spark, sf_dir), star_graph(spark, sf_dir).nodes.where("source_file = 'part.parquet'"))


@query(f"SELECT question, doc, outcome FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY date DESC, doc DESC) AS k FROM ({MEMORY_SQL})) WHERE k = 1")
def latest_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.latest_per_question(_memory(spark, sf_dir)).select("question", "doc", "outcome")


@query(f"SELECT node, rank::INT AS rank, question, outcome FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY date DESC, question, doc) AS rank FROM ({EVENTS_SQL}) WHERE outcome IN ('useful', 'corrected')) WHERE rank <= 5")
def recent_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.provenance(_memory_events(spark, sf_dir)).select("node", "rank", "question", "outcome")


# ---- event transitions: cycles, modules ----

TRANSITIONS_SQL = "SELECT event_type AS source, nxt AS target, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY ALL"


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.lead("event_type").over(_by("user_id", "ts", "event_id")).alias("target"))
    return rows.where("target IS NOT NULL").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE e AS ({TRANSITIONS_SQL}), w AS (SELECT [source] AS p, target AS nxt FROM e UNION ALL SELECT list_append(p, nxt), e.target FROM w JOIN e ON e.source = nxt WHERE nxt > p[1] AND NOT list_contains(p, nxt) AND len(p) < 5) SELECT len(p)::INT AS length, array_to_string(p, '->') AS cycle FROM w WHERE nxt = p[1] ORDER BY 1, 2 LIMIT 20")
def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.cycles(_transitions(spark, sf_dir))


def _modules(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nations as modules: customers of one order parts from suppliers of another."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders, cust, supp = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = rows.where("c_nationkey != s_nationkey").groupBy(F.col("c_nationkey").cast("string").alias("source"), F.col("s_nationkey").cast("string").alias("target")).agg(F.count(F.lit(1)).cast("double").alias("weight")).withColumn("confidence", F.lit("EXTRACTED"))
    return PropertyGraph(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id")), edges)


@query()
def louvain_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _modules(spark, sf_dir)
    return communities.louvain(spark, g.nodes, g.edges)


CLUSTER_SQL = "SELECT id, dense_rank() OVER (ORDER BY size DESC, low)::INT - 1 AS community FROM (SELECT id, count(*) OVER (PARTITION BY g) AS size, min(id) OVER (PARTITION BY g) AS low FROM (SELECT 'nation:' || n_nationkey AS id, n_nationkey::VARCHAR AS g FROM nation UNION ALL SELECT 'customer:' || c_custkey, c_nationkey::VARCHAR FROM customer UNION ALL SELECT 'part:' || p_partkey, 'p' || p_partkey FROM part))"


@query(CLUSTER_SQL)
def cluster_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers around their nations, and parts without a link: a star joins its centre and can't be split, a loose node stands alone."""
    g = star_graph(spark, sf_dir)
    return communities.cluster(spark, g.nodes.where("source_file IN ('nation.parquet', 'customer.parquet', 'part.parquet')"), g.edges.where("source_file = 'customer.parquet'"))


@query("""WITH e AS (SELECT DISTINCT c_nationkey::VARCHAR AS a, s_nationkey::VARCHAR AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
adj AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT count(*) AS n FROM nation),
two AS (SELECT x.a AS s, y.b AS t, x.b AS v FROM adj x JOIN adj y ON y.a = x.b AND y.b <> x.a WHERE NOT EXISTS (SELECT 1 FROM adj z WHERE z.a = x.a AND z.b = y.b)),
part AS (SELECT v, 1.0 / count(*) OVER (PARTITION BY s, t) AS share FROM two)
SELECT n_nationkey::VARCHAR AS id, round(coalesce(sum(share), 0) / greatest(1, (any_value(n.n) - 1) * (any_value(n.n) - 2)), 9)::DOUBLE AS betweenness FROM nation CROSS JOIN n LEFT JOIN part ON v = n_nationkey::VARCHAR GROUP BY n_nationkey""")
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _modules(spark, sf_dir)
    return communities.betweenness(spark, g.nodes, g.edges)


# ---- grouping ----

@query("SELECT 'p' || p_partkey AS id, split_part(lower(p_name), ' ', 1) AS verb, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')[2:], ' ') AS noun FROM part WHERE split_part(lower(p_name), ' ', 1) IN ('create', 'get', 'list', 'update', 'delete', 'remove', 'add', 'find', 'send', 'process', 'handle', 'validate')")
def operation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.entry_points(read(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name")))


@query(f"SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'barrel' ELSE 'business' END AS tier FROM ({PATHS_SQL})")
def file_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _paths(spark, sf_dir)
    return grouping.file_tiers(paths.select("path"), paths.where("doc_id % 2 = 1").select("path")).select("path", "tier")


@query(f"SELECT path, split_part(path, '/', 1) AS category FROM ({PATHS_SQL})")
def folder_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.folder_partition(_paths(spark, sf_dir).select("path")).select("path", "category")


@query("SELECT 'commerce' AS domain, 3::BIGINT AS hits")
def detect_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in ("order_key", "customerName", "productPrice".replace("Price", ""), "region")], "name string")
    return grouping.detect_domain(names)


@query("SELECT 'nation:' || n AS module, fan_in FROM (SELECT s_nationkey AS n, count(DISTINCT c_nationkey) AS fan_in FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1) WHERE fan_in >= greatest(5, ceil((SELECT count(*) FROM nation) * 0.5))")
def ubiquitous_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders, cust, supp = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = rows.select(F.concat(F.lit("nation:"), "c_nationkey").alias("source"), F.concat(F.lit("nation:"), "s_nationkey").alias("target")).distinct()
    nation = F.concat(F.lit("nation:"), "n_nationkey")
    return grouping.ubiquitous(edges, read(spark, sf_dir, "nation").select(nation.alias("module"), nation.alias("feature")))


@query("SELECT c.table_name AS label, (SELECT count(*) FROM (VALUES ('nation','region'),('customer','nation'),('supplier','nation'),('orders','customer'),('lineitem','orders')) k(a, b) WHERE a = c.table_name) AS references FROM (VALUES ('region'),('nation'),('customer'),('supplier'),('part'),('orders'),('lineitem')) c(table_name)")
def relational_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    tables = spark.createDataFrame([("main", n) for n in names], "schema string, name string")
    keys = (("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "nowhere"))
    keys = spark.createDataFrame([("main", a, "main", b) for a, b in keys], "schema string, name string, ref_schema string, ref_name string")
    nodes, edges = formats.catalog_graph(tables, keys, keys.limit(0))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("references"))
    return nodes.join(out, "id", "left").fillna(0, ["references"]).select("label", "references")


# ---- streams, as batches over the same rows ----

@query("SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling(read(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("SELECT strftime(d, '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 day]) AS d FROM events) GROUP BY 1")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sliding(read(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap >= INTERVAL 1 hour OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(read(spark, sf_dir, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT user_id AS node, round(sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END * 0.5 ** (date_diff('microsecond', ts, m) / 86400e6 / 30)), 6)::DOUBLE AS score FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def stateful_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's state after all rows, by its batch equivalent: decay is relative to the node's newest event."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("m"))
    age = (F.unix_micros("m") - F.unix_micros("ts")) / 86400e6 / 30
    sign = F.when(F.col("event_type") == "error", -1).otherwise(1)
    return e.join(last, "user_id").groupBy(F.col("user_id").alias("node")).agg(F.round(F.sum(sign * F.pow(F.lit(0.5), age)), 6).alias("score"))


@query("SELECT conv_id, turn, text AS answer, q AS question FROM (SELECT *, lag(text) OVER w AS q, lag(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND r = 'user'")
def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _by("conv_id", "turn")
    rows = read(spark, sf_dir, "conversations").withColumns({"question": F.lag("text").over(w), "r": F.lag("role").over(w)})
    return rows.where("role = 'assistant' AND r = 'user'").select("conv_id", "turn", F.col("text").alias("answer"), "question")


@query("SELECT gram, p_partkey AS id FROM (SELECT DISTINCT p_partkey, unnest(CASE WHEN length(l) < 3 THEN [l] ELSE list_transform(range(1, length(l) - 1), lambda i: substr(l, i, 3)) END) AS gram FROM (SELECT p_partkey, lower(p_name) AS l FROM part))")
def trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return search.trigram_index(nodes)
