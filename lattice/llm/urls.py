"""URL filter: explicit rules, then a path-template tree per host, in DataFrame operations only.

Each path becomes segments whose variable ones (numbers, hex runs, dates, long slugs) are generalised by shape. The
tree of a host's paths grows level by level, to any depth: a stretch that all paths of a branch share is one step; where a
branch has more than ``fanout`` children they become one wildcard; children whose counts of blocked rows do not differ (two-proportion
test at ``similar``, shares within ``near``) are merged and share their evidence. A branch is a leaf once all or none of its rows are
blocked, or one path is left. A template is rejected where its purity, smoothed towards its branch and host, reaches ``reject``.

Labels are the verdicts of the rules alone, or of ``labels`` (page_id, bad) where given; other rows count as clean, so a
row without a rule is blocked only where most rows of its template are. Each level is written once and read again,
so plans stay small at any depth.

Edge cases: null url or no ``://``: host and path empty, no rule, allowed; repeated rows are judged alike and
kept; an empty table gives none; columns beyond page_id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.storage import discard, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_INLINE_RULES = 500
#: Templates up to this many are broadcast to the pages; beyond, a shuffle join.
BROADCAST_TEMPLATES = 200_000
VARIABLE = r"^([0-9]+|[0-9a-f]{8,}|[0-9]{4}-[0-9]{2}(-[0-9]{2})?|.{40,})(\.[a-z0-9]{1,5})?$"


def split_url(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _match(rules, pages: DataFrame) -> DataFrame:
    """Adds rule and rule_verdict: the longest fitting rule's."""
    if len(rules) > MAX_INLINE_RULES:  # many rules: an equi-join on each host suffix instead of a long expression
        spark = pages.sparkSession
        table = spark.createDataFrame([(a, h, p) for a, h, p in rules], "action string, rule_host string, rule_path string")
        labels = F.split("host", r"\.")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        hosts = pages.select("host", "path").distinct()
        fits = hosts.withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").where("startswith(path, rule_path)")
        best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"), F.struct(F.length("rule_host") + F.length("rule_path"), "rule_host")).alias("_b"))
        return pages.join(best, ["host", "path"], "left").select(*pages.columns, F.col("_b.rule").alias("rule"), F.col("_b.action").alias("rule_verdict"))
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return pages.withColumn("_r", found).select(*pages.columns, F.col("_r.rule").alias("rule"), F.col("_r.action").alias("rule_verdict"))


def _shared(lo: Column, hi: Column) -> Column:
    """How many leading segments the smallest and largest path, and so all between them, have in common."""
    differ = F.array_position(F.transform(F.arrays_zip(lo.alias("a"), hi.alias("b")), lambda z: z.a.eqNullSafe(z.b)), F.lit(False))
    return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(lo), F.size(hi))).cast("int")


def _grow(open_: DataFrame, fanout: int, alpha: float, similar: float, near: float) -> DataFrame:
    """The next level of open branches: rows (host, norm, rest, branch, purity, n, b) with their children's names and purities."""
    wide = open_.groupBy("branch").agg(F.count_distinct(F.coalesce(F.try_element_at("rest", F.lit(1)), F.lit(""))).alias("kids"))
    first = F.coalesce(F.try_element_at("rest", F.lit(1)), F.lit(""))
    rows = open_.join(wide, "branch").withColumn("g", F.when((F.col("kids") > fanout) & (first != ""), F.lit("*")).otherwise(first))
    kids = rows.groupBy("branch", "g").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.first("purity").alias("up"))
    # at most fanout + 1 children a branch, in order of their shares; a new group starts where neighbours differ
    order = Window.partitionBy("branch").orderBy(F.col("b") / F.col("n"), "g")
    n0, b0 = F.lag("n").over(order), F.lag("b").over(order)
    pooled = (F.col("b") + b0) * (F.col("n") + n0 - F.col("b") - b0)
    cross = (F.col("b") * n0 - b0 * F.col("n")).cast("double")
    z = F.coalesce(F.try_divide(cross * cross * (F.col("n") + n0), (F.col("n") * n0).cast("double") * pooled), F.lit(0.0))
    alike = (z < similar) & (F.col("b") / F.col("n") - b0 / n0 <= near)
    kids = kids.withColumn("new", F.when(alike, 0).otherwise(1)).withColumn("group", F.sum("new").over(order))
    group = Window.partitionBy("branch", "group")
    purity = (F.sum("b").over(group) + alpha * F.col("up")) / (F.sum("n").over(group) + alpha)
    name = F.min("g").over(group)
    label = F.when(F.count(F.lit(1)).over(group) > 1, F.concat(F.lit("{"), name, F.lit("|..}"))).otherwise(name)
    kids = kids.select("branch", "g", purity.alias("purity"), F.concat("branch", F.lit("/"), label).alias("next"))
    rest = F.when(F.size("rest") > 1, F.slice("rest", 2, F.size("rest"))).otherwise(F.array().cast("array<string>"))
    return rows.drop("purity").join(kids, ["branch", "g"]).select("host", "norm", rest.alias("rest"), F.col("next").alias("branch"), "purity", "n", "b")


def templates(spark: SparkSession, paths: DataFrame, fanout: int = 16, alpha: float = 4.0, prior: float = 0.02, similar: float = 3.84, near: float = 0.2) -> DataFrame:
    """(host, norm, template, purity) of the distinct (host, norm, segs) with n rows, b of them blocked."""
    host = paths.groupBy("host").agg(((F.sum("b") + alpha * prior) / (F.sum("n") + alpha)).alias("purity"))
    level = stored(spark, paths.join(host, "host").select("host", "norm", F.col("segs").alias("rest"), F.col("host").alias("branch"), "purity", "n", "b"), "level")
    leaves = None
    while True:
        each = level.groupBy("branch").agg(F.sum("n").alias("all"), F.sum("b").alias("bad"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        each = each.select("branch", ((F.col("bad") == 0) | (F.col("bad") == F.col("all")) | (F.col("lo") == F.col("hi"))).alias("leaf"), "lo", "hi", _shared(F.col("lo"), F.col("hi")).alias("same"))
        rows = stored(spark, level.join(each, "branch"), "rows")
        discard(spark, level)
        name = F.array_join(F.concat(F.array("branch"), F.slice("lo", 1, F.col("same"))), "/")
        done = rows.where("leaf").select("host", "norm", F.when(F.col("lo") == F.col("hi"), name).otherwise(F.concat(name, F.lit("/**"))).alias("template"), "purity")
        leaves = done if leaves is None else leaves.unionAll(done)
        further = rows.where("NOT leaf")
        if further.isEmpty():
            return leaves
        past = F.slice("rest", F.col("same") + 1, F.size("rest"))
        level = stored(spark, _grow(further.select("host", "norm", past.alias("rest"), name.alias("branch"), "purity", "n", "b"), fanout, alpha, similar, near), "level")


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, labels: DataFrame | None = None, reject: float = 0.5, **tree) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity."""
    host, path = split_url(F.col("url"))
    rows = _match(rules, pages.select("page_id", host.alias("host"), path.alias("path")))
    parts = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.when(F.regexp_like(s, F.lit(VARIABLE)), F.regexp_replace(s, VARIABLE, r"{v}$3")).otherwise(s))
    rows = rows.withColumn("norm", F.array_join(parts, "/"))
    bad = F.coalesce(F.col("rule_verdict") == "block", F.lit(False))
    told = rows.withColumn("bad", bad)
    if labels is not None:
        marks = labels.groupBy("page_id").agg(F.max("bad").alias("mark"))
        told = rows.join(marks, "page_id", "left").withColumn("bad", F.coalesce("mark", bad))
    # the tree lives on distinct templates, far fewer than pages; counting is pre-aggregated before the exchange
    paths = told.groupBy("host", "norm").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("b"))
    paths = paths.withColumn("segs", F.filter(F.split("norm", "/"), lambda s: s != ""))
    leaves = stored(spark, templates(spark, paths, **tree), "templates")
    few = leaves.count() <= BROADCAST_TEMPLATES
    out = rows.join(F.broadcast(leaves) if few else leaves, ["host", "norm"])
    verdict = F.coalesce("rule_verdict", F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
