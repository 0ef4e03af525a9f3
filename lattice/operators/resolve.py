"""Reference resolution across files: imports, bare names, proximity, class closures, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.functions import predicates as P
from lattice.storage import discard, stored


def unique_index(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys -> the value, where exactly one value has them."""
    return rows.groupBy(*keys).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n")).where("_n = 1").drop("_n")


def import_guided(calls: DataFrame, imports: DataFrame, symbols: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Calls of imported names: (caller, target).

    calls: caller, callee, file; imports: file, local_name, imported_name, module_stem; symbols: id, name, module_stem.
    """
    index = unique_index(symbols.withColumn("name", F.lower("name")), ["module_stem", "name"], "id")
    named = calls.select("caller", "callee", "file").distinct().join(imports.withColumnRenamed("local_name", "callee").distinct(), ["file", "callee"])
    out = named.withColumn("name", F.lower("imported_name")).join(index, ["module_stem", "name"]).select("caller", F.col("id").alias("target")).where("caller != target").distinct()
    if edges is None:
        return out
    there = edges.where("relation = 'calls'").select(F.col("source").alias("caller"), "target")
    return out.join(there, ["caller", "target"], "left_anti")


def nearest_candidate(pairs: DataFrame, call: str = "call_id") -> DataFrame:
    """One target per call, or none: test files yield to others, then same file, same directory, longest shared path.

    pairs: call_id, call_file, target, target_file. A tier that two candidates share decides nothing.
    """
    rows = pairs.withColumns({"_ct": P.is_test_path(F.col("call_file")), "_tt": P.is_test_path(F.col("target_file"))})
    group = Window.partitionBy(call)
    rows = rows.withColumns({"_tests": F.max("_tt").over(group), "_plain": F.max(~F.col("_tt")).over(group)})
    rows = rows.where("CASE WHEN _ct THEN _tt OR NOT _tests ELSE NOT _tt OR NOT _plain END AND (_ct OR NOT _tt)")
    rows = rows.withColumn("_many", F.count(F.lit(1)).over(group))
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    same_dir = folder(F.col("call_file")) == folder(F.col("target_file"))
    near = P.common_prefix_parts(F.regexp_replace(folder(F.col("call_file")), "/$", ""), F.regexp_replace(folder(F.col("target_file")), "/$", ""))
    tier = F.when(F.col("call_file") == F.col("target_file"), 1000).when(same_dir, 999).otherwise(near)
    rows = rows.withColumn("_tier", F.when(F.col("_many") == 1, 2000).otherwise(tier))
    rows = rows.withColumn("_best", F.max("_tier").over(group)).where("_tier = _best AND _tier > 0")
    return rows.withColumn("_n", F.count(F.lit(1)).over(group)).where("_n = 1").select(call, "target")


def _folder(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def _prefixes(folder):
    """The folder's leading paths, longest last; none for the root."""
    parts = F.split(folder, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.when(folder != "", every).otherwise(F.array().cast("array<string>"))


def bare_name(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls by name alone: call_id, target, as ``nearest_candidate`` would decide among all symbols of the name.

    Candidates are never listed: symbols are counted by name and file, folder, and each leading path, and the
    distinct (name, file) of the calls look up those counts, so a name that a third of all symbols share costs no more
    than others. calls: call_id, callee, call_file; symbols: id, name, file.
    """
    every = symbols.select(F.lower("name").alias("name"), F.col("id").alias("target"), F.col("file").alias("f")).distinct()
    every = every.select("name", "target", "f", _folder(F.col("f")).alias("d"), P.is_test_path(F.col("f")).alias("pool"))
    one = lambda rows, *keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("t")).select(*keys, F.struct("n", "t").alias("hit"))
    asks = calls.select(F.lower("callee").alias("name"), F.col("call_file").alias("f")).distinct()
    pools = one(every, "name", "pool").groupBy("name").pivot("pool", [False, True]).agg(F.first("hit")).withColumnsRenamed({"false": "plain", "true": "tests"})
    asks = asks.join(pools, "name").withColumn("pool", P.is_test_path(F.col("f")) & F.col("tests").isNotNull())
    asks = asks.withColumn("all", F.when(F.col("pool"), F.col("tests")).otherwise(F.col("plain"))).where("all IS NOT NULL")
    asks = asks.select("name", "f", "pool", "all", _folder(F.col("f")).alias("d"))
    open_ = asks.join(one(every, "name", "pool", "f").withColumnRenamed("hit", "same"), ["name", "pool", "f"], "left")
    open_ = open_.join(one(every, "name", "pool", "d").withColumnRenamed("hit", "beside"), ["name", "pool", "d"], "left")
    above = one(every.withColumn("p", F.explode(_prefixes(F.col("d")))), "name", "pool", "p")
    near = asks.select("name", "pool", "f", F.posexplode(_prefixes(F.col("d"))).alias("k", "p")).join(above, ["name", "pool", "p"])
    near = near.groupBy("name", "f").agg(F.max_by("hit", "k").alias("near"))
    open_ = open_.join(near, ["name", "f"], "left")
    hit = F.when(F.col("all.n") == 1, F.col("all")).otherwise(F.coalesce("same", "beside", "near"))
    found = open_.select("name", F.col("f").alias("call_file"), hit.alias("hit")).where("hit.n = 1").select("name", "call_file", F.col("hit.t").alias("target"))
    return calls.withColumn("name", F.lower("callee")).join(found, ["name", "call_file"]).select("call_id", "target")


def member_calls(calls: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls with a receiver type: the class unique by label, then its method: call_id, target."""
    types = unique_index(classes, ["label"], "id").withColumnsRenamed({"label": "receiver_type", "id": "class_id"})
    own = unique_index(methods, ["class_id", "name"], "id")
    return calls.join(types, "receiver_type").withColumnRenamed("callee", "name").join(own, ["class_id", "name"]).select("call_id", F.col("id").alias("target"))


def sourced_calls(sources: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Shell scripts: calls of functions in directly sourced files: caller, target."""
    there = sources.join(functions.select(F.col("file").alias("sourced"), F.col("name").alias("callee"), F.col("id").alias("target")), "sourced")
    found = calls.join(there, ["file", "callee"])
    return unique_index(found.select("caller", "callee", "file", "target"), ["caller", "callee", "file"], "target").select("caller", "target")


def alias_targets(aliases: DataFrame, names: DataFrame, hops: int = 8) -> DataFrame:
    """names (file, name) with the name that their alias chain ends at; at most ``hops`` steps, a fixed point stops."""
    table = aliases.select("file", F.col("name").alias("_at"), F.col("target").alias("_next")).dropDuplicates(["file", "_at"])
    out = names.withColumn("resolved", F.col("name"))
    for _ in range(hops):
        out = out.withColumn("_at", F.col("resolved")).join(table, ["file", "_at"], "left").withColumn("resolved", F.coalesce("_next", "resolved")).drop("_at", "_next")
    return out


def best_tiers(calls: DataFrame, symbols: DataFrame, imports: DataFrame, builtins: tuple[str, ...] = ()) -> DataFrame:
    """Each call's best tier: call_id, callee, confidence, n_targets, targets.

    Own file, then imported files (EXTRACTED); a builtin stops; then one global match (INFERRED) or all of several
    (AMBIGUOUS), which stay a class: ``targets`` is null and the callee names them. Tiers depend on (file, callee) only,
    so they are decided once per such pair. calls: call_id, file, callee; symbols: id, file, name; imports: file, name, from_file.
    """
    local = unique_index(symbols, ["file", "name"], "id")
    asks = calls.select("file", F.col("callee").alias("name")).distinct()
    own = asks.join(local, ["file", "name"]).select("file", "name", F.array("id").alias("own"))
    seen = asks.join(imports.select("file", "name", "from_file").distinct(), ["file", "name"])
    seen = seen.join(local.select(F.col("file").alias("from_file"), "name", "id"), ["from_file", "name"]).groupBy("file", "name").agg(F.sort_array(F.collect_set("id")).alias("seen"))
    named = symbols.groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("one"), F.count(F.lit(1)).alias("rows"))
    rows = asks.join(own, ["file", "name"], "left").join(seen, ["file", "name"], "left").join(named, "name", "left")
    sure, stop, single = F.coalesce("own", "seen"), F.col("name").isin(*builtins), F.col("rows") == 1
    confidence = F.when(sure.isNotNull(), "EXTRACTED").when(stop, F.lit(None)).when(single, "INFERRED").when(F.col("rows") > 1, "AMBIGUOUS")
    targets = F.when(sure.isNotNull(), sure).when(single, F.array("one"))
    rows = rows.select("file", F.col("name").alias("callee"), confidence.alias("confidence"), F.coalesce(F.size(targets), F.col("n")).cast("long").alias("n_targets"), targets.alias("targets"))
    return calls.join(rows.where("confidence IS NOT NULL"), ["file", "callee"]).select("call_id", "callee", "confidence", "n_targets", "targets")


def call_tiers(calls: DataFrame, symbols: DataFrame, imports: DataFrame, builtins: tuple[str, ...] = ()) -> DataFrame:
    """Every target of each call's best tier: call_id, target, confidence; a row for each of several equal names."""
    best = best_tiers(calls, symbols, imports, builtins)
    known = best.where("targets IS NOT NULL").select("call_id", F.explode("targets").alias("target"), "confidence")
    open_ = best.where("targets IS NULL").join(symbols.select(F.col("name").alias("callee"), F.col("id").alias("target")).distinct(), "callee")
    return known.unionByName(open_.select("call_id", "target", "confidence")).distinct()


def class_closure(inherits: DataFrame, classes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(class_id, ancestor, depth), the class itself at depth 0; the smallest depth counts.

    Walks until a level adds nothing, or to ``max_depth`` where a caller asks for that; visited pairs are not walked
    again, so cycles end.
    """
    spark = classes.sparkSession
    bases = inherits.select(F.col("class_id").alias("ancestor"), "base_id").where("base_id IS NOT NULL")
    seen, k = stored(spark, classes.select("class_id", F.col("class_id").alias("ancestor"), F.lit(0).alias("depth")).distinct(), "closure"), 0
    while max_depth is None or k < max_depth:
        front = seen.where(F.col("depth") == k).drop("depth")
        step = front.join(bases, "ancestor").select("class_id", F.col("base_id").alias("ancestor")).distinct()
        found = stored(spark, step.join(seen.select("class_id", "ancestor"), ["class_id", "ancestor"], "left_anti").withColumn("depth", F.lit(k + 1)), "level")
        if not found.limit(1).count():
            discard(spark, found)
            break
        before, seen, k = seen, stored(spark, seen.unionByName(found), "closure"), k + 1
        discard(spark, before, found)
    return seen


def dispatch(closure: DataFrame, methods: DataFrame) -> DataFrame:
    """(class_id, name, target): the nearest definition up the class closure."""
    rows = closure.join(methods.select(F.col("class_id").alias("ancestor"), "name", F.col("id").alias("target")), "ancestor")
    return rows.groupBy("class_id", "name").agg(F.min_by("target", F.struct("depth", "target")).alias("target"))


def scope_lookup(scopes: DataFrame, bindings: DataFrame, uses: DataFrame, max_depth: int | None = None) -> DataFrame:
    """uses (use_id, scope, name) with the value bound in the nearest enclosing scope."""
    chain = class_closure(scopes.select(F.col("scope").alias("class_id"), F.col("parent").alias("base_id")), scopes.select(F.col("scope").alias("class_id")), max_depth)
    asks = uses.select("scope", "name").distinct()
    near = asks.join(chain.toDF("scope", "at", "depth"), "scope").join(bindings.select(F.col("scope").alias("at"), "name", "value"), ["at", "name"])
    near = near.groupBy("scope", "name").agg(F.min_by("value", F.struct("depth", "value")).alias("value"))
    return uses.join(near, ["scope", "name"]).groupBy("use_id").agg(F.min("value").alias("value"))


def files_to_nodes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Changed paths to nodes by path suffix, either way round, on whole parts: an equi-join on the file name first."""
    a = files.select("path", P.basename(F.col("path")).alias("base"))
    b = nodes.select("id", "community", "source_file", P.basename(F.col("source_file")).alias("base"))
    fits = (F.col("path") == F.col("source_file")) | F.endswith("path", F.concat(F.lit("/"), F.col("source_file"))) | F.endswith("source_file", F.concat(F.lit("/"), F.col("path")))
    return a.join(b, "base").where(fits).select("path", "id", "community")


def impact_of(files: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Per change: communities touched and nodes affected."""
    hits = files_to_nodes(files, nodes).join(files.select("path", key).distinct(), "path")
    return hits.groupBy(key).agg(F.count_distinct("community").alias("communities_touched"), F.count_distinct("id").alias("nodes_affected"))


def merge_externals(nodes: DataFrame) -> DataFrame:
    """(id, winner): nodes without a source file are one per label."""
    out = nodes.where("coalesce(source_file, '') = ''").select("id", "label")
    best = out.groupBy("label").agg(F.min("id").alias("winner"))
    return out.join(best, "label").where("id != winner").select("id", "winner")


def citations(cited: DataFrame, nodes: DataFrame) -> DataFrame:
    """cited (ref) to node ids: by id, else by a label that one node has."""
    by_label = unique_index(nodes, ["label"], "id").select(F.col("label").alias("ref"), F.col("id").alias("_l"))
    by_id = nodes.select(F.col("id").alias("ref"), F.col("id").alias("_i")).distinct()
    return cited.join(by_id, "ref", "left").join(by_label, "ref", "left").select("ref", F.coalesce("_i", "_l").alias("id"))
