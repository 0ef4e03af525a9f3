"""Approximate nearest neighbours by multi-index hashing.

``fit`` learns rotations (ITQ) on a bounded sample; the signs of the rotated vector are its binary code, split into
``substrings`` of ``width`` bits, each indexed: a posting per substring value and row. A query probes, in every
substring, the values within ``reach`` bits of its own. By the pigeonhole principle that retrieves every code within Hamming
radius substrings * (reach + 1) - 1 of the query's; all that is retrieved is reranked by double-precision cosine on the
original vectors. The number of substrings, and with it the radius, is learned: the fewest that retrieve the wanted share of
true neighbours on the sample, where neighbours are no nearer than among all rows.

Every row is indexed. Equal vectors are indexed once with their k + 1 smallest ids, which is all any query can
return of them, so a vector that fills a third of the table costs one entry. While the rows fit a few parts (no more than there are
substrings), a part holds rows by a hash with all their postings, and queries go to each part. Beyond, postings are dealt by
substring and leading bits of the value (more bits for more rows; a stretch longer than ``rows_per_part`` is dealt further by a
hash), and a query goes only where its probes lead. Inside a task, probes are looked up in a table from value to postings.
Postings carry their vectors, so candidates are reranked where they are found and only each task's best k + 1 a query leave it:
what is shuffled grows with the rows and the queries, not with their pairs. A query that retrieves fewer than k + 1 vectors
asks again with twice the reach, then of all rows.

Edge cases: null, zero, non-finite or null-holding vectors, and those of another length than most, take no
part; a null vec_id neither; equal scores go to the smaller id; fewer candidates than k are all returned; repeated rows (one id, one
vector) count once; a vec_id with several vectors asks and is a candidate with each, but is never its own; an empty table gives
none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from lattice.llm.memory import released
from lattice.storage import bound_batches, stored

WIDTH, REACH, MOST = 20, 4, 32


class Index:
    """Projection to codes, cut into substrings; ``reach`` bits of each may differ."""

    def __init__(self, projection: np.ndarray, width: int = WIDTH, reach: int = REACH):
        self.projection, self.width, self.reach = projection, width, reach
        self.substrings = projection.shape[1] // width

    @property
    def radius(self) -> int:
        """Every code within this Hamming distance is retrieved."""
        return self.substrings * (self.reach + 1) - 1

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, substrings): the value of each substring of the rows' codes."""
        bits = (x @ self.projection > 0).reshape(len(x), self.substrings, self.width)
        return bits @ (1 << np.arange(self.width, dtype=np.int64)[::-1])

    def retrieved(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """(queries, rows): what probing retrieves; for reports and tests."""
        a, b = self.values(q), self.values(x)
        hit = np.zeros((len(q), len(x)), bool)
        for s in range(self.substrings):
            hit |= np.bitwise_count(a[:, s, None] ^ b[None, :, s]) <= self.reach
        return hit


def _itq(x: np.ndarray, width: int, seed: int, rounds: int = 20) -> np.ndarray:
    """A learned rotation of the leading ``width`` principal directions."""
    directions = np.linalg.svd(x.T @ x)[0][:, :width]
    m = x @ directions
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(m @ r > 0, 1.0, -1.0).T @ m)
        r = (u @ vt).T
    return directions @ r


def fit(sample: np.ndarray, k: int = 5, recall: float = 0.97, width: int = WIDTH, reach: int = REACH, most: int = MOST, probes: int = 500) -> Index:
    """Learn rotations, and how many substrings the sample's neighbours need; ``sample`` is (rows, dimensions)."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    parts = [_itq(x[:5000], x.shape[1], seed) for seed in range(-(-width * most // x.shape[1]))]
    whole = Index(np.hstack(parts)[:, : width * most], width, reach)
    q = x[:probes]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -2
    best = np.argsort(-near, axis=1)[:, : min(k, max(len(x) - 1, 0))]
    values = whole.values(x)
    found, used = np.zeros(best.shape, bool), most
    for s in range(most):
        found |= np.bitwise_count(values[: len(q), s, None] ^ values[best, s]) <= reach
        if best.size and found.mean() >= recall:
            used = s + 1
            break
    return Index(whole.projection[:, : width * used], width, reach)


@cache
def _masks(bits: int, reach: int) -> np.ndarray:
    """All values of ``bits`` bits with at most ``reach`` set."""
    out = [0]
    for n in range(1, min(reach, bits) + 1):
        out += [sum(1 << i for i in c) for c in combinations(range(bits), n)]
    return np.array(out, np.int64)


class _Postings:
    """The rows by the value of one substring: a dense table from value to a stretch of them."""

    def __init__(self, values: np.ndarray, width: int):
        self.order = np.argsort(values, kind="stable")
        names, starts = np.unique(values[self.order], return_index=True)
        self.starts, self.lengths = starts, np.diff(np.r_[starts, len(values)])
        self.table = np.full(1 << width, -1, np.int32)
        self.table[names] = np.arange(len(names))

    def near(self, value: int, masks: np.ndarray) -> np.ndarray:
        at = self.table[masks ^ value]
        at = at[at >= 0]
        n = self.lengths[at]
        return self.order[np.repeat(self.starts[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(at) else at


def search_part(asked: np.ndarray, q: np.ndarray, values: np.ndarray, x: np.ndarray, first: np.ndarray, k: int, width: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row, cosine) of each query's best k among the rows that its probes reach in some column of values."""
    indexes = [_Postings(v, width) for v in values.T] if reach < width else []
    masks, every = _masks(width, min(reach, width - 1)) if indexes else None, np.arange(len(x))
    qn, xn = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    rows, found, scores = [], [], []
    hit = np.zeros(len(x), bool)
    for i in range(len(q)):
        near = every
        if indexes:
            hit[:] = False
            for postings, value in zip(indexes, asked[i].tolist(), strict=True):
                hit[postings.near(value, masks)] = True
            near = np.flatnonzero(hit)
        if not len(near):
            continue
        score = np.einsum("ij,j->i", x[near], q[i]) / (qn[i] * xn[near])
        if len(near) > 4 * k:
            keep = score >= np.partition(score, -k)[-k]
            near, score = near[keep], score[keep]
        best = np.lexsort((first[near], -score))[:k]
        rows.append(np.full(len(best), i))
        found.append(near[best])
        scores.append(score[best])
    if not rows:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _coded(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = index.value.values(_matrix(pa.chunked_array([batch.column("embedding")]))).astype(np.int32)
                codes = pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), values.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, codes], names=[*batch.schema.names, "values"])

    return released(run)


def _meet(k: int, width: int, reach: int):
    out = pa.schema([("ha", pa.int64()), ("hb", pa.int64()), ("xa", pa.int64()), ("xb", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        ids = right.column("ids").combine_chunks()
        first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        numbers = lambda table: _matrix(table.column("values")).astype(np.int64)
        i, j, score = search_part(numbers(left), _matrix(left.column("embedding")), numbers(right), _matrix(right.column("embedding")), first, k, width, reach)
        of = lambda table, name, at: table.column(name).combine_chunks().take(pa.array(at))
        return pa.table([of(left, "ha", i), of(left, "hb", i), of(right, "ha", j), of(right, "hb", j), pa.array(score), ids.take(pa.array(j))], schema=out)

    return run


class _Search:
    def __init__(self, spark: SparkSession, classes: DataFrame, index: Index, k: int, rows_per_part: int, kind: str):
        self.spark, self.k, self.index, self.rows_per_part, self.kind = spark, k, index, rows_per_part, kind
        self.shared = spark.sparkContext.broadcast(index)
        self.classes = self.coded(classes, "classes", "ids array<long>, ")
        parts = -(-self.classes.count() // rows_per_part)
        #: Leading bits of a value that a task holds, so many that a stretch of evenly spread codes fits; 0: rows by a hash.
        self.lead = 0 if parts <= index.substrings else min(index.width, parts.bit_length())

    def coded(self, rows: DataFrame, name: str, more: str = "") -> DataFrame:
        return stored(self.spark, rows.mapInArrow(_coded(self.shared), f"ha long, hb long, {more}embedding array<{self.kind}>, values array<int>"), name)

    def dealt(self, rows: DataFrame, reach: int, masks: np.ndarray | None, *more: str) -> DataFrame:
        """The rows with the substring and leading bits that they go to, and the values that count there."""
        own = ["ha", "hb", "embedding", *more]
        if reach == self.index.width:  # all rows come with any substring
            return rows.select(*own, F.lit(0).alias("sub"), F.lit(0).alias("head"), F.slice("values", 1, 1).alias("values"))
        if not self.lead:
            return rows.select(*own, F.lit(0).alias("sub"), F.lit(0).alias("head"), "values")
        rows = rows.select(*own, F.posexplode("values").alias("sub", "value"))
        head = F.shiftright("value", self.index.width - self.lead)
        if masks is not None:
            head = F.explode(F.transform(F.array(*(F.lit(int(m)) for m in masks)), lambda m: head.bitwiseXOR(m)))
        return rows.select(*own, "sub", F.array("value").alias("values"), head.alias("head"))

    def found(self, asked: DataFrame, reach: int) -> DataFrame:
        """(ha, hb, xa, xb, score, ids) of each query class: every task's best k."""
        points, asks = self.dealt(self.classes, reach, None, "ids"), self.dealt(asked, reach, _masks(self.lead, reach))
        size = F.ceil(F.count(F.lit(1)) / self.rows_per_part).cast("int")
        sizes = points.groupBy("sub", "head").agg(size.alias("parts")).join(asks.groupBy("sub", "head").agg(size.alias("turns")), ["sub", "head"])
        sizes = stored(self.spark, sizes, "sizes")  # a row for each stretch
        spot = lambda n: F.pmod(F.xxhash64("ha", "hb"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        points = points.join(sizes, ["sub", "head"]).withColumn("part", spot("parts")).withColumn("turn", every("turns"))
        asks = asks.join(sizes, ["sub", "head"]).withColumn("turn", spot("turns")).withColumn("part", every("parts"))
        here = ["sub", "head", "part", "turn"]
        there = [F.col(c).alias(c[0] + "_") for c in here]
        a = asks.select("ha", "hb", "embedding", "values", *here).groupBy(*here)
        b = points.select("ha", "hb", "ids", "embedding", "values", *there).groupBy("s_", "h_", "p_", "t_")
        found = a.cogroup(b).applyInArrow(_meet(self.k, self.index.width, reach), "ha long, hb long, xa long, xb long, score double, ids array<long>")
        return found.dropDuplicates(["ha", "hb", "xa", "xb"])

    def run(self, asked: DataFrame) -> DataFrame:
        """(ha, hb, score, ids) of all that each query class needs."""
        asked, out = self.coded(asked, "asked"), None
        reaches = [self.index.reach, min(2 * self.index.reach, self.index.width), self.index.width]
        for reach in reaches:
            found = stored(self.spark, self.found(asked, reach), "found")
            enough = found.groupBy("ha", "hb").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.k)
            if reach == reaches[-1]:
                out = found if out is None else out.union(found)
                break
            good = found.join(enough.select("ha", "hb"), ["ha", "hb"], "left_semi")
            out = good if out is None else out.union(good)
            asked = stored(self.spark, asked.join(enough, ["ha", "hb"], "left_anti"), "asked")
            if asked.isEmpty():
                break
        return out.select("ha", "hb", "score", "ids")


def search(spark: SparkSession, vectors: DataFrame, is_query, k: int = 5, sample_rows: int = 20_000, rows_per_part: int = 16_384, **fitting) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows that the index finds.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. The index is fitted on at most
    ``sample_rows`` rows, taken by a hash of the id; all rows are indexed.
    """
    bound_batches(spark)
    usable = F.exists("embedding", lambda v: v != 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kind = "float" if vectors.schema["embedding"].dataType.elementType == FloatType() else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable)
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    # a vector is named by two hashes, so that no exchange is keyed by whole vectors
    rows = rows.where(F.size("embedding") == size["d"]).withColumns({"ha": F.xxhash64("embedding"), "hb": F.xxhash64(F.lit(1), "embedding")})
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").collect()])
    index = fit(sample, k=k, **fitting)
    # equal vectors once, with the ids that any query can need
    by_vector = Window.partitionBy("ha", "hb").orderBy("vec_id")
    ids = rows.select("ha", "hb", "vec_id").distinct().withColumn("_r", F.row_number().over(by_vector)).where(F.col("_r") <= k + 1)
    ids = ids.groupBy("ha", "hb").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = rows.groupBy("ha", "hb").agg(F.first("embedding").alias("embedding")).join(ids, ["ha", "hb"]).select("ha", "hb", "ids", "embedding")
    queries = rows.where(is_query)
    asked = queries.groupBy("ha", "hb").agg(F.first("embedding").alias("embedding"))
    found = _Search(spark, classes, index, k + 1, rows_per_part, kind).run(asked)
    best = Window.partitionBy("ha", "hb").orderBy(F.desc("score"), F.col("ids")[0])
    lists = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).select("ha", "hb", "score", F.explode("ids").alias("vec_id"))
    nearest = Window.partitionBy("ha", "hb").orderBy(F.desc("score"), "vec_id")
    lists = lists.withColumn("_r", F.row_number().over(nearest))
    lists = lists.groupBy("ha", "hb").agg(F.sort_array(F.collect_list(F.struct("_r", "score", "vec_id"))).alias("found"))
    per_query = queries.select(F.col("vec_id").alias("query_id"), "ha", "hb").distinct().join(lists, ["ha", "hb"])
    others = F.slice(F.filter("found", lambda f: f.vec_id != F.col("query_id")), 1, k)
    return per_query.select("query_id", F.posexplode(others).alias("_p", "_f")).select("query_id", (F.col("_p") + 1).alias("rank"), F.col("_f.vec_id").alias("vec_id"), F.col("_f.score").alias("score"))
