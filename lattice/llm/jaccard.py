"""N-gram Jaccard join by count-vector R-trees.

A document's word shingles are hashed to 64 bits; equal sets form one class. Each class is a point: its shingles
are hashed into ``GROUPS`` groups and counted. For two points the sum over groups of the smaller count bounds
the overlap from above, and a tree node's corner (largest counts, size range) bounds it for all points below,
so a subtree is left where even its corner cannot reach the overlap that the threshold needs.

In a hundred dimensions one tree over a whole corpus prunes nothing near its root, so the root fans out by
content: two sets at Jaccard t share one of their n - ceil(t n) + 1 first shingles in any common order. The order
is by corpus-wide counts of hashed groups, rare ones first, so that passages which thousands of documents share
route almost nothing. Routes hold R-trees; nothing is sampled or capped.

Groups of near copies are settled before trees meet them: twice, each route's members are compared with one leader,
links are verified on the sets, and components found. Trees then find the points whose bounds let them link with one of
another component; only these points' sets are sent, to tasks that verify and join components as they go, so a task
returns fewer links than it has points.
Groups longer than ``MAX_ROUTE`` members or ``MAX_SHINGLES`` are cut into parts, each a tree; only what is then outside the
group's largest component meets the other parts. Memory per task is bounded by these constants; a group of M texts
of which no two link, though all bounds allow it, still costs the exact join M * M comparisons, but never as many rows.

Edge cases: text null, empty or all white space: empty set, linked with nothing; fewer than ``words`` words: the whole
sequence is the one shingle; repeated rows and repeated doc_ids are linked as equal sets; a null doc_id takes part and
is never a component's name unless all its ids are null; an empty table gives none; only doc_id and text are read.
Two different shingles, or sets, are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from lattice.llm.columns import spare
from lattice.operators.components import connected_components
from lattice.llm.memory import released
from lattice.storage import bound_batches, discard, stored

#: Groups of a set of up to ``BASE_SIZE`` shingles; four times as many for each further factor of four, so that
#: a group holds one to four shingles and the bound stays sharp for long texts.
GROUPS, BASE_SIZE = 256, 1024
FULL = np.iinfo(np.uint8).max
ORDER_BITS, CHUNK = 18, 4096
LEAF, FANOUT = 32, 16
MAX_ROUTE, MAX_SHINGLES = 4096, 2_000_000
PAIRS_PER_BLOCK = 1024
BROADCAST_TOKENS = 500_000
MIN_FILTER_BITS, MAX_FILTER_BITS = 1 << 16, 1 << 28
_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of A-Z-lowered words cut at ASCII white space."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    span = min(words, len(w))
    n = len(w) - span + 1
    v = a[:n].copy()
    for i in range(1, span):
        v *= _MUL
        v += a[i : i + n]
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v += np.uint64(span)
    v ^= v >> np.uint64(32)
    return np.unique(v)


def groups_of(n: int) -> int:
    groups = GROUPS
    while n > BASE_SIZE * (groups // GROUPS):
        groups *= 4
    return groups


def count_vector(v: np.ndarray) -> np.ndarray:
    """Counts by group, from high bits; a full count stands for any larger one."""
    groups = groups_of(len(v))
    shift = np.uint64(64 - groups.bit_length() + 1)
    return np.minimum(np.bincount((v >> shift).astype(np.int64), minlength=groups), FULL).astype(np.uint8)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The same points counted in fewer groups; what is full stays full."""
    if counts.shape[-1] == groups:
        return counts
    parts = counts.reshape(*counts.shape[:-1], groups, -1)
    return np.where((parts == FULL).any(-1), FULL, np.minimum(parts.sum(-1, dtype=np.int64), FULL)).astype(np.uint8)


def set_key(v: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(v.tobytes())).view(np.int64))


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap for which 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of coordinate minima; unbounded where both counts are full."""
    low = np.minimum(a, b)
    total = low.sum(axis=-1, dtype=np.int64)
    full = (low == FULL).any(axis=-1)
    return np.where(full, np.iinfo(np.int64).max, total)


class RTree:
    """Sort-tile-recursive packing of points (size, counts) into nodes with corner counts and size range."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        self.sizes, self.counts = sizes, counts
        heaviest = np.argsort(-counts.var(axis=0), kind="stable")[:2]
        order = np.lexsort((counts[:, heaviest[0]], sizes))
        tiles = [order[i : i + LEAF * FANOUT] for i in range(0, len(order), LEAF * FANOUT)]
        order = np.concatenate([t[np.argsort(counts[t, heaviest[1]], kind="stable")] for t in tiles])
        nodes = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        self.leaves = nodes
        self.levels = [self._corners([(counts[x].max(0), sizes[x].min(), sizes[x].max()) for x in nodes])]
        while len(self.levels[-1][0]) > FANOUT:
            top, low, high = self.levels[-1]
            cuts = range(0, len(top), FANOUT)
            self.levels.append(self._corners([(top[i : i + FANOUT].max(0), low[i : i + FANOUT].min(), high[i : i + FANOUT].max()) for i in cuts]))

    @staticmethod
    def _corners(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def _open(self, i: int, level: int, nodes: np.ndarray, percent: int) -> np.ndarray:
        top, low, high = (x[nodes] for x in self.levels[level])
        n = self.sizes[i]
        fits = (100 * high >= percent * n) & (percent * low <= 100 * n)
        fits &= overlap_bound(self.counts[i], top) >= needed(n, np.maximum(low, -(-percent * n // 100)), percent)
        return nodes[fits]

    def near(self, i: int, percent: int) -> np.ndarray:
        """Points whose bound lets them reach the threshold with point i."""
        nodes = self._open(i, -1, np.arange(len(self.levels[-1][0])), percent)
        for level in range(len(self.levels) - 2, -1, -1):
            below = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            nodes = self._open(i, level, below[below < len(self.levels[level][0])], percent)
        if not len(nodes):
            return nodes
        points = np.concatenate([self.leaves[x] for x in nodes])
        n, m = self.sizes[i], self.sizes[points]
        fits = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (overlap_bound(self.counts[i], self.counts[points]) >= needed(n, m, percent))
        return points[fits]


def _texts(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple[list, list]]:
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            yield part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()


def _profile(words: int):
    names = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("chunk", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, sums = np.uint64((1 << ORDER_BITS) - 1), np.zeros(1 << ORDER_BITS, np.int64)
        for ids, texts in _texts(batches):
            sets = [shingle_hashes(t, words) for t in texts]
            if any(map(len, sets)):
                sums += np.bincount((np.concatenate(sets) & mask).astype(np.int64), minlength=len(sums))
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, [set_key(v) for v in sets], [len(v) for v in sets], [count_vector(v).tobytes() for v in sets], none, none, none), names, strict=True)], schema=names)
        parts = [(i, sums[i * CHUNK : (i + 1) * CHUNK]) for i in range(len(sums) // CHUNK)]
        parts = [(i, s.tobytes()) for i, s in parts if s.any()]
        none = [None] * len(parts)
        place = [TaskContext.get().partitionId() % 64] * len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((none, none, none, none, [p[0] for p in parts], place, [p[1] for p in parts]), names, strict=True)], schema=names)

    return released(run)


def _sum_parts(table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for s in table.column("sums").to_pylist():
        total += np.frombuffer(s, np.int64)
    return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def _group_counts(profile: DataFrame) -> np.ndarray:
    """Corpus-wide counts of hashed shingle groups: a fixed 2 MB, summed in two steps."""
    rows = profile.where("chunk IS NOT NULL").select("chunk", "part", "sums")
    schema = "chunk int, part int, sums binary"
    rows = rows.groupBy("chunk", "part").applyInArrow(_sum_parts, schema).groupBy("chunk").applyInArrow(_sum_parts, schema)
    out = np.zeros(1 << ORDER_BITS, np.int64)
    for chunk, _, sums in rows.collect():
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(sums, np.int64)
    return out


def _place(doc_id, bits: int):
    return F.pmod(doc_id.bitwiseXOR(F.shiftrightunsigned(doc_id, 21)), F.lit(bits))


def _id_filter(ids: DataFrame, rows: int) -> np.ndarray:
    """A bitmap of doc_ids, of bounded size: what it lets through is a superset."""
    bits = min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, 1 << (16 * max(rows, 1) - 1).bit_length()))
    spot = ids.where("doc_id IS NOT NULL").select((_place(F.col("doc_id"), bits) + 1).alias("b"))
    maps = spot.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for k, m in maps.collect():
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(m, np.uint8)[: len(out) - (k - 1) * 4096]
    return out


def _passes(bitmap: np.ndarray, ids: list) -> list[bool]:
    v = np.array([0 if i is None else i for i in ids], np.int64)
    at = (v ^ (v.view(np.uint64) >> np.uint64(21)).view(np.int64)) % (8 * len(bitmap))
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) | np.array([i is None for i in ids])).tolist()


def _postings(words: int, percent: int, counts, bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << ORDER_BITS) - 1)
        for ids, texts in _texts(batches):
            tokens, keys = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for passes, t in zip(_passes(bitmap.value, ids), texts, strict=True):
                v = shingle_hashes(t, words) if passes else ()
                if len(v):
                    rare = np.argsort(counts.value[(v & mask).astype(np.int64)], kind="stable")
                    tokens.append(v[rare[: len(v) - -(-percent * len(v) // 100) + 1]])
                    keys.append(np.full(len(tokens[-1]), set_key(v)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys))], names=["token", "key"])

    return released(run)


def _sets(words: int, bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            sets = [(d, shingle_hashes(t, words)) for passes, d, t in zip(_passes(bitmap.value, ids), ids, texts, strict=True) if passes]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in sets], pa.int64()), pa.array([set_key(v) for _, v in sets], pa.int64()), pa.array([v.tobytes() for _, v in sets], pa.binary())], names=["doc_id", "key", "shingles"])

    return released(run)


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            shapes: dict[tuple[int, int], list[int]] = {}
            for i in np.flatnonzero(fits).tolist():
                shapes.setdefault((len(left[i]), len(right[i])), []).append(i)
            for (x, y), rows in shapes.items():
                for k in range(0, len(rows), 1024):
                    at = rows[k : k + 1024]
                    a = folded(np.frombuffer(b"".join(left[i] for i in at), np.uint8).reshape(-1, x), min(x, y))
                    b = folded(np.frombuffer(b"".join(right[i] for i in at), np.uint8).reshape(-1, y), min(x, y))
                    fits[at] = overlap_bound(a, b) >= needed(n[at], m[at], percent)
            yield batch.select([0, 1]).filter(pa.array(fits))

    return released(run)


def near_points(sizes: np.ndarray, counts: list[np.ndarray], percent: int, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(point, points that its bounds let it link with); every such pair with an ``own`` point comes at least once.

    A tree for each number of groups holds the points that have its groups and the larger ones that can link with one of them.
    """
    groups = np.array([len(c) for c in counts])
    for g in np.unique(groups).tolist():
        rows = np.flatnonzero((groups == g) | ((groups > g) & (percent * sizes <= 100 * sizes[groups == g].max())))
        tree = RTree(sizes[rows], np.stack([folded(counts[i], g) for i in rows]))
        for i in np.flatnonzero(groups[rows] == g if own.all() else own[rows]).tolist():
            yield rows[i], rows[tree.near(i, percent)]


def survivors(comp: np.ndarray, sizes: np.ndarray, counts: list[np.ndarray], percent: int, own: np.ndarray) -> np.ndarray:
    """Which points the bounds let link with one of another component."""
    out = np.zeros(len(sizes), bool)
    for x, near in near_points(sizes, counts, percent, own):
        near = near[(comp[near] != comp[x]) & (own[near] | own[x])]
        out[near] = True
        out[x] |= len(near) > 0
    return out


def spanning_links(key: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int, own: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join the points' components as far as any link does: fewer than there are points.

    What a point's bounds leave over, outside its component, is counted on the whole sets at once; each component that it
    links with is joined there and then, so later points skip it. Links count where an end is ``own``.
    """
    a, b = [], []
    root = np.unique(comp, return_inverse=True)[1]
    sizes = np.array([len(v) for v in sets])
    ends = np.r_[0, np.cumsum(sizes)]
    names, places = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.zeros(len(names), bool)
    for x, near in near_points(sizes, [count_vector(v) for v in sets], percent, own):
        near = near[(root[near] != root[x]) & (own[near] | own[x])]
        if not len(near):
            continue
        mine[places[ends[x] : ends[x + 1]]] = True
        n = sizes[near]
        starts = np.r_[0, np.cumsum(n)[:-1]]
        both = np.add.reduceat(mine[places[np.repeat(ends[near] - starts, n) + np.arange(n.sum())]], starts, dtype=np.int64)
        for y in near[100 * both >= percent * (sizes[x] + n - both)].tolist():
            if root[y] != root[x]:
                a.append(min(key[x], key[y]))
                b.append(max(key[x], key[y]))
                root[root == root[y]] = root[x]
        mine[places[ends[x] : ends[x + 1]]] = False
        if (root == root[x]).all():
            break
    return a, b


def _survivors(percent: int):
    names = pa.schema([("low", pa.int64()), ("unit", pa.int64()), ("key", pa.int64()), ("comp", pa.int64()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                points = batch.column(2).slice(i, 1).flatten()
                comp, sizes, own = (points.field(k).to_numpy(zero_copy_only=False) for k in ("comp", "n", "own"))
                left = survivors(comp, sizes, [np.frombuffer(c, np.uint8) for c in points.field("counts").to_pylist()], percent, own.astype(bool))
                if left.any():
                    low, unit = (pa.array([batch.column(k)[i].as_py()] * int(left.sum()), pa.int64()) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([low, unit, *(points.field(k).filter(pa.array(left)) for k in ("key", "comp", "own"))], schema=names)

    return released(run)


def _spanning_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                points = batch.column(0).slice(i, 1).flatten()
                key, comp, own = (points.field(k).to_numpy(zero_copy_only=False) for k in ("key", "comp", "own"))
                sets = [np.frombuffer(v, np.uint64) for v in points.field("shingles").to_pylist()]
                a, b = spanning_links(key, comp, sets, percent, own.astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return released(run)


def _exact(percent: int):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = dict(zip(sets.column("key").to_pylist(), sets.column("shingles").to_pylist(), strict=True))
        a, b = [], []
        for x, y in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            u, v = np.frombuffer(held[x], np.uint64), np.frombuffer(held[y], np.uint64)
            both = len(u) + len(v) - len(np.union1d(u, v))
            if 100 * both >= percent * (len(u) + len(v) - both):
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


class _Join:
    def __init__(self, spark: SparkSession, docs: DataFrame, percent: int, words: int):
        self.spark, self.percent, self.words = spark, percent, words
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.spent: list[DataFrame] = []

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """A stored table that nothing needs once the components are known."""
        self.spent.append(stored(self.spark, df, name))
        return self.spent[-1]

    def profile(self) -> None:
        schema = "doc_id long, key long, n long, counts binary, chunk int, part int, sums binary"
        self.rows = stored(self.spark, self.docs.mapInArrow(_profile(self.words), schema), "profile")
        found = self.rows.where("chunk IS NULL AND n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("counts").alias("counts"))
        self.classes = stored(self.spark, found, "classes")
        self.n_classes = self.classes.count()

    def routes(self) -> None:
        """What routes hold: pairs of those with two classes, and token, key, lowest and highest key of longer ones."""
        context = self.spark.sparkContext
        counts = context.broadcast(_group_counts(self.rows))
        bitmap = context.broadcast(_id_filter(self.classes, self.n_classes))
        postings = stored(self.spark, self.docs.mapInArrow(_postings(self.words, self.percent, counts, bitmap), "token long, key long"), "postings")
        shared = postings.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
        shared = self.kept(shared, "shared_tokens")
        # a route of two is its one pair; only longer routes need their members
        self.couples = shared.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
        longer = shared.where("n > 2").select("token", "low", "high")
        longer = F.broadcast(longer) if longer.count() <= BROADCAST_TOKENS else longer
        self.members = self.kept(postings.join(longer, "token"), "routes")
        discard(self.spark, postings)

    def with_points(self, pairs: DataFrame) -> DataFrame:
        one = self.classes.select(F.col("key").alias("a"), F.col("n").alias("n"), F.col("counts").alias("u"))
        two = self.classes.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("counts").alias("v"))
        wide = pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "u", "v")
        return wide.mapInArrow(_bounded(self.percent), "a long, b long")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (stored, distinct) that link, by their whole sets."""
        involved = self.kept(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(self.classes.select("key", "doc_id"), "key"), "involved")
        rows = involved.count()
        if not rows:
            return pairs
        bitmap = self.spark.sparkContext.broadcast(_id_filter(involved, rows))
        sets = self.docs.mapInArrow(_sets(self.words, bitmap), "doc_id long, key long, shingles binary").withColumnRenamed("doc_id", "id")
        # a pair goes where its busier end is; an end busy enough to fill a block is split over several
        ends = pairs.select(F.col("a").alias("key")).unionAll(pairs.select("b")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        busy = pairs.join(ends.toDF("a", "n_a"), "a").join(ends.toDF("b", "n_b"), "b")
        first = F.col("n_a") >= F.col("n_b")
        spots = busy.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), F.greatest("n_a", "n_b").alias("n"))
        spots = spots.select("a", "b", "hub", "other", F.pmod(F.xxhash64("hub"), F.lit(-(-pairs.count() // PAIRS_PER_BLOCK))).alias("p"), F.pmod(F.xxhash64("other"), F.ceil(F.col("n") / PAIRS_PER_BLOCK)).alias("q"))
        wanted = spots.select("p", "q", F.col("hub").alias("key")).union(spots.select("p", "q", "other")).distinct()
        wanted = wanted.join(involved, "key")
        there = wanted.join(sets, "key").where("id <=> doc_id").select(F.col("p").alias("p_"), F.col("q").alias("q_"), "key", "shingles")
        return spots.select("p", "q", "a", "b").groupBy("p", "q").cogroup(there.groupBy("p_", "q_")).applyInArrow(_exact(self.percent), "a long, b long")

    def components(self, links: DataFrame) -> DataFrame:
        return connected_components(self.spark, links, "a", "b").select(F.col("node").alias("key"), F.col("component").alias("comp"))

    def located(self, components: DataFrame | None) -> DataFrame:
        if components is None:
            return self.members.withColumn("comp", F.col("key"))
        return self.members.join(components, "key", "left").withColumn("comp", F.coalesce("comp", "key"))

    def star(self, leader: str, components: DataFrame | None) -> DataFrame:
        """Each member with its route's leader, where their components differ."""
        places = self.located(components)
        if components is not None:
            heads = components.select(F.col("key").alias(leader), F.col("comp").alias("head"))
            places = places.join(heads, leader, "left").withColumn("head", F.coalesce("head", leader)).where("comp != head")
        pairs = places.where(f"key != {leader}").select(F.least("key", leader).alias("a"), F.greatest("key", leader).alias("b"))
        return (pairs.unionAll(self.couples) if components is None else pairs).distinct()

    def open_places(self, components: DataFrame) -> DataFrame:
        """(low, key, comp, n) in routes that still hold two components.

        Routes with the same lowest key hold much the same members (copies share most first shingles), so they
        are one group: the union of their members.
        """
        places = self.located(components)
        open_ = places.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token")
        open_ = self.kept(open_, "open")
        open_ = F.broadcast(open_) if open_.count() <= BROADCAST_TOKENS else open_
        places = places.join(open_, "token", "left_semi").select("low", "key", "comp").distinct()
        return places.join(self.classes.select("key", "n"), "key")

    def tree_links(self, units: DataFrame) -> DataFrame:
        """Verified links within each (low, unit) of (low, unit, key, comp, own); sets go only where bounds leave a pair over."""
        points = units.join(self.classes.select("key", "n", "counts"), "key")
        points = points.groupBy("low", "unit").agg(F.collect_list(F.struct("key", "comp", "own", "n", "counts")).alias("points"))
        left = self.kept(points.mapInArrow(_survivors(self.percent), "low long, unit long, key long, comp long, own boolean"), "survivors")
        involved = self.kept(left.select("key").distinct().join(self.classes.select("key", "doc_id"), "key"), "involved")
        bitmap = self.spark.sparkContext.broadcast(_id_filter(involved, involved.count()))
        sets = self.docs.mapInArrow(_sets(self.words, bitmap), "doc_id long, key long, shingles binary").withColumnRenamed("doc_id", "id")
        sets = sets.join(involved, "key").where("id <=> doc_id").select("key", "shingles").dropDuplicates(["key"])
        whole = left.join(sets, "key").groupBy("low", "unit").agg(F.collect_list(F.struct("key", "comp", "own", "shingles")).alias("points")).select("points")
        return self.kept(whole.mapInArrow(_spanning_links(self.percent), "a long, b long").distinct(), "links")

    def trees(self, links: DataFrame, components: DataFrame) -> DataFrame:
        """All links, with those that R-trees over the routes' open groups find.

        A group beyond ``MAX_ROUTE`` members or ``MAX_SHINGLES`` is first cut into parts, each a tree of its own; then what is
        still outside the group's largest component is compared with all parts. Copies join in the first step,
        so the second ships a group about once.
        """
        cuts = F.greatest(F.ceil(F.count(F.lit(1)) * 2 / MAX_ROUTE), F.ceil(F.sum("n") * 2 / MAX_SHINGLES)).cast("int")
        shared = self.kept(self.open_places(components), "shared")
        points = shared.join(shared.groupBy("low").agg(cuts.alias("parts")), "low").withColumn("parts", F.when(F.col("parts") > 2, F.col("parts")).otherwise(F.lit(1)))
        points = self.kept(points.withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int")), "points")
        links = links.union(self.tree_links(points.select("low", F.col("part").cast("long").alias("unit"), "key", "comp", F.lit(True).alias("own"))))
        wide = points.where("parts > 1")
        if wide.isEmpty():
            return links
        wide = self.kept(wide.drop("comp").join(self.components(links), "key", "left").withColumn("comp", F.coalesce("comp", "key")), "wide")
        comps = wide.groupBy("low", "comp").agg(F.count(F.lit(1)).alias("k"))
        main = comps.groupBy("low").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        wide = wide.join(main, "low").withColumn("rest", F.col("comp") != F.col("main"))
        wide = wide.join(wide.where("rest").groupBy("low").agg(cuts.alias("cuts")), "low")
        wide = self.kept(wide.withColumn("cut", F.pmod(F.xxhash64(F.lit(1), "key"), "cuts").cast("int")), "open_wide")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        there = wide.select("low", "key", "comp", "part", every("cuts").alias("cut"), F.lit(False).alias("own"))
        here = wide.where("rest").select("low", "key", "comp", every("parts").alias("part"), "cut", F.lit(True).alias("own"))
        units = there.union(here).groupBy("low", (F.col("part") * F.lit(1 << 31) + F.col("cut")).alias("unit"), "key", "comp").agg(F.max("own").alias("own"))
        return links.union(self.tree_links(units))

    def run(self) -> DataFrame:
        spark = self.spark
        self.profile()
        self.routes()
        links = tested = components = None
        for leader in ("low", "high"):
            pairs = self.with_points(self.star(leader, components))
            pairs = self.kept(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            found = self.kept(self.verify(pairs), "links")
            links, tested = (found, pairs) if links is None else (links.union(found), tested.union(pairs))
            components = self.kept(self.components(links), "components")
        components = self.kept(self.components(self.trees(links, components)), "components")
        named = self.classes.join(components, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        names = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        named = stored(spark, named.select("key", "comp").join(names, "comp").select("key", "comp", "component_id"), "names")
        discard(spark, self.classes, *self.spent)
        out = self.rows.where("chunk IS NULL").select("doc_id", "key", "n").join(named, "key", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "key", "comp")


def link_components(spark: SparkSession, docs: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row."""
    bound_batches(spark)
    return _Join(spark, docs, percent, words).run().select("doc_id", "n_shingles", "component_id")


def _add_key(place: int, name: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, words) for t in batch.column(place).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([set_key(v) if len(v) else None for v in sets], pa.int64())], names=[*batch.schema.names, name])

    return released(run)


def deduplicate(spark: SparkSession, docs: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """One row of each component stays, with its own columns: the one with the smallest doc_id.

    The decision is by row, not by id. A null doc_id counts as the largest; of rows with one id and one shingle set the
    first by text stays. A doc_id that names different texts may stay with one and go with another. Rows without words
    (null, empty or white text) link with nothing and all stay. An empty table stays empty; columns of any name pass through.
    """
    bound_batches(spark)
    rows = stored(spark, _Join(spark, docs, percent, words).run().select("doc_id", "key", F.col("n_shingles").alias("n"), "comp"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("w")
    best = stored(spark, rows.where("n > 0").groupBy("comp").agg(first), "winners")
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("comp").alias("comp"))
    ids = stored(spark, ids, "ids")
    many = ids.where("c > 1 OR doc_id IS NULL").select("doc_id")
    lost = ids.where("c = 1 AND doc_id IS NOT NULL AND n > 0").join(best, "comp").where("w.none OR w.doc_id != doc_id").select("doc_id")
    # texts are shuffled, if at all, by an id that occurs once
    away = lost.union(many.where("doc_id IS NOT NULL"))
    kept = docs.where(F.col("doc_id").isNotNull()).join(away.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    if many.isEmpty():
        return kept
    key, one, won, theirs = spare(docs.columns, "key", "first", "won", "repeated")
    many, best = many.toDF(theirs), best.select(F.col("w.doc_id").alias(theirs), F.col("w.key").alias(won))
    again = docs.join(many, F.col("doc_id").cast("long").eqNullSafe(F.col(theirs)), "left_semi")
    again = again.mapInArrow(_add_key(docs.columns.index("text"), key, words), StructType([*docs.schema.fields, StructField(key, LongType())]))
    again = again.withColumn(one, F.when(F.col(key).isNull(), 1).otherwise(F.row_number().over(Window.partitionBy("doc_id", key).orderBy("text"))))
    wins = again.join(best, F.col("doc_id").cast("long").eqNullSafe(F.col(theirs)) & (F.col(key) == F.col(won)), "left_semi").where(F.col(one) == 1)
    return kept.unionByName(wins.select(*docs.columns)).unionByName(again.where(F.col(key).isNull()).select(*docs.columns))
