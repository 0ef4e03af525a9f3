"""Toxicity by a factorization machine over hashed terms.

A document is the set of its lower-cased words and of the 5-byte pieces inside words (which inflected and compounded
languages need), each hashed to 32 bits. The machine scores
w0 + sum w_i + sum over pairs <v_i, v_j>, so that two terms can mean together what neither means alone. It is
trained by Adam on the driver from at most ``max_rows`` labelled rows, chosen by a hash of doc_id among those whose
crc32(doc_id as text) mod 5 is not 0; only terms in ``min_docs`` of them
or more whose share differs between the classes by ``min_z`` standard errors get parameters. Labels, lang,
source and doc_id are never inputs. Scoring reads each whole text once, in Arrow batches.

Edge cases: null or empty text scores by the bias alone; a null doc_id is scored, counted as not held out; rows labelled
null are not learned from, repeated labels count as their largest; without any labels, or with one class only,
every score is the smoothed share of that class; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.memory import released
from lattice.storage import bound_batches

FOLDS, PIECE = 5, 5
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the words and of their 5-byte pieces, from the word's start on."""
    low = (text or b"").lower().translate(_WORDS)
    words = set(low.split())
    own = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))
    flat = np.frombuffer(b" " + b" ".join(words), np.uint8).astype(np.uint64)
    if len(flat) < PIECE:
        return np.unique(own)
    window = np.zeros(len(flat) - PIECE + 1, np.uint64)
    inside = np.ones(len(window), bool)
    for i in range(PIECE):
        byte = flat[i : i + len(window)]
        window = window << np.uint64(8) | byte
        inside &= (byte != 32) | (i == 0)
    pieces = (window[inside] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
    return np.unique(np.concatenate([own, pieces]))


class FactorizationMachine:
    def __init__(self, names: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.names, self.bias, self.weights, self.factors = names, bias, weights, factors

    def score(self, sets: list[np.ndarray]) -> np.ndarray:
        """Probabilities for sets of hashed terms."""
        out = np.full(len(sets), self.bias)
        every, own = np.concatenate([*sets, np.empty(0, np.uint32)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        if len(self.names) and len(every):
            at = np.minimum(np.searchsorted(self.names, every), len(self.names) - 1)
            known = self.names[at] == every
            at, own = at[known], own[known]
            out += np.bincount(own, self.weights[at], len(sets))
            for f in range(self.factors.shape[1]):
                v = self.factors[at, f]
                out += 0.5 * (np.bincount(own, v, len(sets)) ** 2 - np.bincount(own, v * v, len(sets)))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(sets: list[np.ndarray], labels: np.ndarray, rank: int = 4, min_docs: int = 3, min_z: float = 4.0, weight: float = 3.0, epochs: int = 30, batch: int = 1024, rate: float = 0.05, decay: float = 1e-4, seed: int = 0) -> FactorizationMachine:
    """Fit by Adam on the logistic loss, label 1 counting ``weight`` times; a fixed seed and order make it repeatable."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    none = FactorizationMachine(np.empty(0, np.uint32), bias, np.empty(0), np.empty((0, rank)))
    if not len(labels) or labels.min() == labels.max():
        return none
    names, seen = np.unique(np.concatenate(sets), return_counts=True)
    good = labels > 0
    inside = np.zeros(len(names))
    place, marked = np.unique(np.concatenate([t for t, y in zip(sets, good, strict=True) if y]), return_counts=True)
    inside[np.searchsorted(names, place)] = marked
    n1, n0 = good.sum(), (~good).sum()
    p1, p0, p = inside / n1, (seen - inside) / n0, seen / (n1 + n0)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    names = names[(seen >= min_docs) & (z >= min_z)]
    if not len(names):
        return none
    rng = np.random.default_rng(seed)
    ids = [_places(names, s) for s in sets]
    size = len(names)
    p = np.hstack([np.zeros((size, 1)), rng.normal(0, 0.01, (size, rank))])
    mean, var, step = np.zeros_like(p), np.zeros_like(p), 0
    b = np.array([bias, 0.0, 0.0])
    for _ in range(epochs):
        order = rng.permutation(len(sets))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            at = np.concatenate([ids[r] for r in rows])
            own = np.repeat(np.arange(len(rows)), [len(ids[r]) for r in rows])
            w, v = p[at, 0], p[at, 1:]
            sums = np.stack([np.bincount(own, v[:, f], len(rows)) for f in range(rank)], 1)
            squares = np.bincount(own, (v * v).sum(1), len(rows))
            z = b[0] + np.bincount(own, w, len(rows)) + 0.5 * ((sums**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) * np.where(labels[rows] > 0, weight, 1.0) / len(rows)
            grad = decay * p
            grad[:, 0] += np.bincount(at, g[own], size)
            for f in range(rank):
                grad[:, 1 + f] += np.bincount(at, g[own] * (sums[own, f] - v[:, f]), size)
            step += 1
            mean += 0.1 * (grad - mean)
            var += 0.001 * (grad * grad - var)
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            p -= rate * fix * mean / (np.sqrt(var) + 1e-8)
            gb = g.sum()
            b[1] += 0.1 * (gb - b[1])
            b[2] += 0.001 * (gb * gb - b[2])
            b[0] -= rate * fix * b[1] / (np.sqrt(b[2]) + 1e-8)
    return FactorizationMachine(names, float(b[0]), p[:, 0], p[:, 1:])


def _places(names: np.ndarray, some: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(names, some), len(names) - 1)
    return at[names[at] == some]


def held_out(doc_id=None):
    """Whether crc32(doc_id as text) mod 5 is 0; such rows are never learned from."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled (doc_id, text, y), outside the held-out fold: a bounded sample, by a hash of doc_id.

    The sampled labels are a bounded table, so they are broadcast to the documents. Of documents with one id the
    smallest text counts, so repeated ids add no rows.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(y), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def _train_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [terms(t).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(sets, pa.binary())], names=["doc_id", "y", "terms"])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 16_000, **training) -> FactorizationMachine:
    rows = training_rows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels.withColumn("doc_id", F.col("doc_id").cast("long")), label, max_rows)
    found = sorted(rows.mapInArrow(released(_train_terms), "doc_id long, y int, terms binary").collect(), key=lambda r: r.doc_id)
    return train([np.frombuffer(r.terms, np.uint32) for r in found], np.array([r.y for r in found], float), **training)


def score(spark: SparkSession, docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = shared.value.score([terms(t) for t in part.column(1).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(spark, docs, fit(spark, docs, labels, **options))
