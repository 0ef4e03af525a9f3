"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are the shapes of its words (runs of one character class collapsed, marks kept), a mark for each
word that repeats the one before, and marks for how varied and how long it is. Term weights are
sqrt(share) * idf. A truncated SVD of at most ``max_rows`` labelled rows (outside the held-out fold) gives the latent space;
their vectors are broadcast, every document's cosine to all of them is computed in blocks, and its ``neighbours``
nearest vote with their labels, weighted by similarity.

Edge cases: as in the toxicity operator: null or empty texts have a vector of their own marks and are scored; no labels or
one class gives every row the smoothed share; repeated and null ids are scored; other columns are not read.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.toxicity import held_out, training_rows
from lattice.llm.memory import released, remember
from lattice.storage import bound_batches

_CLASSES = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 else 57 if 48 <= b <= 57 else 120 if b >= 128 else 32 if b in b" \t\n\r\x0b\x0c" else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_shapes: dict[bytes, bytes] = {}
OWNER = "quality"


def _shape(word: bytes) -> bytes:
    if word not in _shapes:
        if len(_shapes) > 50_000:
            _shapes.clear()
        _shapes[word] = _RUN.sub(rb"\1+", word)[:24].replace(b"x+", b"x").replace(b"X+", b"X")
    return _shapes[word]


def terms(text: bytes | None) -> dict[bytes, float]:
    """Term shares of a whole text."""
    text = text or b""
    words = text.split()
    n = len(words)
    found: Counter = Counter()
    for word, count in Counter(text.translate(_CLASSES).split()).items():
        found[_shape(word)] += count
    found[b"#again"] = sum(map(operator.eq, words, words[1:]))
    out = {t: c / max(n, 1) for t, c in found.items() if c}
    out[b"#varied%d" % (8 * len(set(words)) // max(n, 1))] = 0.25
    out[b"#length%d" % min(n.bit_length(), 12)] = 0.05
    return out


#: Cosines of nearest neighbours lie close together near 1; this power of them sets near ones apart as weights.
POWER = 16


class Voter:
    def __init__(self, names: list[bytes], idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, share: float, neighbours: int):
        self.places = {t: i for i, t in enumerate(names)}
        self.idf, self.basis, self.vectors, self.labels, self.share, self.neighbours = idf, basis, vectors, labels, share, neighbours

    def weigh(self, bags: list[dict[bytes, float]]) -> np.ndarray:
        out = np.zeros((len(bags), len(self.idf)), np.float32)
        for row, bag in zip(out, bags, strict=True):
            for t, v in bag.items():
                i = self.places.get(t)
                if i is not None:
                    row[i] = v**0.5
        out *= self.idf
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def project(self, bags: list[dict[bytes, float]]) -> np.ndarray:
        out = self.weigh(bags) @ self.basis
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, bags: list[dict[bytes, float]]) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        if not len(self.labels):
            return np.full(len(bags), self.share)
        near = self.project(bags) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** POWER + 1e-9
        return np.clip((weight * self.labels[best]).sum(1) / weight.sum(1), 0, 1)


def train(bags: list[dict[bytes, float]], labels: np.ndarray, dimensions: int = 32, max_terms: int = 2000, min_docs: int = 3, neighbours: int = 15) -> Voter:
    share = float((labels.sum() + 1) / (len(labels) + 2))
    seen = Counter(t for bag in bags for t in bag)
    names = sorted((t for t, c in seen.items() if c >= min_docs), key=lambda t: (-seen[t], t))[:max_terms]
    if not names or labels.min() == labels.max():
        return Voter([], np.empty(0, np.float32), np.empty((0, 0)), np.empty((0, 0)), np.empty(0), share, neighbours)
    idf = np.array([np.log(1 + len(bags) / seen[t]) for t in names], np.float32)
    voter = Voter(names, idf, np.eye(len(names), dtype=np.float32), np.empty((0, 0)), np.empty(0), share, neighbours)
    m = voter.weigh(bags)
    _, vectors = np.linalg.eigh(m.T @ m)
    voter.basis = np.ascontiguousarray(vectors[:, ::-1][:, : min(dimensions, len(names))])
    voter.vectors, voter.labels = voter.project(bags), labels
    return voter


def _train_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remember(OWNER, _shapes.clear)
    for batch in batches:
        bags = [terms(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array([list(b) for b in bags], pa.list_(pa.binary())), pa.array([list(b.values()) for b in bags], pa.list_(pa.float64()))], names=["doc_id", "y", "terms", "shares"])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 4000, **training) -> Voter:
    rows = training_rows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels.withColumn("doc_id", F.col("doc_id").cast("long")), label, max_rows)
    found = rows.mapInArrow(released(_train_bags, OWNER), "doc_id long, y int, terms array<binary>, shares array<double>").collect()
    found = sorted(found, key=lambda r: r.doc_id)
    bags = [dict(zip(map(bytes, r.terms), r.shares, strict=True)) for r in found]
    return train(bags, np.array([r.y for r in found], float) if found else np.zeros(0), **training) if found else Voter([], np.empty(0), np.empty((0, 0)), np.empty((0, 0)), np.empty(0), 0.5, 1)


def score(spark: SparkSession, docs: DataFrame, model: Voter, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember(OWNER, _shapes.clear)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = shared.value.score([terms(t) for t in part.column(1).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.astype(np.float64))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run, OWNER), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(spark, docs, fit(spark, docs, labels, **options))


def keep_good(spark: SparkSession, docs: DataFrame, model: Voter, threshold: float = 0.3) -> DataFrame:
    """The documents' own columns, without those that score below the threshold; one pass, no join."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember(OWNER, _shapes.clear)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = shared.value.score([terms(t) for t in part.column(place).cast(pa.binary()).to_pylist()])
                yield part.filter(pa.array(found >= threshold))

    return docs.mapInArrow(released(run, OWNER), docs.schema)
