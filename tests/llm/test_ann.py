import numpy as np

from lattice.llm import ann
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>"


def run(spark, rows, **kw):
    out = ann.search(spark, spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, **kw).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(v, s) for _, v, s in sorted(rows)] for q, rows in got.items()}


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        order = np.lexsort((ids, -np.round(s, 12)))
        out[ids[i]] = [(int(ids[j]), s[j]) for j in order if j != i][:k]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(10, 32))
    rows = [(i, (centres[i % 10] + rng.normal(size=32)).tolist()) for i in range(2000)]
    got, want = run(spark, rows, rows_per_part=300), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q, found in got.items():
        exact = dict(brute(rows, 2000)[q])
        assert all(abs(exact[v] - s) < 1e-12 for v, s in found)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)


def test_recall_and_candidate_share_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
    x = np.array([v for _, v in rows])
    index = ann.fit(x)
    assert index.retrieved(x[np.array([i for i, _ in rows]) % 50 == 0], x).mean() < 0.2


def test_pigeonhole_finds_every_code_in_the_radius():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    for width, reach in ((8, 0), (8, 1), (16, 3), (16, 5)):
        index = ann.Index(rng.normal(size=(16, 64)), width, reach)
        bits = x @ index.projection > 0
        values = index.values(x)
        found = set(zip(*(v.tolist() for v in ann.search_part(values[:20], x[:20], values, x, np.arange(400), 400, width, reach)[:2]), strict=True))
        inside = {(q, int(v)) for q in range(20) for v in np.flatnonzero((bits[q] != bits).sum(1) <= index.radius)}
        assert inside <= found and found == set(zip(*(v.tolist() for v in np.nonzero(index.retrieved(x[:20], x))), strict=True))


def test_postings_by_leading_bits_find_what_whole_parts_find(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=24)
    rows = [(i, (centre * (i % 3) + rng.normal(size=24)).tolist()) for i in range(1500)] + [(3000 + i, (centre * 9 + rng.normal(size=24) * 1e-3).tolist()) for i in range(400)]
    few = run(spark, rows, most=3, rows_per_part=4000)
    assert few == run(spark, rows, most=3, rows_per_part=200) == run(spark, rows, most=3, rows_per_part=64)


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0], "x", 1), (0, [1.0, 0.0], "y", 2), (1, [1.0, 0.1], None, 3), (1, [1.0, 0.1], "z", 3), (2, [0.0, 1.0], "w", 4), (1, [0.5, 0.5], "v", 5)] + [(0, [1.0, 0.0], "r", 0)] * 20
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids string, ha int")
    out = ann.search(spark, df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in out] == [(0, 1), (0, 1), (0, 2)]


def test_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=8).tolist()
    rows = [(i, v) for i in range(120)] + [(500 + i, rng.normal(size=8).tolist()) for i in range(20)]
    got = run(spark, rows)
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in got[50]] == [0, 1, 2, 3, 4]


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0]), (6, [1.0, 1.0, 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    assert [i for i, _ in run(spark, rows)[0]] == [5]
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0, 2.0])]) == {}
