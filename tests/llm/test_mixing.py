import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, weight int"


def rows_of(n=600, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(["w"] * int(rng.integers(1, 600))), str(rng.choice(["en", "de"], p=[0.8, 0.2])), "hot" if i % 3 == 0 else f"s{i % 5}", 1) for i in range(n)]


def cells_of(spark, rows):
    return mixing.measure(spark.createDataFrame(rows, SCHEMA)).groupBy(*mixing.AXES).agg(F.sum("n_tokens").alias("tokens"))


def test_raking_meets_the_marginals(spark):
    raked = mixing.rake(cells_of(spark, rows_of()), rounds=30).toPandas()
    total = raked.tokens.sum()
    for axis in mixing.AXES:
        want = (raked.groupby(axis).tokens.sum() / total) ** 0.7
        have = raked.groupby(axis).weight.sum()
        assert np.allclose(have, want / want.sum(), atol=1e-3)


def test_raking_matches_a_plain_loop(spark):
    cells = cells_of(spark, rows_of()).toPandas()
    targets = {"lang": {"en": 0.5, "de": 0.5}}
    frames = {"lang": spark.createDataFrame(list(targets["lang"].items()), "lang string, share double")}
    got = mixing.rake(cells_of(spark, rows_of()), frames).toPandas().set_index(list(mixing.AXES)).weight
    shares = {a: (cells.groupby(a).tokens.sum() / cells.tokens.sum()) ** 0.7 for a in mixing.AXES}
    shares = {a: s / s.sum() for a, s in shares.items()}
    cells["w"] = cells.tokens / cells.tokens.sum()
    for _ in range(8):
        for a in mixing.AXES:
            goal = targets[a] if a in targets else shares[a]
            have = cells.groupby(a).w.transform("sum")
            cells["w"] = cells.w * cells[a].map(goal) / have
    want = cells.set_index(list(mixing.AXES)).w
    assert np.allclose(got.sort_index(), want.sort_index(), atol=1e-12)


@pytest.mark.parametrize("keep", [0.3, 0.8])
def test_calibration_spends_the_budget(spark, keep):
    out = mixing.calibrate(mixing.rake(cells_of(spark, rows_of())), keep).toPandas()
    assert out.probability.between(0, 1).all()
    assert abs((out.probability * out.tokens).sum() / out.tokens.sum() - keep) < 1e-9
    free = out[out.probability < 1]
    ratio = free.probability * free.tokens / free.weight
    assert np.allclose(ratio, ratio.iloc[0])


def test_draws_follow_probabilities(spark):
    rows = rows_of(4000, 1)
    kept = mixing.mix(spark, spark.createDataFrame(rows, SCHEMA)).toPandas()
    words = {i: len(t.split()) for i, t, *_ in rows}
    assert (kept.n_tokens == kept.doc_id.map(words)).all() and kept.doc_id.is_unique
    assert abs(kept.n_tokens.sum() / sum(words.values()) - 0.8) < 0.03
    again = mixing.sample(spark, spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(again.toPandas().doc_id) == sorted(kept.doc_id) and again.columns == ["doc_id", "text", "lang", "source", "weight"]


def test_edges(spark):
    rows = [(1, None, None, None, 1), (2, "", "en", "a", 1), (None, "some words", "en", "a", 1), (3, "w " * 200_000, "de", None, 1), (3, "w " * 200_000, "de", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mixing.mix(spark, df, keep=1.0).count() == 5
    assert mixing.mix(spark, df.limit(0)).count() == 0
    lost = spark.createDataFrame([("xx", 1.0)], "lang string, share double")
    assert mixing.mix(spark, df, {"lang": lost}).count() == 0
