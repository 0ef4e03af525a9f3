import numpy as np
import pytest
from test_mixing import cells_of, rows_of

from lattice.llm import mixing


def fill(shares, most):
    """Shares in proportion, none above its bound, as near to 1 in all as the bounds allow."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(shares * mid, most).sum() < 1 else (low, mid)
    return np.minimum(shares * high, most)


@pytest.mark.parametrize("keep", [0.5, 0.8])
def test_kept_tokens_meet_the_targets_that_the_budget_holds(spark, keep):
    raked = mixing.rake(cells_of(spark, rows_of(3000)), rounds=20)
    goal, out = raked.toPandas(), mixing.calibrate(mixing.rake_within(raked, keep, 20), keep).toPandas()
    kept = out.assign(k=out.probability * out.tokens)
    assert out.probability.between(0, 1).all() and abs(kept.k.sum() / out.tokens.sum() - keep) < 1e-9
    for axis in mixing.AXES:
        want = fill(goal.groupby(axis).weight.sum(), goal.groupby(axis).tokens.sum() / goal.tokens.sum() / keep)
        assert np.allclose((kept.groupby(axis).k.sum() / kept.k.sum()).sort_index(), want.sort_index(), atol=2e-3)


def test_kept_documents_reach_the_reported_marginals(spark):
    rows = rows_of(6000, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight int")
    found = mixing.marginals(mixing.shares_of(spark, mixing.measure(docs), None, 0.7, 12, 0.5)).toPandas().set_index(["axis", "value"])
    kept = mixing.mix(spark, docs, rounds=12, keep=0.5).toPandas()
    for axis in mixing.AXES:
        have = kept.groupby(axis).n_tokens.sum() / kept.n_tokens.sum()
        assert np.allclose(have.sort_index(), found.loc[axis].reached.sort_index(), atol=0.03)
    held = found[found.index.get_level_values(0) != "topic"]
    assert np.allclose(held.target, held.reached, atol=0.01)


def test_own_columns_pass_through_and_a_topic_column_is_used(spark):
    rows = [(i, "w " * 50, "en", "a", "MINE", f"t{i % 2}", 5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _topic string, topic string, _p int")
    out = mixing.sample(spark, docs, keep=0.5)
    assert out.columns == docs.columns and {(r._topic, r._p) for r in out.collect()} == {("MINE", 5)}
    goal = spark.createDataFrame([("t0", 1.0), ("t1", 0.0)], "topic string, share double")
    assert {r.topic for r in mixing.mix(spark, docs, {"topic": goal}, keep=0.5).collect()} == {"t0"}
