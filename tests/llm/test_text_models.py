import zlib

import numpy as np

from lattice.llm import quality, toxicity

DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, {0} int, predicted int"


def is_held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def prose(rng, n):
    return [str(rng.choice(["river", "stone", "green", "house", "walks", "under", "light", "seven", "paper", "cloud"])) for _ in range(n)]


def test_interactions_that_additive_weights_miss():
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for _ in range(3000):
        words, a, b = prose(rng, 12), rng.random() < 0.4, rng.random() < 0.4
        words += ["vermin"] * a + ["martians"] * b
        texts.append(" ".join(words).encode())
        labels.append(float(a and b))
    sets = [toxicity.terms(t) for t in texts]
    model = toxicity.train(sets, np.array(labels), rate=0.1, epochs=40, weight=1.0)
    score = lambda t: model.score([toxicity.terms(t)])[0]
    assert score(b"river stone vermin martians") > 0.5 > max(score(b"river vermin stone"), score(b"river martians stone"))


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join([*prose(rng, 30), *(["swine"] if i % 4 == 0 else [])])) for i in range(800)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 9) for i, _ in rows], LABELS.format("toxic"))
    out = toxicity.classify(spark, docs, labels).collect()
    assert len(out) == 800 and all(r.held_out == is_held(r.doc_id) and 0 <= r.score <= 1 for r in out)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in out if r.held_out)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(prose(rng, 20))) for i in range(200)]
    docs = spark.createDataFrame([(*r, "") for r in rows], DOCS)
    fair = [(i, i % 2, 0) for i, _ in rows]
    lied = [(i, 1 - y if is_held(i) else y, 0) for i, y, _ in fair]
    for module, name in ((toxicity, "toxic"), (quality, "quality")):
        a, b = (sorted(map(tuple, module.classify(spark, docs, spark.createDataFrame(x, LABELS.format(name))).collect())) for x in (fair, lied))
        assert a == b


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, ""), (2, "", ""), (None, "word", ""), (3, "x" * 300_000, ""), (3, "x" * 300_000, "")], DOCS)
    for module, name in ((toxicity, "toxic"), (quality, "quality")):
        for labels in ([], [(1, 1, 0), (2, None, 0), (None, 1, 0)], [(1, 0, 0), (2, 1, 0), (3, 1, 0), (3, 0, 0)]):
            out = module.classify(spark, docs, spark.createDataFrame(labels, LABELS.format(name))).collect()
            assert len(out) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
        assert module.classify(spark, docs.limit(0), spark.createDataFrame([], LABELS.format(name))).count() == 0


def test_quality_separates_junk(spark):
    rng = np.random.default_rng(3)
    junk = (lambda w: " ".join(x.upper() + "!!" for x in w), lambda w: " ".join(x + "$$$" for x in w), lambda w: " ".join([w[0]] * 40), lambda w: " | ".join(w))
    rows, good = [], {}
    for i in range(800):
        words = prose(rng, 40)
        good[i] = int(i % 3 != 0)
        rows.append((i, ". ".join(" ".join(words[k : k + 8]).capitalize() for k in range(0, 40, 8)) if good[i] else junk[i % 4](words), ""))
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, y, 0) for i, y in good.items()], LABELS.format("quality"))
    out = quality.classify(spark, docs, labels, max_rows=300).collect()
    assert np.mean([r.predicted == good[r.doc_id] for r in out if r.held_out]) > 0.98
    model = quality.fit(spark, docs, labels, max_rows=300)
    kept = {r.doc_id for r in quality.keep_good(spark, docs, model).collect()}
    assert kept == {r.doc_id for r in out if r.predicted == 1}


def test_votes_match_brute_force():
    rng = np.random.default_rng(4)
    marks = ["", "!!!", " | x", " $9", " A-b", " (c)", " 12:30", "...", " X Y", " --"]
    bags = [quality.terms(" ".join(w + str(rng.choice(marks)) for w in prose(rng, 20)).encode()) for _ in range(60)]
    labels = np.array([i % 2 for i in range(60)], float)
    voter = quality.train(bags, labels, neighbours=5)
    v = voter.project(bags).astype(float)
    for i in range(60):
        near = sorted(range(60), key=lambda j: -(v[i] @ voter.vectors[j].astype(float)))[:6]
        if v[i] @ voter.vectors[near[4]] - v[i] @ voter.vectors[near[5]] < 1e-6:
            continue  # a tie at the fifth
        w = [max(v[i] @ voter.vectors[j].astype(float), 0) ** quality.POWER + 1e-9 for j in near[:5]]
        assert abs(voter.score([bags[i]])[0] - np.average(labels[near[:5]], weights=w)) < 1e-5


def test_machine_scores_match_the_sum_over_pairs():
    rng = np.random.default_rng(5)
    names = np.unique(rng.integers(0, 2**32, 40, dtype=np.uint32))
    model = toxicity.FactorizationMachine(names, -0.3, rng.normal(size=len(names)), rng.normal(size=(len(names), 4)))
    sets = [np.unique(np.r_[rng.choice(names, n, replace=False), rng.integers(0, 2**32, 3, dtype=np.uint32)]) for n in (0, 1, 2, 7, 20)]
    for s, got in zip(sets, model.score(sets), strict=True):
        at = [int(np.flatnonzero(names == t)[0]) for t in s if t in names]
        z = model.bias + sum(model.weights[i] for i in at) + sum(model.factors[i] @ model.factors[j] for i in at for j in at if i < j)
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_repeated_ids_add_no_training_rows(spark):
    rows = [(i, f"text {i}", "") for i in range(40)] + [(1, "other text", ""), (1, "text 1", "")] * 50
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] * 3, LABELS.format("toxic"))
    found = toxicity.training_rows(spark.createDataFrame(rows, DOCS), labels, "toxic", 16).collect()
    assert len(found) == 16 and len({r.doc_id for r in found}) == 16 and all(r.text == ("other text" if r.doc_id == 1 else f"text {r.doc_id}") for r in found)
