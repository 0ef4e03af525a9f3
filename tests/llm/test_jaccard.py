import random

import numpy as np

from lattice.llm import jaccard


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out


def shingles(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    """{(doc_id, text): (n, component)} by comparing everything with everything."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        names[find(i)] = min(names.get(find(i), d), d)
    return sorted((d, len(sets[i]), names[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=50)
    base = [rng.choices(vocabulary, k=rng.choice([3, 5, 12, 60, 200])) for _ in range(n)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(n):
        copy = list(base[rng.randrange(n)])
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((n + i, " ".join(copy)))
    one = rng.choices(vocabulary, k=120)
    for i in range(n):
        copy = list(one)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((2 * n + i, "\n".join(copy)))
    rows += [(3 * n + i, " ".join(passage + rng.choices(vocabulary, k=80))) for i in range(n)]
    return rows


def result(spark, rows):
    out = jaccard.link_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect())


def test_matches_brute_force(spark):
    rows = corpus(1)
    assert result(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, "x" * 100_000), (8, "é É é É é"), (9, "é é é é é"), (4, "a b"), (10, "one two three four five"), (11, "ONE two\nthree four five")]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_null_ids_and_extra_columns(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1, "x"), (7, "a b c d e f", 2, "y"), (None, None, 3, "z")], "doc_id long, text string, key long, n string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(spark, df).collect()), key=str)
    assert out == sorted([(None, 2, 7), (7, 2, 7), (None, 0, None)], key=str)


def test_split_routes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MAX_ROUTE", 8)
    monkeypatch.setattr(jaccard, "PAIRS_PER_BLOCK", 16)
    rows = corpus(2, 30)
    assert result(spark, rows) == brute(rows)
    monkeypatch.setattr(jaccard, "MAX_ROUTE", 1 << 20)
    monkeypatch.setattr(jaccard, "MAX_SHINGLES", 1000)
    assert result(spark, rows) == brute(rows)


def test_tree_keeps_every_pair_over_the_bound():
    rng = np.random.default_rng(0)
    centres = rng.poisson(2, (8, jaccard.GROUPS))
    counts = np.vstack([np.maximum(c + rng.integers(-1, 2, (80, jaccard.GROUPS)) * (rng.random((80, jaccard.GROUPS)) < 0.1), 0) for c in centres]).astype(np.uint8)
    sizes = counts.sum(1).astype(np.int64)
    tree = jaccard.RTree(sizes, counts)
    for i in range(0, len(sizes), 17):
        want = (100 * np.minimum(sizes, sizes[i]) >= 75 * np.maximum(sizes, sizes[i])) & (np.minimum(counts, counts[i]).sum(1, dtype=int) >= jaccard.needed(sizes, sizes[i], 75))
        assert set(tree.near(i, 75)) == set(np.flatnonzero(want))


def test_bound_never_understates():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 40_000 if _ == 0 else 300, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.r_[a[: len(a) // 2], rng.integers(0, 2**63, 200, dtype=np.uint64)])
        u, v = jaccard.count_vector(a), jaccard.count_vector(b)
        for groups in {64, min(len(u), len(v))}:
            assert jaccard.overlap_bound(jaccard.folded(u, groups), jaccard.folded(v, groups)) >= len(np.intersect1d(a, b))


def components_of(n, links):
    root = list(range(n))
    for i, j in links:
        root = [root[i] if r == root[j] else r for r in root]
    return [root.index(r) for r in root]


def test_trees_of_several_group_counts_span_every_component():
    rng = np.random.default_rng(5)
    sets = []
    for n in (30, 700, 980, 1000, 1040, 1200, 4000, 4090, 4200, 5000):
        core = rng.integers(0, 2**63, n, dtype=np.uint64)
        sets += [np.unique(np.r_[core, rng.integers(0, 2**63, k, dtype=np.uint64)]) for k in (1, 30, 200)]
    key = rng.permutation(len(sets)).astype(np.int64)
    place = {k: i for i, k in enumerate(key.tolist())}
    want = []
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(x, sets[j]))
            if 100 * both >= 75 * (len(x) + len(sets[j]) - both):
                want.append((i, j))
    found = list(zip(*jaccard.spanning_links(key, key, sets, 75, np.ones(len(sets), bool)), strict=True))
    links = [(place[x], place[y]) for x, y in found]
    assert {(max(p), min(p)) for p in links} <= set(want) and len(links) < len(sets)
    assert components_of(len(sets), links) == components_of(len(sets), want)
    own = np.arange(len(sets)) % 3 == 0
    half = [(i, j) for i, j in want if own[i] or own[j]]
    links = [(place[x], place[y]) for x, y in zip(*jaccard.spanning_links(key, key, sets, 75, own), strict=True)]
    assert components_of(len(sets), links) == components_of(len(sets), half)
    left = jaccard.survivors(key, np.array([len(v) for v in sets]), [jaccard.count_vector(v) for v in sets], 75, own)
    assert all(left[i] and left[j] for i, j in half)
    assert jaccard.spanning_links(key, np.zeros(len(key), np.int64), sets, 75, own) == ([], [])


def test_group_without_links_gives_no_rows():
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 2**63, 70, dtype=np.uint64)
    sets = [np.unique(np.r_[passage, rng.integers(0, 2**63, 30, dtype=np.uint64)]) for _ in range(200)]
    key = np.arange(200)
    assert jaccard.spanning_links(key, key, sets, 75, np.ones(200, bool)) == ([], [])


def test_deduplicate_keeps_one_of_each(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "other words that are not the same"), (4, None), (3, "other words that are not the same")]
    out = jaccard.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def kept(spark, rows, schema="doc_id long, text string"):
    return sorted((tuple(r) for r in jaccard.deduplicate(spark, spark.createDataFrame(rows, schema)).collect()), key=str)


def test_deduplicate_decides_by_row(spark):
    a, b = "a b c d e f g h", "other words that are not the same"
    assert kept(spark, [(None, a), (None, a), (3, a), (5, a), (5, b)]) == [(3, a), (5, b)]
    assert kept(spark, [(None, a), (None, a.upper()), (None, b), (None, None), (None, " ")]) == sorted([(None, a.upper()), (None, b), (None, None), (None, " ")], key=str)
    assert kept(spark, [(7, a), (7, a), (7, b), (8, b)]) == [(7, a), (7, b)]
    assert kept(spark, []) == []


def test_deduplicate_passes_any_columns_through(spark):
    rows = [(2, "a b c d e f", 1, "x", 5, None), (1, "A b c d e f", 2, None, 6, "y"), (2, "u v w x y z", 3, "z", 7, "y")]
    assert kept(spark, rows, "doc_id long, text string, key long, _r string, first int, comp string") == sorted(rows[1:], key=str)


def test_deduplicate_matches_brute_force(spark):
    rows = corpus(3, 25)
    name = {d: c for d, _, c in brute(rows)}
    assert {d for d, _ in kept(spark, rows)} == {d for d, t in rows if name[d] == d or not shingles(t)}
