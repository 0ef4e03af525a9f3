import random
from itertools import combinations

from pyspark.sql import functions as F

from lattice.functions import predicates as P
from lattice.model import PropertyGraph
from lattice.operators import analysis, communities, entity, resolve, search


def graph(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "source string, target string")


def groups(spark, nodes, edges, **kw):
    rows = communities.cluster(spark, *graph(spark, nodes, edges), **kw).collect()
    assert sorted(r.id for r in rows) == sorted(nodes)
    out = {}
    for r in rows:
        out.setdefault(r.community, set()).add(r.id)
    sizes = [len(out[c]) for c in range(len(out))]
    assert sizes == sorted(sizes, reverse=True)
    assert [min(out[c]) for c in sorted(out, key=lambda c: (-len(out[c]), min(out[c])))] == [min(out[c]) for c in range(len(out))]
    return [out[c] for c in range(len(out))]


def cliques(k, size):
    return [[f"c{i}n{j}" for j in range(size)] for i in range(k)]


def test_cliques_on_a_ring_and_loose_nodes(spark):
    parts = cliques(6, 6)
    edges = [e for p in parts for e in combinations(p, 2)] + [(parts[i][0], parts[(i + 1) % 6][1]) for i in range(6)]
    edges += [(b, a) for a, b in edges[:10]] + [("x", "x"), ("x", "nowhere")]
    found = groups(spark, [n for p in parts for n in p] + ["x", "y"], edges)
    assert found == [set(p) for p in parts] + [{"x"}, {"y"}]


def test_hubs_join_most_of_their_neighbours(spark):
    parts = cliques(5, 8)
    edges = [e for p in parts for e in combinations(p, 2)] + [("hub", n) for p in parts for n in p[:5]] + [("hub", n) for n in parts[3]]
    found = groups(spark, [n for p in parts for n in p] + ["hub"], edges, exclude_hubs_percentile=98)
    assert set(parts[3]) | {"hub"} == found[0] and all(set(p) in found for i, p in enumerate(parts) if i != 3)


def test_large_communities_are_split(spark):
    """Two cliques joined by many edges are one community of a wide graph, more than a quarter of it, and split by themselves."""
    rng = random.Random(0)
    left, right = [f"l{i}" for i in range(20)], [f"r{i}" for i in range(20)]
    edges = list(combinations(left, 2)) + list(combinations(right, 2)) + [(a, b) for a in left for b in right if rng.random() < 0.25]
    rest = [f"s{i}" for i in range(80)]
    edges += [(a, b) for i, (a, b) in enumerate(zip(rest, rest[1:], strict=False)) if i % 4 != 3]
    found = groups(spark, left + right + rest, edges)
    assert set(left) in found and set(right) in found and max(map(len, found)) <= 30


def test_empty_and_edgeless_graphs(spark):
    assert groups(spark, [], []) == [] and groups(spark, ["b", "a"], []) == [{"a"}, {"b"}]


def test_moves_do_not_lower_modularity():
    rng = random.Random(3)
    ids = [f"v{i:02}" for i in range(40)]
    links = [(a, b, rng.choice([1.0, 2.5])) for a, b in combinations(ids, 2) if rng.random() < (0.5 if int(a[1:]) % 4 == int(b[1:]) % 4 else 0.05)]
    total = 2 * sum(w for *_, w in links)

    def modularity(label):
        strength = {}
        for a, b, w in links:
            strength[label[a]] = strength.get(label[a], 0) + w
            strength[label[b]] = strength.get(label[b], 0) + w
        return sum(2 * w for a, b, w in links if label[a] == label[b]) / total - sum(s * s for s in strength.values()) / total**2

    one, many = communities.louvain_labels(ids, links), communities.partition_labels(ids, links)
    alone = {v: i for i, v in enumerate(ids)}
    assert modularity(alone) < modularity(one) <= modularity(many) + 1e-12 and modularity(many) > 0.4
    assert communities.louvain_labels(ids[::-1], links[::-1]) == one


def test_bare_names_agree_with_listing_all_candidates(spark):
    rng = random.Random(5)
    files = ["a.py", "b.py", "p/a.py", "p/b.py", "p/q/a.py", "p/q/r/c.py", "p/s/d.py", "t/x.py", "tests/test_a.py", "p/tests/test_b.py", "tests/test_c.py"]
    symbols = sorted({(f"s{rng.randrange(60)}", f"N{rng.randrange(9)}", rng.choice(files)) for _ in range(70)})
    calls = [(i, f"n{rng.randrange(10)}", rng.choice(files)) for i in range(120)]
    c, s = spark.createDataFrame(calls, "call_id int, callee string, call_file string"), spark.createDataFrame(symbols, "id string, name string, file string")
    listed = [(i, f, t, at) for i, n, f in calls for t, m, at in symbols if m.lower() == n]
    want = resolve.nearest_candidate(spark.createDataFrame(listed, "call_id int, call_file string, target string, target_file string"))
    got = {tuple(r) for r in resolve.bare_name(c, s).collect()}
    assert got == {tuple(r) for r in want.collect()} and len(got) > 20


def test_question_contexts(spark):
    nodes = spark.createDataFrame([("a", "Alpha", "f"), ("b", "Beta", "f"), ("c", "Gamma", None), ("d", "Delta", "g"), ("e", "Eps", "g")], "id string, label string, source_file string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("c", "b", "uses"), ("c", "d", "uses"), ("d", "e", "x"), ("e", "e", "x")], "source string, target string, relation string")
    got = {r.question: r.chars for r in analysis.question_contexts(spark, PropertyGraph(nodes, edges), {"q1": ["alpha"], "q2": ["none"], "q3": ["eps", "ta"]}, depth=2).collect()}
    lines = ["NODE Alpha src=f loc=", "NODE Beta src=f loc=", "NODE Gamma src= loc=", "EDGE Alpha --calls--> Beta", "EDGE Beta --uses--> Gamma"]
    assert got["q1"] == len("\n".join(lines)) and set(got) == {"q1", "q3"}


def test_search_terms_segment_chinese():
    assert search.search_terms("Où est 知识图谱 of the café") == ["est", "知识", "识图", "图谱", "知识图谱", "the", "cafe"]
    assert search.segments("知") == ["知"] and search.segments("plain") == ["plain"]


def test_resolvable_symbols(spark):
    rows = [("code", " .Run() "), ("code", "main.py"), ("code", "()"), ("code", " "), ("document", "run"), (None, "x"), ("code", None)]
    df = spark.createDataFrame(rows, "t string, l string")
    got = [(r.ok, r.name) for r in df.select(P.is_resolvable(F.col("t"), F.col("l")).alias("ok"), P.callable_name(F.col("l")).alias("name")).collect()]
    assert got[0] == (True, "run") and not any(ok for ok, _ in got[1:])


def test_tie_break_settles_pairs_under_the_merge(spark):
    judged = spark.createDataFrame([("a", "b", 80.0, None, "x", "y"), ("c", "d", 74.9, None, "x", "y"), ("e", "f", 92.0, None, "x", "y"), ("g", "h", 85.0, "digits", "x", "y")] + [(f"p{i}", f"q{i}", 90.0, None, str(i), "z") for i in range(70)], "a string, b string, score double, veto string, norm_a string, norm_b string").coalesce(1)

    def decide(batch):
        assert len(batch) <= 30
        return [b == "y" or int(a) % 2 == 0 for a, b in batch]

    got = {r.a for r in entity.tie_break(entity.undecided(judged), decide).collect()}
    assert got == {"a"} | {f"p{i}" for i in range(0, 70, 2)}
