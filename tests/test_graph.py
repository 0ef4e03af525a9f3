import random

import pytest

from lattice.model import EDGE, NODE, PropertyGraph
from lattice.operators import analysis, communities, merge, search, stats, traverse
from lattice.operators.components import connected_components


def nodes_of(spark, rows):
    return spark.createDataFrame(rows, NODE)


def edges_of(spark, rows):
    return spark.createDataFrame([(s, t, r, c, w, None, f) for s, t, r, c, f, w in rows], EDGE)


@pytest.fixture(scope="module")
def model(spark):
    """A small mixed graph: every confidence, two files, equal degrees."""
    nodes = nodes_of(spark, [("n_transformer", "Transformer", "code", "model.py", "L1", 0), ("n_attention", "MultiHeadAttention", "code", "model.py", "L10", 0), ("n_layernorm", "LayerNorm", "code", "model.py", "L20", 0), ("n_concept_attn", "attention mechanism", "document", "paper.md", "§3.1", 1)])
    edges = edges_of(spark, [("n_transformer", "n_attention", "contains", "EXTRACTED", "model.py", 1.0), ("n_transformer", "n_layernorm", "contains", "EXTRACTED", "model.py", 1.0), ("n_attention", "n_concept_attn", "implements", "INFERRED", "model.py", 0.8), ("n_layernorm", "n_concept_attn", "referenced", "AMBIGUOUS", "paper.md", 0.5)])
    return PropertyGraph(nodes, edges)


def test_degrees_and_hubs(model):
    assert {r.id: r.degree for r in model.degrees().collect()} == dict.fromkeys(("n_transformer", "n_attention", "n_layernorm", "n_concept_attn"), 2)
    assert [r.id for r in stats.god_nodes(model, 2).collect()] == ["n_attention", "n_concept_attn"]


def test_surprises_rank_the_uncertain_first(model):
    rows = analysis.surprises(model).collect()
    assert [(r.source, r.score) for r in rows] == [("n_layernorm", 8), ("n_attention", 7)]
    assert "bridges communities" in rows[0].why


def test_questions(model, spark):
    kinds = [r.type for r in analysis.questions(model).collect()]
    assert kinds[0] == "ambiguous_edge" and "no_signal" not in kinds
    quiet = PropertyGraph(model.nodes.limit(0), model.edges.limit(0))
    assert [r.type for r in analysis.questions(quiet).collect()] == ["no_signal"]


@pytest.fixture(scope="module")
def line(spark):
    nodes = nodes_of(spark, [(f"n{i}", name, "code", f"{name}.py", "L1", c) for i, (name, c) in enumerate([("extract", 0), ("cluster", 0), ("build", 1), ("report", 1), ("isolated", 2)], 1)])
    edges = edges_of(spark, [("n1", "n2", "calls", "INFERRED", "a", 1.0), ("n2", "n3", "imports", "EXTRACTED", "a", 1.0), ("n3", "n4", "uses", "EXTRACTED", "a", 1.0)])
    return PropertyGraph(nodes, edges)


@pytest.mark.parametrize(("start", "depth", "want"), [("n1", 1, {"n1", "n2"}), ("n1", 2, {"n1", "n2", "n3"}), ("n5", 3, {"n5"})])
def test_bfs(spark, line, start, depth, want):
    assert {r.id for r in traverse.bfs(spark, line, spark.createDataFrame([(start,)], "id string"), depth).collect()} == want


def test_shortest_path(spark, line):
    rows = traverse.shortest_path(spark, line, "n4", "n1").orderBy("hop").collect()
    assert [(r.src, r.dst) for r in rows] == [("n4", "n3"), ("n3", "n2"), ("n2", "n1")]
    assert traverse.shortest_path(spark, line, "n1", "n5").count() == 0


def test_hub_is_reached_but_not_crossed(spark):
    edges = edges_of(spark, [("s", "hub", "calls", "EXTRACTED", "a", 1.0)] + [("hub", f"x{i}", "calls", "EXTRACTED", "a", 1.0) for i in range(60)])
    ids = ["s", "hub", *(f"x{i}" for i in range(60))]
    g = PropertyGraph(nodes_of(spark, [(i, i, "code", "a.py", "L1", 0) for i in ids]), edges)
    found = lambda s: {r.id for r in traverse.bfs(spark, g, spark.createDataFrame([(s,)], "id string"), 3).collect()}
    assert found("s") == {"s", "hub"} and len(found("hub")) == 62


def test_impact(spark):
    edges = edges_of(spark, [("X", "Foo", "calls", "EXTRACTED", "x.py", 1.0), ("init", "Foo", "re_exports", "EXTRACTED", "i.py", 1.0), ("app", "Foo", "imports", "EXTRACTED", "app.py", 1.0), ("far", "X", "calls", "EXTRACTED", "f.py", 1.0), ("not", "Foo", "contains", "EXTRACTED", "f.py", 1.0)])
    g = PropertyGraph(nodes_of(spark, [(i, i, "code", "a.py", "L1", 0) for i in ("X", "init", "app", "far", "not", "Foo")]), edges, True)
    got = {(r.id, r.depth, r.via_relation) for r in traverse.affected(spark, g, spark.createDataFrame([("Foo",)], "id string")).collect()}
    assert got == {("X", 1, "calls"), ("init", 1, "re_exports"), ("app", 1, "imports"), ("far", 2, "calls")}


def test_search(line):
    assert [r.id for r in search.ranked(search.score_nodes(line.nodes, "cluster")).collect()][0] == "n2"
    assert search.resolve_seed(line.nodes, "report").first().id == "n4"
    assert {r.id: r.tier for r in search.find_node(line.nodes, "ext").collect()} == {"n1": 2}
    assert search.score_nodes(line.nodes, "").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(40)] + [(1000, 1000 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in rows:
        parent[find(a)] = find(b)
    low = {}
    for x in list(parent):
        low[find(x)] = min(low.get(find(x), x), x)
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame([*rows, (None, 3)], "src long, dst long")).collect()}
    assert got == {x: low[find(x)] for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark, spark.createDataFrame([], "src long, dst long")).count() == 0


def test_cycles(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "d"), ("c", "d")]
    got = {r.cycle for r in traverse.cycles(spark.createDataFrame(rows, "source string, target string")).collect()}
    assert got == {"d", "a->b", "a->b->c"}


def test_louvain_two_cliques(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", "calls", "EXTRACTED", "f", 1.0) for i in range(4) for j in range(i)]
    edges = edges_of(spark, [*clique("a"), *clique("b"), ("a0", "b0", "calls", "AMBIGUOUS", "f", 1.0)])
    ids = [f"{p}{i}" for p in "ab" for i in range(4)] + ["z"]
    nodes = nodes_of(spark, [(i, i, "code", "f", "L1", 0) for i in ids])
    got = {r.id: r.community for r in communities.louvain(spark, nodes, edges).collect()}
    assert {got[f"a{i}"] for i in range(4)} == {0} and {got[f"b{i}"] for i in range(4)} == {1} and got["z"] == 2


def test_betweenness_of_a_path(spark, line):
    got = {r.id: r.betweenness for r in communities.betweenness(spark, line.nodes, line.edges).collect()}
    assert got["n2"] == got["n3"] == pytest.approx(2 * 2 / 12) and got["n1"] == got["n5"] == 0


def test_remap_keeps_names(spark):
    old = spark.createDataFrame([("a", 5), ("b", 5), ("c", 7)], "id string, community int")
    new = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 2)], "id string, community int")
    assert communities.remap_communities(old, new) == {0: 5, 1: 7, 2: 0}


def test_merge_operators(spark):
    nodes = spark.createDataFrame([("a", "x", True, "p/f.py"), ("b", "x", False, "q/f.py"), ("c", "y", False, "f.py")], "id string, label string, parsed boolean, source_file string")
    assert [tuple(r) for r in merge.merge_ghosts(nodes).collect()] == [("b", "a")]
    hyper = spark.createDataFrame([("h", "H", ["a", "b", "zz"]), ("i", "I", ["a", "zz"])], "id string, label string, nodes array<string>")
    assert [(r.id, r.nodes) for r in merge.surviving_hyperedges(hyper, nodes).collect()] == [("h", ["a", "b"])]
    more = spark.createDataFrame([("h", "other", ["a"]), ("j", "J", ["b"])], "id string, label string, nodes array<string>")
    assert sorted((r.id, r.label) for r in merge.attach_hyperedges(hyper, more).collect()) == [("h", "H"), ("i", "I"), ("j", "J")]


def test_results_do_not_depend_on_partitioning(model):
    shuffled = PropertyGraph(model.nodes.repartition(7), model.edges.repartition(5))
    for f in (stats.god_nodes, stats.cohesion, analysis.surprise_scores, stats.diagnostics and stats.hub_labels):
        assert sorted(map(tuple, f(model).collect())) == sorted(map(tuple, f(shuffled).collect()))
