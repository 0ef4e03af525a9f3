from lattice.api import GraphQueries, contexts_of
from lattice.model import EDGE, NODE, PropertyGraph
from lattice.operators import cleanup


def graph(spark):
    names = ("extract", "cluster", "build", "report", "isolated")
    nodes = spark.createDataFrame([(f"n{i}", n, "code", f"{n}.py", "L1", i // 2) for i, n in enumerate(names, 1)], NODE)
    edges = spark.createDataFrame([("n1", "n2", "calls", "INFERRED", 1.0, "call", "a"), ("n2", "n3", "imports", "EXTRACTED", 1.0, "import", "a"), ("n3", "n4", "uses", "EXTRACTED", 1.0, None, "a")], EDGE)
    return PropertyGraph(nodes, edges)


def test_query_graph(spark):
    q = GraphQueries(spark, graph(spark))
    lines = [r.line for r in q.query_graph("extract", depth=2).orderBy("cum_chars").collect()]
    assert lines[0].startswith("NODE extract ") and len(lines) == 5
    assert sum(x.startswith("EDGE") for x in lines) == 2
    assert [r.kind for r in q.query_graph("who calls extract").collect()].count("edge") == 1
    assert q.query_graph("extract", token_budget=15).count() == 1
    assert q.query_graph("nothing like it").count() == 0
    assert {r.line for r in q.query_graph("extract", mode="dfs", depth=2).collect()} == set(lines)


def test_tools(spark):
    q = GraphQueries(spark, graph(spark))
    assert q.get_node("REPORT").first().degree == 1
    assert [(r.src, r.dst, r.relation, r.forward) for r in q.shortest_path("report", "cluster").orderBy("hop").collect()] == [("n4", "n3", "uses", False), ("n3", "n2", "imports", False)]
    assert q.shortest_path("report", "no such").count() == 0
    assert {r.id for r in q.affected("build").collect()} == {"n1", "n2"}
    assert q.get_community(1).count() == 2 and q.god_nodes(1).first()["rank"] == 1 and q.surprising_connections().count() > 0
    assert contexts_of("Who calls this?") == ["call"]


def test_diff_ignores_direction(spark):
    g = graph(spark)
    turned = PropertyGraph(g.nodes.where("id != 'n5'"), g.edges.selectExpr("target AS source", "source AS target", "relation", "confidence", "weight", "context", "source_file"))
    assert [tuple(r) for r in GraphQueries(spark, g).diff(turned).collect()] == [("removed", "node", "n5")]


def test_clean_fragment(spark):
    nodes = spark.createDataFrame([("a", "Parser", "code"), ("b", "We chose this parser because it is fast: really.", "document"), ("c", "idea", "concept"), ("", "lost", "code"), ("d", "Reader", "code")], "id string, label string, file_type string")
    edges = spark.createDataFrame([("b", "a", "rationale_for"), ("c", "a", "uses"), ("a", "d", "calls")], "source string, target string, relation string")
    hyper = spark.createDataFrame([("h", ["a", "c", "d"]), ("i", ["a", "c"])], "id string, nodes array<string>")
    n, e, h = cleanup.clean_fragment(nodes, edges, hyper)
    assert {r.id: r.rationale for r in n.collect()} == {"a": "We chose this parser because it is fast: really.", "d": None}
    assert [tuple(r) for r in e.collect()] == [("a", "d", "calls")] and [(r.id, r.nodes) for r in h.collect()] == [("h", ["a", "d"])]


def test_stale_ids(spark):
    rows = [("auth_login", False, "src/auth.py"), ("src_auth_login", False, "src/auth.py"), ("api_auth", False, "src/api/auth.py"), ("auth_x", True, "src/auth.py"), ("other", False, "src/auth.py")]
    nodes = spark.createDataFrame(rows, "id string, parsed boolean, source_file string")
    assert {r.id: r.winner for r in cleanup.stale_ids(nodes).collect()} == {"auth_login": "src_auth_login", "api_auth": "src_api_auth"}


def test_cross_language_calls(spark):
    nodes = spark.createDataFrame([("p", "a.py"), ("j", "b.ts"), ("x", "c.weird"), ("n", "README")], "id string, source_file string")
    rows = [("p", "j", "calls", "INFERRED"), ("p", "j", "calls", "EXTRACTED"), ("p", "x", "calls", "INFERRED"), ("p", "n", "calls", "INFERRED"), ("p", "p", "calls", "INFERRED")]
    edges = spark.createDataFrame(rows, "source string, target string, relation string, confidence string")
    assert sorted(map(tuple, cleanup.drop_cross_language_calls(edges, nodes).collect())) == sorted([rows[1], rows[3], rows[4]])


def test_rebuild(spark):
    node, edge = "id string, source_file string, parsed boolean", "source string, target string, source_file string"
    old = spark.createDataFrame([("a", "f", True), ("b", "f", True), ("c", "g", True), ("s", "f", False), ("d", "gone", True)], node)
    oe = spark.createDataFrame([("a", "b", "f"), ("c", "a", "g"), ("c", "d", "g")], edge)
    new, ne = spark.createDataFrame([("a", "f", True)], node), spark.createDataFrame([], edge)
    files = lambda *f: spark.createDataFrame([(x,) for x in f], "source_file string")
    n, e = cleanup.rebuild(old, oe, new, ne, files("f"), files("gone"), full=False)
    assert {r.id for r in n.collect()} == {"a", "c"} and [tuple(r) for r in e.collect()] == [("c", "a", "g")]
    n, _ = cleanup.rebuild(old, oe, new, ne, files("f", "g"), files("gone"), full=True)
    assert {r.id for r in n.collect()} == {"a", "s"}
