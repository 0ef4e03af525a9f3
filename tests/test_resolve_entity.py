import datetime as dt

import pytest
from pyspark.sql import functions as F

from lattice.operators import entity, grouping, memory, resolve


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


PAIRS = [
    ("graph extractor pipeline", "graph extractor pipelime", "a.py", "a.py", "concept", "concept", True),
    ("database connection pool", "user interface theme", "a.py", "a.py", "concept", "concept", False),
    ("gpt 4 turbo", "gpt 4 turbx", "a", "a", "concept", "concept", False),
    ("extractor", "extractar", "a", "a", "concept", "concept", False),
    ("get active session", "get active sessions", "a", "a", "concept", "concept", False),
    ("adr 0011 decision record", "adr 0013 decision record", "a", "a", "concept", "concept", False),
    ("adr 011 decision record", "adr 11 decision recorx", "a", "a", "concept", "concept", True),
    ("django app config for apps users", "django app config for apps userz", "a", "b", "rationale", "rationale", False),
    ("overview of the system", "overview of the systen", "a", "b", "document", "document", False),
    ("shared concept label", "shared concept label", "a", "b", "concept", "concept", False),
    ("attention is all you need", "attention is all you needs it", "a", "b", "concept", "concept", False),
]


@pytest.mark.parametrize(("a", "b", "fa", "fb", "ta", "tb", "want"), PAIRS)
def test_merge_decisions(spark, a, b, fa, fb, ta, tb, want):
    row = frame(spark, "norm_a string, norm_b string, source_file_a string, source_file_b string, file_type_a string, file_type_b string", (a, b, fa, fb, ta, tb))
    assert entity.judge_pairs(row).first().accepted == want


def test_deduplicate(spark):
    nodes = frame(
        spark,
        "id string, label string, file_type string, source_file string, community int, ord long",
        ("n1", "Graph Extractor Pipeline", "concept", "a.md", 0, 1),
        ("n2_c1", "graph-extractor pipeline", "concept", "a.md", 0, 2),
        ("n3", "Graph Extractor Pipelime", "concept", "a.md", 0, 3),
        ("n4", "Unrelated Database Thing", "concept", "a.md", 0, 4),
        ("n5", "Graph Extractor Pipeline", "code", "a.md", 0, 5),
        ("n4", "second row of an id", "concept", "b.md", 0, 6),
    )
    edges = frame(spark, "source string, target string, relation string", ("n1", "n2_c1", "x"), ("n3", "n4", "y"))
    kept, wired, remap = entity.deduplicate(spark, nodes, edges)
    assert sorted(r.id for r in kept.collect()) == ["n1", "n4", "n5"]
    assert [tuple(r)[:3] for r in wired.select("source", "target", "relation").collect()] == [("n1", "n4", "y")]
    assert {r.id: r.winner for r in remap.collect()} == {"n2_c1": "n1", "n3": "n1"}


def test_call_tiers(spark):
    calls = frame(spark, "call_id long, file string, callee string", (1, "a.ts", "local"), (2, "a.ts", "imported"), (3, "a.ts", "print"), (4, "a.ts", "once"), (5, "a.ts", "twice"), (6, "a.ts", "never"))
    symbols = frame(spark, "id string, file string, name string", ("s1", "a.ts", "local"), ("s1b", "b.ts", "local"), ("s2", "b.ts", "imported"), ("s3", "c.ts", "print"), ("s4", "c.ts", "once"), ("s5", "c.ts", "twice"), ("s6", "d.ts", "twice"))
    imports = frame(spark, "file string, name string, from_file string", ("a.ts", "imported", "b.ts"))
    got = {(r.call_id, r.target, r.confidence) for r in resolve.call_tiers(calls, symbols, imports, ("print",)).collect()}
    assert got == {(1, "s1", "EXTRACTED"), (2, "s2", "EXTRACTED"), (4, "s4", "INFERRED"), (5, "s5", "AMBIGUOUS"), (5, "s6", "AMBIGUOUS")}


def test_proximity(spark):
    def pick(call_file, *files):
        rows = frame(spark, "call_id long, call_file string, target string, target_file string", *((1, call_file, f"t{i}", f) for i, f in enumerate(files)))
        return [r.target for r in resolve.nearest_candidate(rows).collect()]

    assert pick("a/b/x.py", "a/b/x.py", "a/b/y.py") == ["t0"]
    assert pick("a/b/x.py", "q/z.py", "a/b/y.py") == ["t1"]
    assert pick("a/b/x.py", "a/c/z.py", "d/y.py") == ["t0"]
    assert pick("a/b/x.py", "c/z.py", "d/y.py") == []
    assert pick("a/b/x.py", "a/b/z.py", "a/b/y.py") == []
    assert pick("a/x.py", "tests/test_x.py", "far/y.py") == ["t1"]
    assert pick("tests/test_x.py", "tests/helper.py", "src/helper.py") == ["t0"]
    assert pick("c/x.py", "a/only.py") == ["t0"]


def test_dispatch_and_scopes(spark):
    classes = frame(spark, "class_id string", ("A",), ("B",), ("C",))
    inherits = frame(spark, "class_id string, base_id string", ("B", "A"), ("C", "B"), ("A", "C"))
    methods = frame(spark, "id string, class_id string, name string", ("A.f", "A", "f"), ("B.f", "B", "f"), ("A.g", "A", "g"))
    got = {(r.class_id, r.name): r.target for r in resolve.dispatch(resolve.class_closure(inherits, classes, 4), methods).collect()}
    assert got[("C", "f")] == "B.f" and got[("C", "g")] == "A.g" and got[("A", "f")] == "A.f"
    scopes = frame(spark, "scope string, parent string", ("inner", "outer"), ("outer", None))
    bound = frame(spark, "scope string, name string, value string", ("outer", "x", "1"), ("inner", "y", "2"), ("outer", "y", "3"))
    uses = frame(spark, "use_id int, scope string, name string", (1, "inner", "x"), (2, "inner", "y"), (3, "outer", "y"))
    assert {r.use_id: r.value for r in resolve.scope_lookup(scopes, bound, uses).collect()} == {1: "1", 2: "2", 3: "3"}


def test_alias_chain(spark):
    aliases = frame(spark, "file string, name string, target string", ("f", "a", "b"), ("f", "b", "c"), ("f", "x", "x"))
    names = frame(spark, "file string, name string", ("f", "a"), ("f", "x"), ("g", "a"))
    assert {(r.file, r.name): r.resolved for r in resolve.alias_targets(aliases, names).collect()} == {("f", "a"): "c", ("f", "x"): "x", ("g", "a"): "a"}


def test_member_and_sourced_calls(spark):
    calls = frame(spark, "call_id int, receiver_type string, callee string", (1, "Dog", "bark"), (2, "Cat", "meow"))
    classes = frame(spark, "id string, label string", ("c1", "Dog"), ("c2", "Cat"), ("c3", "Cat"))
    methods = frame(spark, "id string, class_id string, name string", ("m1", "c1", "bark"), ("m2", "c2", "meow"))
    assert [tuple(r) for r in resolve.member_calls(calls, classes, methods).collect()] == [(1, "m1")]
    sources = frame(spark, "file string, sourced string", ("a.sh", "lib.sh"))
    functions = frame(spark, "file string, name string, id string", ("lib.sh", "go", "lib#go"), ("other.sh", "go", "other#go"))
    shell = frame(spark, "caller string, callee string, file string", ("a.sh", "go", "a.sh"))
    assert [tuple(r) for r in resolve.sourced_calls(sources, functions, shell).collect()] == [("a.sh", "lib#go")]


def test_lessons(spark):
    now = F.lit(dt.datetime(2026, 1, 31))
    day = dt.datetime
    docs = frame(spark, "doc int, date timestamp, question string, outcome string, source_nodes array<string>", (1, day(2026, 1, 31), "q1", "useful", ["a", "a", "b"]), (2, day(2026, 1, 1), "q1", "useful", ["a"]), (3, day(2026, 1, 31), "q2", "dead_end", ["b", "c"]), (4, None, "q3", "corrected", ["c"]), (5, day(2026, 1, 1), "q4", None, ["a"]), (6, day(2026, 3, 1), "q5", "useful", ["d"]))
    events = memory.events_of(docs, now)
    got = {r.node: (r.bucket, r.verdict, r.score) for r in memory.lessons(memory.node_scores(events)).collect()}
    assert got == {"a": ("preferred", None, 1.5), "b": ("contested", "even", 0.0), "d": ("tentative", None, 1.0)}
    assert {r.question: r.doc for r in memory.latest_per_question(docs).collect()}["q1"] == 1


def test_grouping(spark):
    files = frame(spark, "path string", ("src/auth/login/a.ts",), ("src/auth/login/b.ts",), ("src/billing/pay.ts",), ("src/main.ts",))
    got = {r.path: (r.category, r.feature) for r in grouping.folder_partition(files).collect()}
    assert got["src/auth/login/a.ts"] == ("auth", "login") and got["src/billing/pay.ts"] == ("billing", "pay") and got["src/main.ts"] == ("main", "main")
    names = frame(spark, "id string, name string", ("1", "createOrder"), ("2", "helper"), ("3", "get"))
    assert [(r.id, r.verb, r.noun) for r in grouping.entry_points(names).collect()] == [("1", "create", "order")]
    tiers = frame(spark, "path string", ("src/utils/x.ts",), ("src/logger.ts",), ("src/services/y.ts",), ("src/b.ts",), ("src/c.ts",))
    defs = frame(spark, "path string", ("src/c.ts",), ("src/utils/x.ts",))
    assert [r.tier for r in grouping.file_tiers(tiers, defs).orderBy("path").collect()] == ["barrel", "business", "common", "layer", "common"]
