import datetime as dt
import io
import json
import zipfile

from lattice.model import PropertyGraph
from lattice.sources import files, formats
from lattice.streaming import streams
from pyspark.sql import functions as F


def test_classify(spark):
    rows = [("a/b.py", "", "code"), ("x.blade.php", "", "code"), ("run", "#!/usr/bin/env -S python3 -u\n", "code"), ("run2", "#!/bin/unknown", None), ("p.pdf", "", "paper"), ("n.md", "abstract arxiv doi: 1", "paper"), ("n2.md", "hello", "document"), ("i.png", "", "image"), ("go.mod", "", "code"), ("bin.dat", "", None)]
    df = spark.createDataFrame(rows, "path string, head string, want string").withColumn("got", files.classify(F.col("path"), F.col("head")))
    assert all(r.got == r.want for r in df.collect())


def test_sensitive(spark):
    rows = [(".ssh/x", True), ("a/.env", True), ("a/environment.py", False), ("api_token.txt", True), ("token-economics-of-recall.md", False), ("secret_handler.txt", True), ("tokenizer.py", False), ("credentials", True), ("k.pem", True), ("password-policy-discussion.md", False)]
    df = spark.createDataFrame(rows, "path string, want boolean").withColumn("got", files.sensitive(F.col("path")))
    assert {r.path: r.got for r in df.collect()} == dict(rows)


def test_extractors(spark):
    rows = [("a.py", "import os\nfrom x import y\nclass A(B):\n    def f(self):\n        g()\n"), ("bad.py", "def ("), ("pyproject.toml", '[project]\nname = "p"\ndependencies = ["q>=1", "r[x]"]'), ("v.blade.php", "@include('part') <x-card> wire:click=\"save\""), ("go.mod", "module m/n\nrequire ex.com/z v1.2.3\n"), ("note.txt", "nothing")]
    out = [tuple(r) for r in formats.extract(spark.createDataFrame(rows, "path string, text string")).collect()]
    edges = {(s, t, r) for k, _, _, s, t, r, _ in out if k == "edge"}
    assert {("a.py", "os", "imports"), ("a.py", "x.y", "imports_from"), ("a.py", "a.py::A", "contains"), ("a.py::A", "a.py::A.f", "contains"), ("a.py::A", "B", "inherits"), ("package:p", "package:q", "depends_on"), ("package:p", "package:r", "depends_on"), ("v.blade.php", "part", "includes"), ("v.blade.php", "card", "uses_component"), ("v.blade.php", "save", "binds_method"), ("package:m/n", "package:ex.com/z", "depends_on")} <= edges
    assert ("call", None, None, "a.py::A.f", "g", "calls", "a.py") in out and not any(f == "bad.py" for *_, f in out)


def test_graph_document(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "label": "A"}], "edges": [{"from": "a", "to": "b", "relation": "calls"}], "hyperedges": [{"id": "h", "nodes": ["a", "b"]}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    g = formats.read_graph(spark, f"file://{tmp_path}/g.json")
    assert [(r.source, r.target) for r in g.edges.collect()] == [("a", "b")] and g.nodes.count() == 1 and g.hyperedges.first().nodes == ["a", "b"]


def test_catalog_and_index(spark):
    tables = spark.createDataFrame([("p", "organizations"), ("p", "users")], "schema string, name string")
    keys = spark.createDataFrame([("p", "users", "p", "organizations"), ("p", "users", "p", "lost")], "schema string, name string, ref_schema string, ref_name string")
    views = spark.createDataFrame([("p", "active", "p", "users")], keys.schema)
    nodes, edges = formats.catalog_graph(tables, keys, views)
    assert nodes.count() == 3 and {tuple(r) for r in edges.collect()} == {("p.users", "p.organizations", "references"), ("p.active", "p.users", "reads_from")}
    index = {"documents": [{"relative_path": "a", "symbols": [{"symbol": "S", "relationships": [{"symbol": "T", "is_implementation": True}, {"symbol": "U"}, {"symbol": "S2"}]}, {"symbol": "S2"}]}, {"relative_path": "b", "symbols": [{"symbol": "T"}, {"symbol": "S2"}]}]}
    df = spark.createDataFrame([(json.dumps(index),)], "j string").select(F.from_json("j", f"struct<{formats.SCIP.replace(' array', ': array', 1)}>").alias("doc"))
    assert {(r.target, r.relation, r.external) for r in formats.scip_edges(df).collect()} == {("b#T", "scip_impl", False), ("external#U", "scip_ref", True), ("a#S2", "scip_ref", False)}
    mcp = json.dumps({"mcpServers": {"fs": {"command": "npx", "args": ["-y", "@scope/server"], "env": {"KEY": "1"}}}})
    got = {(r.source, r.target, r.relation) for r in formats.mcp_servers(spark.createDataFrame([("c.json", mcp)], "path string, text string")).collect()}
    assert got == {("mcp:fs", "command:npx", "runs"), ("mcp:fs", "package:@scope/server", "depends_on"), ("mcp:fs", "env:KEY", "requires_env")}


def test_unzip_is_safe(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in (("ok.py", "x = 1"), ("../up.py", "x"), ("/abs.py", "x"), ("bomb.txt", "0" * 10_000_000)):
            z.writestr(name, body)
    df = spark.createDataFrame([("a.zip", bytearray(buffer.getvalue())), ("b.zip", bytearray(b"junk"))], "path string, content binary")
    assert [r.entry for r in formats.unzip(df).collect()] == ["ok.py"]


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x")
    (tmp_path / "node_modules" / "b.js").write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in files.scan(spark, str(tmp_path)).collect()] == ["a.py"]


def test_manifest_and_pack(spark):
    now = spark.createDataFrame([("a", 1.0, "h1"), ("b", 2.0, "h2"), ("c", 3.0, "x")], "path string, mtime double, hash string")
    then = spark.createDataFrame([("a", 1.0, "old"), ("b", 1.0, "h2"), ("c", 1.0, "y"), ("d", 1.0, "z")], "path string, mtime double, hash string")
    assert {r.path: r.state for r in files.manifest_diff(now, then).collect()} == {"a": "unchanged", "b": "unchanged", "c": "changed", "d": "deleted"}
    packed = files.pack(spark.createDataFrame([("s/a", 5), ("s/b", 5), ("s/c", 90), ("s/d", 1)], "path string, tokens int"), 10)
    assert {r.path: r.chunk for r in packed.collect()} == {"s/a": 0, "s/b": 0, "s/c": 1, "s/d": 2}


def test_upsert_stream(spark, tmp_path):
    schema = "id string, source_file string, v int, ord long"
    store = streams.SnapshotStore(spark, f"file://{tmp_path}/store")
    for k, rows in enumerate(([("a", "f", 1, 1), ("b", "f", 1, 2), ("c", "g", 1, 3)], [("a", "f", 2, 4), ("a", "f", 3, 5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/cp").awaitTermination()
        assert store.version() == k
    assert sorted((r.id, r.v) for r in store.read().collect()) == [("a", 3), ("c", 1)]


def test_decayed_scores_stream(spark, tmp_path):
    schema = "node string, ts timestamp, sign int"
    rows = [("a", dt.datetime(2026, 1, 1), 1), ("a", dt.datetime(2026, 1, 31), 1), ("b", dt.datetime(2026, 1, 1), -1)]
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.decayed_scores(stream).writeStream.format("memory").queryName("scores").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    last = {r.node: r.score for r in spark.sql("SELECT node, max_by(score, last) AS score FROM scores GROUP BY node").collect()}
    assert abs(last["a"] - 1.5) < 1e-9 and abs(last["b"] + 1) < 1e-9


def test_windows_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/", pathGlobFilter="events.parquet")
    streams.tumbling(stream).writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("tumbling")) == key(streams.tumbling(events))


def test_query_log(spark, tmp_path):
    spark.createDataFrame([("what", 3)], "question string, n int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("question string, n int").parquet(f"{tmp_path}/in")
    streams.append_log(stream, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.json(f"{tmp_path}/log").first().question == "what"


def test_empty_graph_queries(spark):
    from lattice.model import EDGE, NODE
    from lattice.operators import stats

    g = PropertyGraph(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE))
    assert stats.god_nodes(g).count() == 0 and stats.cohesion(g).count() == 0 and stats.confidence_mix(g).count() == 0
