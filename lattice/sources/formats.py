"""Graph fragments from files with a known format: node-link JSON, catalogs, indexes, manifests, code."""

from __future__ import annotations

import ast
import json
import re
import tomllib
import zipfile
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.model import EDGE, HYPEREDGE, NODE, PropertyGraph
from lattice.operators.resolve import unique_index

FRAGMENT = "kind string, id string, label string, source string, target string, relation string, file string"
# Fixed limits of archives.
MAX_RATIO, MAX_BYTES, MAX_ENTRIES = 200, 2 << 30, 200_000


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    """A node-link JSON document; ``links`` or ``edges``, ``from``/``to`` or ``source``/``target``."""
    text = spark.read.text(path, wholetext=True)
    edge = EDGE + ", `from` string, `to` string"
    shape = f"struct<nodes: array<struct<{_colons(NODE)}>>, links: array<struct<{_colons(edge)}>>, edges: array<struct<{_colons(edge)}>>, hyperedges: array<struct<{_colons(HYPEREDGE)}>>>"
    doc = text.select(F.from_json("value", shape).alias("d"))
    nodes = doc.select(F.inline("d.nodes"))
    edges = doc.select(F.inline(F.coalesce("d.links", "d.edges"))).withColumns({"source": F.coalesce("source", "from"), "target": F.coalesce("target", "to")}).drop("from", "to")
    return PropertyGraph(nodes, edges, True, doc.select(F.inline("d.hyperedges")))


def _colons(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.strip().split(" ", 1) for part in ddl.split(", ")))


def catalog_graph(tables: DataFrame, foreign_keys: DataFrame, views: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relational catalog rows to nodes and edges: keys reference, views read from.

    tables: schema, name; foreign_keys: schema, name, ref_schema, ref_name; views: schema, name, ref_schema, ref_name.
    """
    ident = lambda s, n: F.concat_ws(".", s, n)
    nodes = tables.select(ident("schema", "name").alias("id"), F.col("name").alias("label"), F.lit("code").alias("file_type"), F.lit("catalog").alias("source_file"))
    nodes = nodes.unionAll(views.select(ident("schema", "name"), "name", F.lit("code"), F.lit("catalog")).distinct())
    link = lambda df, r: df.select(ident("schema", "name").alias("source"), ident("ref_schema", "ref_name").alias("target"), F.lit(r).alias("relation")).distinct()
    edges = link(foreign_keys, "references").unionAll(link(views, "reads_from"))
    return nodes, edges.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "relation")


def jdbc_catalog(spark: SparkSession, url: str, **options) -> tuple[DataFrame, DataFrame]:
    """The catalog of a live database through its information schema."""
    read = lambda query: spark.read.format("jdbc").options(url=url, query=query, **options).load()
    tables = read("SELECT table_schema AS schema, table_name AS name FROM information_schema.tables WHERE table_type = 'BASE TABLE' AND table_schema NOT IN ('pg_catalog', 'information_schema')")
    keys = read("SELECT k.table_schema AS schema, k.table_name AS name, c.table_schema AS ref_schema, c.table_name AS ref_name FROM information_schema.referential_constraints r JOIN information_schema.key_column_usage k ON k.constraint_name = r.constraint_name JOIN information_schema.constraint_column_usage c ON c.constraint_name = r.unique_constraint_name")
    views = read("SELECT view_schema AS schema, view_name AS name, table_schema AS ref_schema, table_name AS ref_name FROM information_schema.view_table_usage")
    return catalog_graph(tables, keys, views)


SCIP = "documents array<struct<relative_path: string, language: string, symbols: array<struct<symbol: string, kind: string, relationships: array<struct<symbol: string, is_implementation: boolean, is_type_definition: boolean, is_definition: boolean>>>>>>"


def scip_edges(index: DataFrame) -> DataFrame:
    """source, target, relation, external: a target in the same document first, else the one document that defines it, else a stub.

    index: one column ``doc`` of the SCIP shape.
    """
    docs = index.select(F.explode("doc.documents").alias("d"))
    symbols = docs.select(F.col("d.relative_path").alias("file"), F.explode("d.symbols").alias("s")).select("file", "s.symbol", "s.relationships")
    symbols = symbols.withColumn("id", F.concat_ws("#", "file", "symbol"))
    rel = symbols.select(F.col("id").alias("source"), "file", F.explode("relationships").alias("r"))
    relation = F.when(F.col("r.is_implementation"), "scip_impl").when(F.col("r.is_type_definition"), "scip_typed").when(F.col("r.is_definition"), "scip_def").otherwise("scip_ref")
    rel = rel.select("source", "file", F.col("r.symbol").alias("symbol"), relation.alias("relation"))
    near = symbols.select("file", "symbol", F.col("id").alias("own")).distinct()
    only = unique_index(symbols, ["symbol"], "id").withColumnRenamed("id", "one")
    rows = rel.join(near, ["file", "symbol"], "left").join(only, "symbol", "left")
    return rows.select("source", F.coalesce("own", "one", F.concat(F.lit("external#"), F.col("symbol"))).alias("target"), "relation", F.coalesce("own", "one").isNull().alias("external"))


def mcp_servers(configs: DataFrame) -> DataFrame:
    """Edges of server configurations: server to command, package and environment names. configs: path, text."""
    shape = "struct<mcpServers: map<string, struct<command: string, args: array<string>, env: map<string, string>>>>"
    rows = configs.select("path", F.explode(F.from_json("text", shape).getField("mcpServers")).alias("name", "s"))
    server = F.concat(F.lit("mcp:"), F.col("name"))
    package = F.filter("s.args", lambda a: F.regexp_like(a, F.lit(r"^(@[\w.-]+/)?[\w.-]+$")) & ~F.startswith(a, F.lit("-")))
    ends = F.flatten(F.array(F.array(F.struct(F.lit("runs").alias("relation"), F.concat(F.lit("command:"), F.col("s.command")).alias("target"))), F.coalesce(F.transform(package, lambda p: F.struct(F.lit("depends_on").alias("relation"), F.concat(F.lit("package:"), p).alias("target"))), F.array()), F.coalesce(F.transform(F.map_keys("s.env"), lambda e: F.struct(F.lit("requires_env").alias("relation"), F.concat(F.lit("env:"), e).alias("target"))), F.array())))
    return rows.select(server.alias("source"), F.inline(ends), F.col("path").alias("file")).where("target IS NOT NULL").select("source", "target", "relation", "file")


def parse_manifest(path: str, text: str) -> list[tuple]:
    """Rows of one package manifest: its package node and depends_on edges (some end nowhere until pruned)."""
    name, needs, base = None, [], path.rsplit("/", 1)[-1].lower()
    try:
        if base == "pyproject.toml":
            project = tomllib.loads(text).get("project", {})
            name, needs = project.get("name"), [re.split(r"[\s\[<>=!~;(]", d, maxsplit=1)[0] for d in project.get("dependencies", [])]
        elif base == "cargo.toml":
            data = tomllib.loads(text)
            name, needs = data.get("package", {}).get("name"), list(data.get("dependencies", {}))
        elif base == "package.json":
            data = json.loads(text)
            name, needs = data.get("name"), [*data.get("dependencies", {}), *data.get("devDependencies", {})]
        elif base == "go.mod":
            found = re.search(r"^module\s+(\S+)", text, re.M)
            name, needs = found and found[1], re.findall(r"^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+v\d", text, re.M)
        elif base == "pom.xml":
            ids = re.findall(r"<artifactId>([^<]+)</artifactId>", text)
            name, needs = (ids[0], ids[1:]) if ids else (None, [])
    except (ValueError, AttributeError, TypeError):
        return []
    if not name:
        return []
    out = [("node", f"package:{name}", name, None, None, None, path)]
    return out + [("edge", None, None, f"package:{name}", f"package:{n}", "depends_on", path) for n in dict.fromkeys(needs)]


def parse_python(path: str, text: str) -> list[tuple]:
    """Definitions, containment, imports, bases and raw calls of one Python source."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out, stack = [("node", path, path.rsplit("/", 1)[-1], None, None, None, path)], [(tree, path, "")]
    while stack:
        node, owner, prefix = stack.pop()
        for child in ast.iter_child_nodes(node):
            inside, name = owner, prefix
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{prefix}{child.name}."
                inside = f"{path}::{name[:-1]}"
                called = child.name if isinstance(child, ast.ClassDef) else f"{child.name}()"
                out += [("node", inside, called, None, None, None, path), ("edge", None, None, owner, inside, "contains", path)]
                if isinstance(child, ast.ClassDef):
                    out += [("edge", None, None, inside, b.id, "inherits", path) for b in child.bases if isinstance(b, ast.Name)]
            elif isinstance(child, ast.Import):
                out += [("edge", None, None, path, a.name, "imports", path) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                out += [("edge", None, None, path, f"{child.module or '.'}.{a.name}", "imports_from", path) for a in child.names]
            elif isinstance(child, ast.Call) and isinstance(child.func, ast.Name | ast.Attribute):
                out.append(("call", None, None, owner, getattr(child.func, "id", None) or child.func.attr, "calls", path))
            stack.append((child, inside, name))
    return out


def parse_blade(path: str, text: str) -> list[tuple]:
    """Includes, components and bound methods of one template."""
    out = [("node", path, path.rsplit("/", 1)[-1], None, None, None, path)]
    for relation, pattern in (("includes", r"@(?:include|extends|each)\(\s*['\"]([^'\"]+)"), ("uses_component", r"<(?:livewire:|x-)([\w.-]+)"), ("binds_method", r"wire:\w+(?:\.\w+)*=\"([\w]+)")):
        out += [("edge", None, None, path, t, relation, path) for t in dict.fromkeys(re.findall(pattern, text))]
    return out


#: Extractor by file suffix or name; register more with :func:`register`.
EXTRACTORS = {".py": parse_python, ".blade.php": parse_blade, "pyproject.toml": parse_manifest, "cargo.toml": parse_manifest, "package.json": parse_manifest, "go.mod": parse_manifest, "pom.xml": parse_manifest}


def register(suffix: str, extractor) -> None:
    EXTRACTORS[suffix] = extractor


def extract(files: DataFrame) -> DataFrame:
    """Node, edge and call rows of files (path, text) by the registered extractors; one that fails yields nothing for its file."""
    table = dict(EXTRACTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf.path, pdf.text, strict=True):
                found = next((f for s, f in table.items() if path.lower().endswith(s)), None)
                rows += found(path, text or "") if found else []
            yield pd.DataFrame(rows, columns=["kind", "id", "label", "source", "target", "relation", "file"])

    return files.select("path", "text").mapInPandas(run, FRAGMENT)


def unzip(archives: DataFrame, max_ratio: int = MAX_RATIO, max_bytes: int = MAX_BYTES, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """path, entry, size, text of safe archive members: no absolute or climbing paths, no bombs. archives: path, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                rows, total = [], 0
                try:
                    with zipfile.ZipFile(BytesIO(content)) as z:
                        for info in z.infolist()[:max_entries]:
                            name = info.filename
                            total += info.file_size
                            if total > max_bytes:
                                break
                            if name.endswith("/") or name.startswith("/") or ".." in name.split("/") or info.file_size > max_ratio * max(info.compress_size, 1):
                                continue
                            rows.append((path, name, info.file_size, z.read(info).decode("utf-8", "replace")))
                except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError):
                    rows = []
                yield pd.DataFrame(rows, columns=["path", "entry", "size", "text"])

    return archives.select("path", "content").mapInPandas(run, "path string, entry string, size long, text string")
