"""Files as tables: scanning, classifying, filtering, manifests, caches, slicing and packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattice.functions import predicates as P

# Fixed word lists, patterns and thresholds.
MANIFESTS = ("package.json", "pyproject.toml", "go.mod", "pom.xml", "cargo.toml", "apm.yml")
NOISE_DIRS = ("node_modules", ".git", "__pycache__", "dist", "build", ".venv", "venv", "target")
SENSITIVE_DIRS = (".ssh", ".gnupg", ".aws", ".gcloud", "secrets", ".secrets", "credentials")
SENSITIVE_NAMES = (r"(?i)^\.(env|envrc)(\.|$)", r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$", r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$", r"(?i)(\.netrc|\.pgpass|\.htpasswd)$", r"(?i)(aws_credentials|gcloud_credentials|service.account)")
KEYWORDS = (r"(?i)(?<![a-zA-Z0-9])(credential|secret|passwd|password|private_key)s?(?![a-zA-Z])", r"(?i)(?<![a-zA-Z0-9])tokens?(?![a-zA-Z])")
PAPER_SIGNALS = (r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{", r"\[\d+\]", r"\[\n\d+\n\]", r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b")
PAPER_AT, PAPER_CHARS = 3, 3000
INTERPRETERS = ("python", "python2", "python3", "ruby", "perl", "node", "nodejs", "bash", "sh", "dash", "zsh", "fish", "ksh", "tcsh", "lua", "php", "julia", "Rscript")
SMALL_WORDS, LARGE_WORDS, LARGE_FILES = 50_000, 500_000, 500


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime, length, content of every file below ``root``; noise directories pruned after listing."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(d) for d in NOISE_DIRS))))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def paper_signals(text: Column) -> Column:
    """How many of the fixed signals the first 3,000 characters show; the rule reads no more."""
    head = F.substring(text, 1, PAPER_CHARS)
    return sum((F.regexp_like(head, F.lit(p)).cast("int") for p in PAPER_SIGNALS), F.lit(0))


def shebang(head: Column) -> Column:
    """The interpreter that a first line names, env and its options and assignments skipped; null if none is known."""
    line = F.regexp_extract(head, r"^#!\s*([^\r\n]*)", 1)
    rest = F.regexp_replace(line, r"^\S*/?env\s+((-S\s*|--split-string[= ]|-\S+\s+|\w+=\S*\s+)*)", "")
    name = F.regexp_extract(rest, r"^(?:\S*/)?([^\s/]+)", 1)
    return F.when(name.isin(*INTERPRETERS) | F.regexp_like(name, F.lit(r"^(python|ruby|lua|php)[\d.]+$")), name)


def classify(path: Column, head: Column) -> Column:
    """code, document, paper, image or null for other files."""
    name, end = F.lower(P.basename(path)), P.suffix(path)
    kind = F.when(name.isin(*MANIFESTS) | F.endswith(name, F.lit(".blade.php")), "code").when(end.isin(*P.CODE_SUFFIXES), "code").when(end == "pdf", "paper").when(end.isin(*P.IMAGE_SUFFIXES), "image")
    kind = kind.when(end.isin(*P.DOC_SUFFIXES), F.when(paper_signals(head) >= PAPER_AT, "paper").otherwise("document"))
    return kind.when((end == "") & shebang(head).isNotNull(), "code")


def sensitive(path: Column) -> Column:
    """A secrets directory, a secret file name, or a secret word that the name is about."""
    parts = F.split(path, "/")
    inside = F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*(F.lit(d) for d in SENSITIVE_DIRS)))
    name = P.basename(path)
    named = F.lit(False)
    for p in SENSITIVE_NAMES:
        named = named | F.regexp_like(name, F.lit(p))
    stem = F.split_part(F.regexp_replace(name, r"^\.+", ""), F.lit("."), F.lit(1))
    words = F.size(F.filter(F.split(stem, r"[-_\s]+"), lambda w: w != ""))
    about = F.lit(False)
    for p in KEYWORDS:
        about = about | F.regexp_like(stem, F.lit(p + "$")) | (F.regexp_like(stem, F.lit(p)) & (words <= 2))
    return inside | named | about


def ignore_pattern(rule: str) -> tuple[str, bool]:
    """A gitignore line as a regular expression over relative paths, and whether it excludes."""
    exclude = not rule.startswith("!")
    body = rule.lstrip("!").rstrip("/")
    rooted = "/" in body
    body, out, i = body.lstrip("/"), "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = body[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c not in "_[]-" else c), i + 1
    return ("^" if rooted else "^(?:.*/)?") + out + "(?:/.*)?$", exclude


def apply_ignore(files: DataFrame, rules: list[str]) -> DataFrame:
    """Files that the rules keep: the last matching rule decides, but nothing below an excluded directory comes back."""
    verdict, below = F.lit(False), F.lit(False)
    for rule in (r.strip() for r in rules if r.strip() and not r.startswith("#")):
        pattern, exclude = ignore_pattern(rule)
        hit = F.regexp_like("path", F.lit(pattern))
        if exclude and rule.endswith("/"):
            below = below | hit
        verdict = F.when(hit, F.lit(exclude)).otherwise(verdict)
    return files.where(~(verdict | below))


def corpus_size(files: DataFrame) -> DataFrame:
    """files, words and a verdict; files: path, words."""
    row = files.agg(F.count(F.lit(1)).alias("files"), F.sum("words").alias("words"))
    verdict = F.when((F.col("words") >= LARGE_WORDS) | (F.col("files") >= LARGE_FILES), "large").when(F.col("words") < SMALL_WORDS, "small").otherwise("medium")
    return row.withColumn("verdict", verdict)


def manifest_diff(scanned: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and state: new, changed, unchanged or deleted, by modification time first, then content hash."""
    rows = scanned.select("path", F.col("mtime").alias("m1"), F.col("hash").alias("h1")).join(manifest.select("path", F.col("mtime").alias("m0"), F.col("hash").alias("h0")), "path", "full_outer")
    state = F.when(F.col("h0").isNull(), "new").when(F.col("h1").isNull(), "deleted").when((F.col("m0") == F.col("m1")) | (F.col("h0") == F.col("h1")), "unchanged").otherwise("changed")
    return rows.select("path", state.alias("state"))


def updated_manifest(scanned: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest after a scan: scanned rows replace theirs, deleted ones go."""
    kept = manifest.join(scanned.select("path"), "path", "left_semi").join(scanned.select("path"), "path", "left_anti")
    return kept.unionByName(scanned.select(*manifest.columns))


def cache_key(path: Column, text: Column) -> Column:
    """Hash of the body and the relative path; front matter of markdown doesn't count."""
    body = F.when(F.endswith(path, F.lit(".md")), F.regexp_replace(text, r"^---\n(?s:.*?)\n---\n", "")).otherwise(text)
    return F.sha2(F.concat(body, F.lit("\0"), path), 256)


def cache_split(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their cached value, misses); files: path, key; cache: key, value."""
    return files.join(cache, "key"), files.join(cache.select("key"), "key", "left_anti")


def cache_prune(cache: DataFrame, live: DataFrame) -> DataFrame:
    return cache.join(live.select("key"), "key", "left_semi")


# Images in a chunk, and what counts as one.
MAX_IMAGES, IMAGE = 20, r"\.(png|jpg|jpeg|webp|gif)$"


def slice_bounds(text: str, most: int) -> list[tuple[int, int]]:
    """Ranges that cover the text, each at most ``most`` long, cut before a heading, else after a blank line or newline."""
    out, at = [], 0
    while len(text) - at > most:
        part = text[at : at + most]
        heading, blank, line = part.rfind("\n#"), part.rfind("\n\n"), part.rfind("\n")
        cut = heading + 1 if heading > 0 else blank + 2 if blank > 0 else line + 1 if line > 0 else most
        out.append((at, at + cut))
        at += cut
    return [*out, (at, len(text))]


def slices(docs: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id, idx, start, stop: every whole text, cut without gaps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, k, a, b) for d, t in zip(pdf.doc_id, pdf.text, strict=True) for k, (a, b) in enumerate(slice_bounds(t or "", most))]
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "start", "stop"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, idx int, start int, stop int")


def pack(files: DataFrame, budget: int, images: int = MAX_IMAGES) -> DataFrame:
    """path, chunk: files by directory, then path, filled greedily to a token budget and ``images`` images a chunk.

    A chunk goes on over directories. Greedy filling is sequential: the files are sorted by all tasks and read through one,
    which holds one batch and three numbers. A file over the budget is a chunk of its own. files: path, tokens.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = used = seen = 0
        for pdf in batches:
            out = []
            for tokens, image in zip(pdf.tokens, pdf.image, strict=True):
                if used and (used + tokens > budget or (image and seen >= images)):
                    chunk, used, seen = chunk + 1, 0, 0
                used, seen = used + tokens, seen + bool(image)
                out.append(chunk)
            yield pd.DataFrame({"path": pdf.path, "chunk": out}).astype({"chunk": "int32"})

    folder = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    rows = files.select("path", "tokens", F.regexp_like(F.lower("path"), F.lit(IMAGE)).alias("image"), folder.alias("folder"))
    return rows.orderBy("folder", "path").coalesce(1).select("path", "tokens", "image").mapInPandas(fill, "path string, chunk int")


def url_type(url: Column) -> Column:
    low = F.lower(url)
    path = F.regexp_extract(low, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    kind = F.when(F.contains(low, F.lit("twitter.com")) | F.contains(low, F.lit("x.com")), "tweet").when(F.contains(low, F.lit("arxiv.org")), "arxiv").when(F.contains(low, F.lit("github.com")), "github")
    kind = kind.when(F.contains(low, F.lit("youtube.com")) | F.contains(low, F.lit("youtu.be")), "youtube").when(F.endswith(path, F.lit(".pdf")), "pdf")
    return kind.when(F.regexp_like(path, F.lit(r"\.(png|jpg|jpeg|webp|gif)$")), "image").otherwise("webpage")


def html_to_text(html: Column, most: int = 8000) -> Column:
    """Markup stripped, white space collapsed; the rule keeps the first 8,000 characters."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " ")), 1, most)


def links(pages: DataFrame) -> DataFrame:
    """page_id, host, href of every anchor."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    return pages.select("page_id", host.alias("host"), F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)).alias("href"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their input order, where a source keeps it in columns."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(order[0]).orderBy(*order)))
