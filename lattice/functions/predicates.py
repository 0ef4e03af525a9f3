"""Column predicates and scalar helpers over nodes, paths and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed word lists.
JSON_NOISE = ("name", "version", "description", "main", "type", "id", "key", "value", "label", "title", "url", "path", "scripts", "dependencies", "devdependencies")
CODE_SUFFIXES = ("py", "ts", "tsx", "js", "jsx", "java", "go", "rs", "rb", "c", "h", "cpp", "hpp", "cs", "kt", "scala", "php", "swift", "sql", "sh", "parquet")
DOC_SUFFIXES = ("md", "rst", "txt", "html", "adoc")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "gif", "svg", "webp")
LANGUAGE_FAMILIES = {"py": "python", "ts": "js", "tsx": "js", "js": "js", "jsx": "js", "java": "jvm", "kt": "jvm", "scala": "jvm", "go": "go", "rs": "rust", "rb": "ruby", "c": "c", "h": "c", "cpp": "c", "hpp": "c", "cs": "dotnet", "php": "php", "swift": "swift"}


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def top_dir(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def normalise_path(path: Column, root: str = "") -> Column:
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    inside = root.rstrip("/") + "/"
    return F.when(F.startswith(slashed, F.lit(inside)), F.substring(slashed, F.lit(len(inside) + 1), F.length(slashed))).otherwise(slashed) if root else slashed


def is_file_node(label: Column, source_file: Column, degree: Column) -> Column:
    """A node that stands for its file, a method stub, or a function nothing else touches."""
    return F.coalesce((label == basename(source_file)) | F.regexp_like(label, F.lit(r"^\.[^(]*\(\)$")) | (F.endswith(label, F.lit("()")) & (degree <= 1)), F.lit(False))


def is_concept_node(source_file: Column) -> Column:
    """No source file, or one whose last part has no suffix."""
    return (F.coalesce(source_file, F.lit("")) == "") | ~F.contains(basename(source_file), F.lit("."))


def is_json_key_node(label: Column, source_file: Column) -> Column:
    return F.coalesce(F.endswith(F.lower(source_file), F.lit(".json")) & F.lower(label).isin(*JSON_NOISE), F.lit(False))


def file_category(path: Column) -> Column:
    end = suffix(path)
    return F.when(end.isin(*CODE_SUFFIXES), "code").when(end == "pdf", "paper").when(end.isin(*IMAGE_SUFFIXES), "image").otherwise("doc")


def language_family(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_FAMILIES.items() for x in pair))
    return F.try_element_at(table, suffix(path))


def cross_language(a: Column, b: Column) -> Column:
    """Both families are known and differ."""
    return F.coalesce(language_family(a) != language_family(b), F.lit(False))


def is_test_path(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    inside = F.arrays_overlap(parts, F.array(*(F.lit(x) for x in ("test", "tests", "__tests__", "spec", "specs", "testing"))))
    return inside | F.regexp_like(basename(F.lower(path)), F.lit(r"^(test_.*|.*_test\.[a-z]+|.*\.(test|spec)\.[a-z]+|conftest\.py)$"))


def callable_name(label: Column) -> Column:
    """The key that calls resolve by: no white space or parentheses around, no leading dots, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(label), r"^[()]+|[()]+$", ""), r"^\.+", ""))


def is_resolvable(file_type: Column, label: Column) -> Column:
    """Whether a node can be the target of a call: code, named, and not by a source file's name; null never is."""
    named = (F.trim(label) != "") & (callable_name(label) != "") & ~F.regexp_like(F.trim(label), F.lit(r"\.(py|js|ts|tsx|java|go|rs)$"))
    return F.coalesce((file_type == "code") & named, F.lit(False))


def sanitise(label: Column, cap: int = 256) -> Column:
    return F.substring(F.regexp_replace(label, r"[\x00-\x1f\x7f]", ""), 1, cap)


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "AMBIGUOUS", 0).when(confidence == "INFERRED", 1).when(confidence == "EXTRACTED", 2).otherwise(3)


def common_prefix_parts(a: Column, b: Column) -> Column:
    """How many leading path parts two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_off = F.array_position(same, False)
    return F.when(first_off == 0, F.size(same)).otherwise(first_off - 1).cast("int")
