"""The property graph: two DataFrames, optional hyperedges, and the schemas they are read with."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "id string, label string, file_type string, source_file string, source_location string, community int"
EDGE = "source string, target string, relation string, confidence string, weight double, context string, source_file string"
HYPEREDGE = "id string, label string, nodes array<string>, relation string, confidence string, confidence_score double, source_file string"

# Fixed values of the data model.
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
CONFIDENCE_SCORES = {"EXTRACTED": 1.0, "INFERRED": 0.5, "AMBIGUOUS": 0.2}
STRUCTURAL_RELATIONS = ("imports", "imports_from", "contains", "method")
IMPACT_RELATIONS = ("calls", "indirect_call", "references", "imports", "imports_from", "re_exports", "inherits", "extends", "implements", "uses", "mixes_in", "embeds")


@dataclass
class PropertyGraph:
    """Directed rows are always stored; ``directed`` says how queries read them."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False
    hyperedges: DataFrame | None = field(default=None)

    def ends(self) -> DataFrame:
        """(id, other, edge columns): each edge seen from both of its ends; a self loop twice."""
        rest = [c for c in self.edges.columns if c not in ("source", "target")]
        out = self.edges.select(F.col("source").alias("id"), F.col("target").alias("other"), *rest)
        return out.unionAll(self.edges.select(F.col("target").alias("id"), F.col("source").alias("other"), *rest))

    def degrees(self) -> DataFrame:
        """(id, degree) of every node with an edge; a self loop counts twice."""
        return self.ends().groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
