"""The relations of the code graph, from the tables of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.runtime import table


def current(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "current_scan").select("scan_id").distinct()


def nodes(spark: SparkSession, base: str) -> DataFrame:
    """Symbols of the scans that readers see, each once."""
    n = table(spark, base, "code_nodes").join(current(spark, base), "scan_id", "left_semi")
    return n.select("id", "scan_id", F.col("qualified_name").alias("qn"), "name", "node_type", "file_path", "language", "line_start", "line_end", "domain", "annotations", "params", "return_type", "file_hash").distinct()


def edges(spark: SparkSession, base: str) -> DataFrame:
    """Edges of these scans, each once; redelivered ones have the same id."""
    e = table(spark, base, "call_edges").join(current(spark, base), "scan_id", "left_semi")
    return e.select(F.col("id").alias("edge_id"), "scan_id", F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), "callee_name", "edge_type", F.col("resolved_by").alias("origin"), "edge_kind", "evidence_kind", "confidence").distinct()


def rehydrated(nodes: DataFrame) -> DataFrame:
    """Nodes with their JSON columns as lists and maps; texts that are no JSON give empty ones."""
    lists = {c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in ("annotations", "params") if c in nodes.columns}
    maps = {c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")) for c in ("framework_hints",) if c in nodes.columns}
    return nodes.withColumns(lists | maps)


def unresolved(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "unresolved_calls").join(current(spark, base), "scan_id", "left_semi").distinct()


# The same relations in SQL.
NODES = """n AS (SELECT DISTINCT id, scan_id, qualified_name AS qn, name, node_type, file_path, language, line_start, line_end, domain, annotations, params, return_type, file_hash
  FROM code_nodes WHERE scan_id IN (SELECT scan_id FROM current_scan))"""
EDGES = """e AS (SELECT DISTINCT id AS edge_id, scan_id, caller_id AS src, callee_id AS dst, callee_name, edge_type, resolved_by AS origin, edge_kind, evidence_kind, confidence
  FROM call_edges WHERE scan_id IN (SELECT scan_id FROM current_scan))"""
UNRESOLVED = "u AS (SELECT DISTINCT * FROM unresolved_calls WHERE scan_id IN (SELECT scan_id FROM current_scan))"
GRAPH = f"WITH RECURSIVE {NODES}, {EDGES}"
