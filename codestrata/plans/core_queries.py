"""Queries of the core operators for training data: p1 and p4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import manifest_delta, skew
from codestrata.runtime import table

HEAVY_SHARE = 0.02


def _delta(spark: SparkSession, base: str) -> DataFrame:
    return manifest_delta.scan_delta(table(spark, base, "code_nodes"), table(spark, base, "discovery_chunk_meta"), table(spark, base, "scan_runs"))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return _delta(spark, base).select("rec_kind", "rec_id")


def p1_per_scan(spark: SparkSession, base: str) -> DataFrame:
    """How many records each completed scan hands on."""
    return _delta(spark, base).groupBy("scan_id", "parent", "rec_kind").agg(F.count("*").alias("n_records"))


def p4_stats(spark: SparkSession, base: str) -> DataFrame:
    return skew.edge_sides(table(spark, base, "call_edges"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    edges = table(spark, base, "call_edges")
    stats = skew.edge_sides(edges).withColumnRenamed("n_edges", "n_rows")
    return skew.heavy_keys(stats, edges.count(), HEAVY_SHARE).select("key_side", "node_id")


_P1 = """
WITH state AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC) AS k FROM scan_runs) WHERE k = 1
), done AS (SELECT * FROM state WHERE status = 'completed'),
pred AS (
  SELECT d.id AS version, (SELECT max(e.id) FROM done e WHERE e.project_slug = d.project_slug AND e.branch IS NOT DISTINCT FROM d.branch
    AND e.started_at = (SELECT max(f.started_at) FROM done f WHERE f.project_slug = d.project_slug AND f.branch IS NOT DISTINCT FROM d.branch AND f.started_at < d.started_at)) AS parent
  FROM done d
), rec AS (
  SELECT DISTINCT 'node' AS rec_kind, id AS rec_id, scan_id, file_path, qualified_name, nullif(lower(trim(file_hash)), '') AS h, -1 AS pos FROM code_nodes
  UNION ALL
  SELECT DISTINCT 'chunk', chunk_id, scan_id, file_path, qualified_name, nullif(lower(trim(chunk_hash)), ''), chunk_index FROM discovery_chunk_meta
), delta AS (
  SELECT r.rec_kind, r.rec_id, r.scan_id, p.parent FROM rec r JOIN pred p ON r.scan_id = p.version
  WHERE p.parent IS NULL OR r.h IS NULL OR NOT EXISTS (
    SELECT 1 FROM rec o WHERE o.scan_id = p.parent AND o.rec_kind = r.rec_kind AND o.file_path = r.file_path AND o.qualified_name = r.qualified_name AND o.h = r.h AND o.pos = r.pos)
)
"""
_P4 = """
WITH sides AS (
  SELECT 'callee' AS key_side, callee_id AS node_id, caller_id AS partner, confidence FROM call_edges WHERE callee_id IS NOT NULL
  UNION ALL SELECT 'caller', caller_id, callee_id, confidence FROM call_edges WHERE caller_id IS NOT NULL
)
"""
QUERIES = {"p1_found": p1_found, "p1_per_scan": p1_per_scan, "p4_found": p4_found, "p4_stats": p4_stats}
ORACLE = {
    "p1_found": _P1 + "SELECT rec_kind, rec_id FROM delta",
    "p1_per_scan": _P1 + "SELECT scan_id, parent, rec_kind, count(*) AS n_records FROM delta GROUP BY ALL",
    "p4_found": _P4 + "SELECT key_side, node_id FROM sides GROUP BY ALL HAVING count(*) >= 0.02 * (SELECT count(*) FROM call_edges)",
    "p4_stats": _P4 + "SELECT key_side, node_id, count(*) AS n_edges, count(DISTINCT partner) AS n_partners, round(avg(confidence), 6) AS mean_confidence FROM sides GROUP BY ALL",
}
