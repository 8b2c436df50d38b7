"""Closed vocabularies of the code graph: fixed values that decide results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# origin: (confidence, edge kind, evidence kind)
ORIGINS = {
    "scip": (1.00, "calls", "scip"),
    "same_file": (0.95, "calls", "static"),
    "self_scope": (0.95, "calls", "static"),
    "import_exact": (0.95, "calls", "static"),
    "receiver_typed": (0.93, "calls", "static"),
    "same_package": (0.90, "calls", "static"),
    "inherited": (0.90, "calls", "static"),
    "import_module": (0.88, "calls", "static"),
    "framework": (0.90, "framework_binds", "framework"),
    "dispatch": (0.75, "dispatches_to", "static"),
    "receiver_global": (0.75, "calls", "static"),
    "global_unique": (0.50, "calls", "static"),
    "sql_parsed": (0.90, "reads_table", "static"),
    "sql_regex": (0.60, "reads_table", "static"),
    "proc_call": (0.90, "calls_proc", "static"),
    "external_client": (0.90, "calls_external", "framework"),
}
EDGE_KINDS = ["calls", "dispatches_to", "framework_binds", "type_use", "markup_event", "calls_proc", "reads_table", "writes_table", "dynamic_hint", "executes", "co_change", "calls_external"]
EVIDENCE_KINDS = ["static", "framework", "dynamic_hint", "scip", "co_change", "coverage", "runtime"]
UNRESOLVED_REASONS = ["ambiguous", "not_found", "dynamic", "builtin", "external", "dispatch_cap", "di_ambiguous"]
STOP_REASONS = ["leaf_no_callees", "depth_cap", "cycle", "unresolved_call", "dynamic_dispatch", "external_boundary", "db_boundary", "flow_cap"]
OVERLAYS = ["co_change", "coverage", "runtime"]
EDGE_WEIGHTS = {"writes_table": 1.0, "calls": 0.8, "framework_binds": 0.8, "markup_event": 0.8, "calls_proc": 0.8, "calls_external": 0.8, "dispatches_to": 0.6, "dynamic_hint": 0.5, "reads_table": 0.5, "type_use": 0.4}
UNKNOWN_WEIGHT = 0.5
ENTRY_KINDS = ["endpoint", "batch_job", "cli_command", "event_consumer"]
FLOW_EVIDENCE = ["static", "framework", "scip"]
FLOW_KINDS = ["calls", "dispatches_to", "framework_binds", "calls_external"]
FLOW_FLOOR = 0.75
FLOW_DEPTH, FLOW_CAP = 8, 50
DISPATCH_CAP = 24
TEST_PATH = r"(^|/)(tests?|__tests__|spec)(/|$)|(Tests?|_test|\.test|\.spec|Spec)\.[A-Za-z]+$"


def origin_table(spark: SparkSession) -> DataFrame:
    """The origins as a relation of sixteen rows."""
    return spark.createDataFrame([(k, *v) for k, v in ORIGINS.items()], "origin string, o_confidence double, o_kind string, o_evidence string")


def lookup(column: Column, table: dict) -> Column:
    """A constant map applied to a column; null where the key isn't in it."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), column)


def confidence(origin: Column, stored: Column) -> Column:
    """The origin's confidence beats the stored one; without either it's 0."""
    return F.coalesce(lookup(origin, {k: v[0] for k, v in ORIGINS.items()}), stored, F.lit(0.0))


def followable(origin: Column, stored: Column) -> Column:
    """Whether flows may walk an edge. Unknown origins are judged by confidence alone."""
    known = lookup(origin, {k: v[0] >= FLOW_FLOOR and v[1] in FLOW_KINDS and v[2] in FLOW_EVIDENCE for k, v in ORIGINS.items()})
    return F.coalesce(known, F.coalesce(stored, F.lit(0.0)) >= FLOW_FLOOR)


def weight(kind: Column) -> Column:
    return F.coalesce(lookup(kind, EDGE_WEIGHTS), F.lit(UNKNOWN_WEIGHT))


def check_vocabulary(edges: DataFrame) -> DataFrame:
    """The edges whose kind or evidence is outside the closed vocabularies."""
    return edges.where(~F.col("edge_kind").isin(EDGE_KINDS) | ~F.col("evidence_kind").isin(EVIDENCE_KINDS))
