"""Queries of entry points, entity kinds, modes, federation and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import entities, rollups
from codestrata.plans import relations as R
from codestrata.plans.graph_queries import _BASE


def entry_point_score(spark: SparkSession, base: str) -> DataFrame:
    n = R.nodes(spark, base)
    return entities.entry_points(n, rollups.caller_signals(n, R.edges(spark, base))).select("id", "score", "evidence")


def entity_kinds(spark: SparkSession, base: str) -> DataFrame:
    """Models by kind, with the node types of their file as states."""
    n = R.nodes(spark, base)
    s = n.groupBy("scan_id", "file_path").agg(F.sort_array(F.collect_set("node_type")).alias("states"), F.count("*").alias("n"))
    k = n.where("node_type in ('db_model', 'class')").join(s, ["scan_id", "file_path"]).withColumn("k", entities.entity_kind(F.col("name"), F.col("states"), F.col("n")))
    return k.groupBy("k.kind").agg(F.count("*").alias("n"), F.round(F.avg("k.confidence"), 6).alias("confidence"))


def edge_modes(spark: SparkSession, base: str) -> DataFrame:
    e = R.edges(spark, base)
    return e.groupBy("edge_type", entities.edge_mode(F.col("callee_name"), F.col("edge_type")).alias("mode")).agg(F.count("*").alias("n"))


def federated_groups(spark: SparkSession, base: str) -> DataFrame:
    """Files of all readers' scans with the same domain, grouped by the types of their symbols."""
    n = R.nodes(spark, base).where("domain is not null")
    m = n.groupBy(F.col("domain").alias("stem"), F.col("scan_id").cast("string").alias("repo"), F.col("file_path").alias("entity")).agg(F.sort_array(F.collect_set("node_type")).alias("states"))
    return entities.federated(m)


def key_edge_recall(spark: SparkSession, base: str) -> DataFrame:
    """Of the external names among unresolved calls, how many some trusted edge has."""
    e = R.edges(spark, base).select(F.col("callee_name").alias("callee"), "confidence")
    w = R.unresolved(spark, base).select(F.col("callee_name").alias("callee_suffix"), F.lit(0.9).alias("min_confidence"))
    return entities.key_edge_recall(e, w).withColumn("recall", F.round("recall", 6))


_W = f"WITH {R.NODES}, {R.EDGES}, {R.UNRESOLVED}"
_TEST = r"regexp_matches(file_path, '(^|/)(tests?|__tests__|spec)(/|$)|(Tests?|_test|\.test|\.spec|Spec)\.[A-Za-z]+$')"
QUERIES = {f.__name__: f for f in (entry_point_score, entity_kinds, edge_modes, federated_groups, key_edge_recall)}
ORACLE = {
    "entity_kinds": _W + """, f AS (SELECT scan_id, file_path, count(DISTINCT node_type) AS s, count(*) AS m FROM n GROUP BY ALL),
k AS (SELECT CASE WHEN regexp_matches(name, '(?i)(?:view|projection|read_?model)$') THEN ('projection', 0.9) WHEN regexp_matches(name, '(?i)(?:dto|request|response|payload|form)$') THEN ('transfer', 0.9) WHEN regexp_matches(name, '(?i)(?:log|audit|history|event)$') THEN ('log', 0.85)
  WHEN regexp_matches(name, '(?i)(?:config|settings?|option)s?$') THEN ('configuration', 0.85) WHEN s >= 2 THEN ('stateful', 0.8) WHEN regexp_matches(name, '(?i)(?:_|^)(?:map|link|rel)(?:_|$)') OR regexp_matches(name, '[a-z](?:[Mm][Aa][Pp]|[Ll][Ii][Nn][Kk])$') AND regexp_matches(name, '[a-z](?:Map|Link)$') THEN ('association', 0.7) WHEN m >= 2 THEN ('record', 0.6) ELSE ('unknown', 0.3) END AS x
  FROM n JOIN f USING (scan_id, file_path) WHERE node_type IN ('db_model', 'class')) SELECT x[1] AS kind, count(*) AS n, CAST(round(avg(x[2]), 6) AS DOUBLE) AS confidence FROM k GROUP BY 1""",
    "entry_point_score": _BASE + f""", fo AS (SELECT DISTINCT src, dst FROM t), a AS (SELECT dst AS id, count(*) FILTER (WHERE NOT {_TEST}) AS p FROM fo JOIN n ON src = n.id GROUP BY 1), b AS (SELECT src AS id, count(*) AS f FROM fo GROUP BY 1),
x AS (SELECT n.*, coalesce(p, 0) AS p, coalesce(f, 0) AS f, CASE WHEN node_type IN ('endpoint', 'batch_job', 'cli_command', 'event_consumer') THEN node_type WHEN regexp_matches(coalesce(annotations, ''), '(?i)route|mapping|scheduled|listener|consumer') THEN 'annotation' END AS s
  FROM n LEFT JOIN a USING (id) LEFT JOIN b USING (id) WHERE NOT {_TEST} AND node_type NOT IN ('db_model', 'external_system', 'config', 'module')),
y AS (SELECT id, round(least(1.0, CASE WHEN s IS NOT NULL THEN 0.8 ELSE 0 END + CASE WHEN p = 0 THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(name, '{entities.ENTRY_NAMES}') THEN 0.2 ELSE 0 END + CASE WHEN CASE WHEN lower(language) = 'go' THEN regexp_matches(name, '^[A-Z]') ELSE NOT starts_with(name, '_') END THEN 0.1 ELSE 0 END + CASE WHEN f >= 2 THEN 0.1 ELSE 0 END), 4) AS score, coalesce(s, 'signals') AS evidence FROM x)
SELECT id, CAST(score AS DOUBLE) AS score, evidence FROM y WHERE score >= 0.5""",
    "edge_modes": _W + " SELECT edge_type, CASE WHEN edge_type = 'event_emit' OR regexp_matches(lower(callee_name), 'async|publish|emit|enqueue|dispatch|schedule|notify|queue|kafka|rabbit') THEN 'async' ELSE 'sync' END AS mode, count(*) AS n FROM e GROUP BY ALL",
    "key_edge_recall": _W + ", b AS (SELECT s, max(confidence) AS c FROM (SELECT confidence, unnest(list_transform(range(1, len(p) + 1), lambda k: array_to_string(p[k:], '.'))) AS s FROM (SELECT confidence, string_split(callee_name, '.') AS p FROM e)) GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (WHERE c >= 0.9) AS n_found, round(count(*) FILTER (WHERE c >= 0.9) / count(*), 6) AS recall FROM u LEFT JOIN b ON s = u.callee_name",
}
