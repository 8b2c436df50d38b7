"""Queries of pages, parsers, exports' inputs and event windows."""

from __future__ import annotations

import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.plans import pages as P
from codestrata.plans import relations as R
from codestrata.plans.graph_queries import _SLICES
from codestrata.runtime import checkpoint_dir, table
from codestrata.sources import parsers, sinks
from codestrata.streaming import ledger


def _ctx(spark, base) -> P.Context:
    return P.Context(R.nodes(spark, base), R.edges(spark, base), R.unresolved(spark, base))


def _pages(name):
    def query(spark: SparkSession, base: str) -> DataFrame:
        return P.run_builders(_ctx(spark, base), [name]).select("page_id", "type", "title")

    query.__name__ = f"pages_{name}"
    return query


def page_facts(spark: SparkSession, base: str) -> DataFrame:
    """Facts of table and domain pages, taken apart again."""
    p = P.run_builders(_ctx(spark, base), ["domains"])
    return p.select("page_id", F.get_json_object("facts", "$.symbols").cast("long").alias("symbols"), F.get_json_object("facts", "$.entries").cast("long").alias("entries"))


def flow_facts(spark: SparkSession, base: str) -> DataFrame:
    """Facts of flow pages, taken apart again."""
    p = P.run_builders(_ctx(spark, base), ["flows"])
    return p.select("page_id", *(F.get_json_object("facts", f"$.{k}").cast("long").alias(k) for k in ("steps", "depth", "stops")))


def screen_facts(spark: SparkSession, base: str) -> DataFrame:
    p = P.run_builders(_ctx(spark, base), ["screens"])
    return p.select("page_id", *(F.get_json_object("facts", f"$.{k}").cast("long").alias(k) for k in ("calls", "entries")))


def export_paths(spark: SparkSession, base: str) -> DataFrame:
    return sinks.markdown(P.run_builders(_ctx(spark, base), ["domains"])).select("path", F.length("body").alias("n"))


def first_writers(spark: SparkSession, base: str) -> DataFrame:
    """The row of each scan and qualified name that a store keeps."""
    from codestrata.operators.rollups import first_per

    n = table(spark, base, "code_nodes").select("id", "scan_id", "qualified_name", "file_path", "line_start").distinct()
    return first_per(n, ["scan_id", "qualified_name"], F.asc("file_path"), F.asc_nulls_last("line_start"), F.asc("id")).select("scan_id", "qualified_name", "id")


def parsed_symbols(spark: SparkSession, base: str) -> DataFrame:
    """Symbols that the parsers find in the stored texts, by language and type."""
    n = table(spark, base, "code_nodes").join(R.current(spark, base), "scan_id", "left_semi")
    return parsers.parse_files(n.select("id", "file_path", F.lower("language").alias("language"), "source_code").distinct(), text="source_code").groupBy("node_type").agg(F.count("*").alias("n"))


def parsed_calls(spark: SparkSession, base: str) -> DataFrame:
    """How many functions of the stored texts call a name, by that name."""
    n = table(spark, base, "code_nodes").join(R.current(spark, base), "scan_id", "left_semi")
    p = parsers.parse_files(n.select("id", "file_path", F.lower("language").alias("language"), "source_code").distinct(), text="source_code")
    return p.select(F.explode(F.from_json(F.get_json_object("detail", "$.calls"), "array<string>")).alias("callee")).groupBy("callee").agg(F.count("*").alias("n"))


def _streamed(spark, base, build, name) -> DataFrame:
    """Run a stream over the events that are there; its result is read back from the shared folder."""
    at = f"{checkpoint_dir(spark).removeprefix('file://')}/{name}-{uuid.uuid4().hex}"
    out = build(ledger.event_stream(spark, base, "100 years"))
    ledger.run_available(out, f"{at}/out", f"{at}/state")
    result = spark.read.parquet(f"{at}/out")
    shutil.rmtree(f"{at}/state", ignore_errors=True)
    return result


def stream_dedupe(spark: SparkSession, base: str) -> DataFrame:
    return _streamed(spark, base, lambda s: ledger.once(s, "event_id").select("event_id", "event_type"), "dedupe")


def _batch(spark, base) -> DataFrame:
    return table(spark, base, "events").withColumn("at", F.col("ts").cast("timestamp"))


def window_tumbling(spark: SparkSession, base: str) -> DataFrame:
    return ledger.calls_per_window(_batch(spark, base), "1 day").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def window_sliding(spark: SparkSession, base: str) -> DataFrame:
    return ledger.calls_per_window(_batch(spark, base), "2 days", "1 day").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def window_sessions(spark: SparkSession, base: str) -> DataFrame:
    return ledger.sessions(_batch(spark, base), "6 hours").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


_W = f"WITH {R.NODES}, {R.EDGES}, {R.UNRESOLVED}"
QUERIES = {f"pages_{n}": _pages(n) for n in P.BUILDERS} | {f.__name__: f for f in (page_facts, flow_facts, screen_facts, export_paths, first_writers, parsed_symbols, parsed_calls, stream_dedupe, window_tumbling, window_sliding, window_sessions)}
ORACLE = {
    "pages_overview": _W + " SELECT DISTINCT 'overview:' || scan_id AS page_id, 'overview' AS type, CAST(scan_id AS VARCHAR) AS title FROM n",
    "pages_modules": _W + ", f AS (SELECT DISTINCT scan_id, string_split(file_path, '/') AS p FROM n WHERE contains(file_path, '/')), d AS (SELECT DISTINCT scan_id, array_to_string(p[1:k], '/') AS dir FROM (SELECT *, unnest(range(1, len(p))) AS k FROM f)) SELECT 'module:' || scan_id || '/' || dir AS page_id, 'module' AS type, dir AS title FROM d",
    "pages_files": _W + " SELECT DISTINCT 'file:' || scan_id || '/' || file_path AS page_id, 'file' AS type, file_path AS title FROM n",
    "pages_tables": _W + " SELECT 'table:' || scan_id || '/' || qn AS page_id, 'table' AS type, name AS title FROM n WHERE node_type = 'db_model'",
    "pages_interfaces": _W + " SELECT DISTINCT 'interface:' || scan_id || '/' || callee_name AS page_id, 'interface' AS type, callee_name AS title FROM u WHERE reason = 'external'",
    "pages_domains": _W + " SELECT DISTINCT 'domain:' || scan_id || '/' || domain AS page_id, 'domain' AS type, domain AS title FROM n WHERE domain IS NOT NULL",
    "pages_flows": _W + " SELECT 'flow:' || scan_id || '/' || qn AS page_id, 'flow' AS type, name AS title FROM n WHERE node_type IN ('endpoint', 'batch_job', 'cli_command', 'event_consumer')",
    "pages_onboarding": _W + " SELECT 'onboarding:' || scan_id || '/' || domain AS page_id, 'onboarding' AS type, domain AS title FROM n WHERE domain IS NOT NULL GROUP BY scan_id, domain HAVING count(*) >= 3",
    "pages_endpoints": _W + r""", x AS (SELECT *, regexp_extract(coalesce(annotations, ''), 'Route\(([^)]*)\)', 1) AS r FROM n WHERE node_type = 'endpoint'), y AS (SELECT *, count(*) OVER (PARTITION BY scan_id, r) AS k FROM x)
SELECT 'endpoint:' || scan_id || '/' || CASE WHEN r = '' OR k > 1 THEN qn ELSE r END AS page_id, 'endpoint' AS type, name AS title FROM y""",
    "pages_batch_jobs": _W + " SELECT 'batch_job:' || scan_id || '/' || qn AS page_id, 'batch_job' AS type, name AS title FROM n WHERE node_type = 'batch_job'",
    "pages_screens": _W + " SELECT 'screen:' || scan_id || '/' || qn AS page_id, 'screen' AS type, name AS title FROM n WHERE node_type = 'ui_component'",
    "pages_entities": _W + " SELECT 'entity:' || scan_id || '/' || qn AS page_id, 'entity' AS type, name AS title FROM n WHERE node_type IN ('db_model', 'class')",
    "pages_stored_procs": _W + " SELECT DISTINCT 'stored_proc:' || scan_id || '/' || p AS page_id, 'stored_proc' AS type, p AS title FROM (SELECT scan_id, lower(callee_name) AS p FROM e WHERE edge_kind = 'calls_proc' UNION SELECT scan_id, lower(name) FROM n WHERE node_type = 'stored_proc')",
    "screen_facts": _W + """, x AS (SELECT DISTINCT src, dst FROM e WHERE dst IS NOT NULL AND src IS NOT NULL), y AS (SELECT src AS id, count(*) AS calls, count(*) FILTER (WHERE node_type IN ('endpoint', 'batch_job', 'cli_command', 'event_consumer')) AS entries FROM x JOIN n ON n.id = dst GROUP BY 1)
SELECT 'screen:' || scan_id || '/' || qn AS page_id, coalesce(calls, 0) AS calls, coalesce(entries, 0) AS entries FROM n LEFT JOIN y USING (id) WHERE node_type = 'ui_component'""",
    "page_facts": _W + " SELECT 'domain:' || scan_id || '/' || domain AS page_id, count(*) AS symbols, count(*) FILTER (WHERE node_type IN ('endpoint', 'batch_job')) AS entries FROM n WHERE domain IS NOT NULL GROUP BY scan_id, domain",
    "flow_facts": _SLICES.replace("node_type IN ('endpoint', 'batch_job')", "node_type IN ('endpoint', 'batch_job', 'cli_command', 'event_consumer')") + """, o2 AS (SELECT src AS id, count(*) AS k FROM tn GROUP BY 1), ch AS (SELECT DISTINCT a.entry, a.id FROM sl a JOIN tn ON tn.src = a.id JOIN sl b ON b.entry = a.entry AND b.id = tn.dst AND b.depth = a.depth + 1)
SELECT 'flow:' || n.scan_id || '/' || n.qn AS page_id, count(*) AS steps, CAST(max(sl.depth) AS BIGINT) AS depth, count(*) FILTER (WHERE (sl.entry, sl.id) NOT IN (SELECT entry, id FROM ch)) AS stops FROM sl JOIN n ON n.id = sl.entry GROUP BY ALL""",
    "first_writers": "WITH x AS (SELECT DISTINCT id, scan_id, qualified_name, file_path, line_start FROM code_nodes) SELECT scan_id, qualified_name, id FROM x QUALIFY row_number() OVER (PARTITION BY scan_id, qualified_name ORDER BY file_path, line_start NULLS LAST, id) = 1",
    "stream_dedupe": "SELECT DISTINCT event_id, event_type FROM events",
    "window_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS tool, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
    "window_sliding": "SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS start, event_type AS tool, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY 1, 2",
    "window_sessions": "WITH a AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), c AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM c GROUP BY user_id, s",
}
