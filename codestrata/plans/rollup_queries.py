"""Queries of the aggregations, ranks and set comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import origins as O
from codestrata.operators import graph, mining, rollups
from codestrata.operators.manifest_delta import latest_state
from codestrata.plans import relations as R
from codestrata.plans.graph_queries import _BASE
from codestrata.runtime import table


def overview_counts(spark: SparkSession, base: str) -> DataFrame:
    return rollups.overview(R.nodes(spark, base))


def unresolved_ratio(spark: SparkSession, base: str) -> DataFrame:
    return rollups.unresolved_ratio(R.nodes(spark, base), R.edges(spark, base), R.unresolved(spark, base))


def entry_out_degrees(spark: SparkSession, base: str) -> DataFrame:
    return rollups.out_degrees(R.nodes(spark, base), R.edges(spark, base), ["endpoint", "batch_job"])


def caller_signals(spark: SparkSession, base: str) -> DataFrame:
    return rollups.caller_signals(R.nodes(spark, base), R.edges(spark, base))


def domain_rollup(spark: SparkSession, base: str) -> DataFrame:
    return rollups.domains(R.nodes(spark, base))


def domain_edge_counts(spark: SparkSession, base: str) -> DataFrame:
    return rollups.domain_edges(R.nodes(spark, base), R.edges(spark, base))


def domain_adjacency(spark: SparkSession, base: str) -> DataFrame:
    return rollups.domain_adjacency(R.nodes(spark, base), R.edges(spark, base))


def file_graph_weights(spark: SparkSession, base: str) -> DataFrame:
    return rollups.file_graph(R.nodes(spark, base), R.edges(spark, base))


def edge_histogram(spark: SparkSession, base: str) -> DataFrame:
    return rollups.histogram(R.edges(spark, base), "origin")


def extension_top10(spark: SparkSession, base: str) -> DataFrame:
    return rollups.top_extensions(R.nodes(spark, base))


def confidence_percentiles(spark: SparkSession, base: str) -> DataFrame:
    return rollups.nearest_rank(table(spark, base, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


def ledger_stats(spark: SparkSession, base: str) -> DataFrame:
    calls = table(spark, base, "events").select(F.col("event_type").alias("tool"), F.col("user_id").alias("client"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("props").alias("args"))
    return rollups.ledger_stats(calls)


def store_counts(spark: SparkSession, base: str) -> DataFrame:
    return rollups.table_counts({t: table(spark, base, t) for t in ("scan_runs", "current_scan", "code_nodes", "call_edges", "discovery_chunk_meta", "unresolved_calls", "documents", "benchmark")})


def process_edge_freq(spark: SparkSession, base: str) -> DataFrame:
    return rollups.process_edges(table(spark, base, "events"), "user_id", ["ts", "event_id"], "event_type")


def majority_domain(spark: SparkSession, base: str) -> DataFrame:
    return rollups.majority_name(R.nodes(spark, base), "file_path", "domain")


def _graded(spark, base) -> DataFrame:
    """A graded sample: a stored edge is right where it ends in a symbol of its callee's name."""
    n = R.nodes(spark, base).select(F.col("id").alias("dst"), F.col("qn"), F.lower("language").alias("language"))
    e = R.edges(spark, base).where("dst is not null").join(n, "dst", "left")
    return e.select("edge_id", F.coalesce("language", F.lit("(none)")).alias("language"), F.coalesce(F.nullif("origin", F.lit("")), F.lit("(none)")).alias("origin"), (F.col("qn") == F.col("callee_name")).alias("correct"))


def precision_wilson(spark: SparkSession, base: str) -> DataFrame:
    return rollups.precision_strata(_graded(spark, base), ["language", "origin"], "correct")


def stratum_drift(spark: SparkSession, base: str) -> DataFrame:
    g = _graded(spark, base)
    return rollups.drift_share(g.select("edge_id", "origin"), R.edges(spark, base).where("confidence >= 0.9").select("edge_id"), ["edge_id"], ["origin"])


def callee_scores(spark: SparkSession, base: str) -> DataFrame:
    """Found callees of each scan (trusted edges) against all named ones."""
    e = R.edges(spark, base)
    return rollups.set_scores(graph.trusted(e).select("scan_id", F.col("callee_name").alias("name")), e.where("confidence >= 0.9").select("scan_id", F.col("callee_name").alias("name")), ["scan_id"], "name")


def claim_confidence(spark: SparkSession, base: str) -> DataFrame:
    """Per file: edges at 0.9 count as verified, weaker ones as unsure claims."""
    n = R.nodes(spark, base).select(F.col("id").alias("src"), "scan_id", "file_path")
    e = n.join(R.edges(spark, base).select("src", "confidence"), "src", "left").groupBy("scan_id", "file_path").agg(F.count_if(F.col("confidence") >= 0.9).alias("v"), F.count_if(F.col("confidence") < 0.9).alias("u"))
    return e.select("scan_id", "file_path", F.round(rollups.blend_confidence(F.col("v"), F.lit(0), F.col("u"), F.col("u")), 6).alias("confidence"))


def token_costs(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "documents").select("source", F.floor(F.coalesce("n_chars", F.lit(0)) / 4).alias("tokens"))
    cost = rollups.token_cost(F.col("tokens"), F.floor(F.col("tokens") / 2), 3.0, 15.0)
    return c.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.round(F.sum(cost), 6).alias("usd"), F.round(F.sum(cost) * 0.5, 6).alias("low"), F.round(F.sum(cost) * 2, 6).alias("high"))


def bootstrap_bounds(spark: SparkSession, base: str) -> DataFrame:
    return rollups.bootstrap_mean(R.edges(spark, base), "confidence", 200)


def edge_dedupe(spark: SparkSession, base: str) -> DataFrame:
    return rollups.dedupe_edges(R.edges(spark, base)).select("src", "dst", "edge_type", "edge_id")


def unresolved_dedupe(spark: SparkSession, base: str) -> DataFrame:
    return rollups.dedupe_unresolved(R.unresolved(spark, base), R.edges(spark, base)).select("id", "caller_id", "callee_name", "reason")


def callers_callees(spark: SparkSession, base: str) -> DataFrame:
    n = R.nodes(spark, base)
    centre = n.where("node_type = 'db_model'").select("id")
    return rollups.neighbours(n, R.edges(spark, base), centre).withColumn("confidence", F.round("confidence", 6))


def unique_screen_names(spark: SparkSession, base: str) -> DataFrame:
    n = R.nodes(spark, base).where("node_type = 'ui_component'")
    return rollups.unique_names(n, "name", F.asc("id")).select("id", "unique_name")


def page_keys(spark: SparkSession, base: str) -> DataFrame:
    return rollups.page_keys(R.nodes(spark, base)).select("id", "key")


def _scans(spark, base) -> DataFrame:
    return latest_state(table(spark, base, "scan_runs").select("id", "commit_sha", "branch", "project_slug", "started_at", "status", "recorded_at"), "id", "recorded_at")


def previous_run(spark: SparkSession, base: str) -> DataFrame:
    return rollups.previous_runs(_scans(spark, base))


def budget_shedding(spark: SparkSession, base: str) -> DataFrame:
    """Of each source the newest documents that fit into 20,000 characters."""
    d = table(spark, base, "documents").where("n_chars is not null and created_at is not null")
    return rollups.shed_to_budget(d, ["source"], F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), "doc_id"), F.col("n_chars"), 20_000).select("source", "doc_id")


def did_you_mean(spark: SparkSession, base: str) -> DataFrame:
    return rollups.names_like(R.nodes(spark, base), "qn", "ledger")


def hub_top(spark: SparkSession, base: str) -> DataFrame:
    d = graph.in_degrees(R.edges(spark, base).where("dst is not null"))
    return d.orderBy(F.desc("in_degree"), "id").limit(20)


def scans_recent(spark: SparkSession, base: str) -> DataFrame:
    s = _scans(spark, base)
    n = table(spark, base, "code_nodes").select("scan_id", "id").distinct().groupBy("scan_id").agg(F.count("*").alias("n_nodes"))
    top = s.orderBy(F.desc("id")).limit(20)
    return top.join(n, top["id"] == n["scan_id"], "left").select("id", "status", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))


def common_callees(spark: SparkSession, base: str) -> DataFrame:
    """Jaccard of the callee names of the callers within a file, at least a half; callers with the same callees as one."""
    n = R.nodes(spark, base).select(F.col("id").alias("src"), "scan_id", "file_path")
    sets = R.edges(spark, base).join(n, ["src", "scan_id"]).groupBy("scan_id", "file_path", "src").agg(F.collect_set("callee_name").alias("names"))
    return mining.set_pairs(sets, "src", "names", F.concat_ws("|", F.col("scan_id").cast("string"), "file_path")).where("jaccard >= 0.5").select("a", "b", "n_a", "n_b", "jaccard")


def scan_diff(spark: SparkSession, base: str) -> DataFrame:
    """Files of the readers' scans whose hash differs from the same path's newest hash of the project before, by path."""
    s = _scans(spark, base).select(F.col("id").alias("scan_id"), "project_slug")
    files = table(spark, base, "code_nodes").select("scan_id", "file_path", F.lower(F.trim("file_hash")).alias("h")).distinct().join(s, "scan_id").groupBy("project_slug", "scan_id", "file_path").agg(F.max("h").alias("h"))
    cur = files.join(R.current(spark, base), "scan_id", "left_semi")
    first = files.join(files.groupBy("project_slug").agg(F.min("scan_id").alias("scan_id")), ["project_slug", "scan_id"], "left_semi")
    return rollups.symmetric_difference(first, cur, ["project_slug", "file_path"], "h")


_W = f"WITH {R.NODES}, {R.EDGES}, {R.UNRESOLVED}"
_STATE = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC) AS k FROM scan_runs) WHERE k = 1)"
_FOLLOW = "CASE WHEN o_conf IS NOT NULL THEN o_conf >= 0.75 AND o_kind IN ('calls', 'dispatches_to', 'framework_binds', 'calls_external') AND o_evidence IN ('static', 'framework', 'scip') ELSE coalesce(confidence, 0) >= 0.75 END"
_TEST = r"regexp_matches(file_path, '(^|/)(tests?|__tests__|spec)(/|$)|(Tests?|_test|\.test|\.spec|Spec)\.[A-Za-z]+$')"
_GRADED = _W + ", gr AS (SELECT edge_id, coalesce(lower(language), '(none)') AS language, coalesce(nullif(origin, ''), '(none)') AS origin, qn = callee_name AS correct FROM e LEFT JOIN n ON dst = n.id WHERE dst IS NOT NULL)"
_CI = "1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))"
assert O.FLOW_FLOOR == 0.75

QUERIES = {f.__name__: f for f in (
    overview_counts, unresolved_ratio, entry_out_degrees, caller_signals, domain_rollup, domain_edge_counts, domain_adjacency, file_graph_weights, edge_histogram, extension_top10, confidence_percentiles, ledger_stats, store_counts, process_edge_freq, majority_domain,
    precision_wilson, stratum_drift, callee_scores, claim_confidence, token_costs, bootstrap_bounds, edge_dedupe, unresolved_dedupe, callers_callees, unique_screen_names, page_keys, previous_run, budget_shedding, did_you_mean, hub_top, scans_recent, common_callees, scan_diff)}
ORACLE = {
    "overview_counts": _W + """, f AS (SELECT DISTINCT scan_id, file_path, lower(language) AS l FROM n)
SELECT 'symbols' AS section, 'all' AS key, count(*) AS n FROM n UNION ALL SELECT 'files', 'all', count(*) FROM (SELECT DISTINCT scan_id, file_path FROM f)
UNION ALL SELECT 'type', node_type, count(*) FROM n GROUP BY node_type UNION ALL SELECT 'language', coalesce(l, '(none)'), count(*) FROM f GROUP BY l""",
    "unresolved_ratio": _W + """, r AS (SELECT coalesce(lower(language), '(none)') AS language, count(*) AS a FROM e LEFT JOIN n ON src = n.id GROUP BY 1),
x AS (SELECT coalesce(lower(language), '(none)') AS language, count(*) AS b FROM u LEFT JOIN n ON caller_id = n.id GROUP BY 1)
SELECT language, coalesce(a, 0) AS n_resolved, coalesce(b, 0) AS n_unresolved, round(coalesce(b, 0) / (coalesce(a, 0) + coalesce(b, 0)), 3) AS ratio FROM r FULL JOIN x USING (language)""",
    "entry_out_degrees": _W + " SELECT n.id, count(e.edge_id) AS n_out FROM n LEFT JOIN e ON src = n.id WHERE node_type IN ('endpoint', 'batch_job') GROUP BY n.id",
    "caller_signals": _BASE + f""", fo AS (SELECT DISTINCT src, dst FROM t),
a AS (SELECT dst AS id, count(*) FILTER (WHERE NOT {_TEST}) AS prod_in FROM fo JOIN n ON src = n.id GROUP BY 1), b AS (SELECT src AS id, count(*) AS fan_out FROM fo GROUP BY 1)
SELECT n.id, coalesce(prod_in, 0) AS prod_in, coalesce(fan_out, 0) AS fan_out FROM n LEFT JOIN a USING (id) LEFT JOIN b USING (id)""",
    "domain_rollup": _W + " SELECT coalesce(domain, '(none)') AS domain, count(*) AS n_nodes, count(*) FILTER (WHERE node_type IN ('endpoint', 'batch_job')) AS n_entries, count(*) FILTER (WHERE node_type = 'db_model') AS n_models, coalesce(string_agg(DISTINCT lower(language), ',' ORDER BY lower(language)), '') AS languages FROM n GROUP BY 1",
    "domain_edge_counts": _W + " SELECT a.domain, count(*) FILTER (WHERE a.domain = b.domain) AS n_internal, count(*) FILTER (WHERE a.domain <> b.domain) AS n_outgoing FROM e JOIN n a ON src = a.id JOIN n b ON dst = b.id WHERE a.domain IS NOT NULL AND b.domain IS NOT NULL GROUP BY 1",
    "domain_adjacency": _W + " SELECT a.domain AS from_domain, b.domain AS to_domain, count(*) AS n FROM e JOIN n a ON src = a.id JOIN n b ON dst = b.id WHERE a.domain <> b.domain GROUP BY ALL HAVING count(*) >= 3",
    "file_graph_weights": _W + """, f AS (SELECT id, scan_id || '/' || file_path AS file FROM n)
SELECT least(a.file, b.file) AS file_a, greatest(a.file, b.file) AS file_b, round(sum(coalesce(confidence, 0)), 6) AS weight FROM e JOIN f a ON src = a.id JOIN f b ON dst = b.id WHERE a.file <> b.file GROUP BY ALL""",
    "edge_histogram": _W + " SELECT coalesce(nullif(origin, ''), '(none)') AS key, count(*) AS n FROM e GROUP BY 1",
    "extension_top10": _W + r" SELECT coalesce(nullif(lower(regexp_extract(file_path, '\.([^./]+)$', 1)), ''), '(none)') AS ext, count(*) AS n FROM (SELECT DISTINCT scan_id, file_path FROM n) GROUP BY 1 ORDER BY n DESC, ext LIMIT 10",
    "confidence_percentiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(value) FILTER (WHERE r = floor(0.5 * (n - 1) + 0.5)) AS p50, max(value) FILTER (WHERE r = floor(0.95 * (n - 1) + 0.5)) AS p95 FROM r GROUP BY 1",
    "ledger_stats": "SELECT event_type AS tool, count(*) AS n_calls, count(*) FILTER (WHERE event_type = 'error') AS n_failed, count(DISTINCT user_id) AS n_clients, count(*) - count(DISTINCT props) AS n_repeats FROM events GROUP BY 1",
    "store_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in ("scan_runs", "current_scan", "code_nodes", "call_edges", "discovery_chunk_meta", "unresolved_calls", "documents", "benchmark")),
    "process_edge_freq": "WITH x AS (SELECT event_type AS from_activity, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_activity FROM events) SELECT from_activity, to_activity, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM x WHERE to_activity IS NOT NULL GROUP BY 1, 2",
    "majority_domain": _W + " SELECT file_path, domain FROM (SELECT file_path, domain, row_number() OVER (PARTITION BY file_path ORDER BY count(*) DESC, domain DESC) AS k FROM n WHERE domain IS NOT NULL GROUP BY 1, 2) WHERE k = 1",
    "precision_wilson": _GRADED + f""", a AS (SELECT language, origin, count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct, count(*) FILTER (WHERE correct) / count(*) AS p FROM gr WHERE correct IS NOT NULL GROUP BY ALL)
SELECT language, origin, n, n_correct, round(p, 6) AS precision, round(greatest(0, (p + 3.8416 / (2 * n) - {_CI}) / (1 + 3.8416 / n)), 6) AS low, round(least(1, (p + 3.8416 / (2 * n) + {_CI}) / (1 + 3.8416 / n)), 6) AS high FROM a""",
    "stratum_drift": _GRADED + " SELECT origin, count(*) AS n, count(*) FILTER (WHERE edge_id NOT IN (SELECT edge_id FROM e WHERE confidence >= 0.9)) AS n_gone, round(count(*) FILTER (WHERE edge_id NOT IN (SELECT edge_id FROM e WHERE confidence >= 0.9)) / count(*), 6) AS share FROM gr GROUP BY 1",
    "callee_scores": _BASE + """, f AS (SELECT DISTINCT scan_id, callee_name AS name, 1 AS a FROM t), w AS (SELECT DISTINCT scan_id, callee_name AS name, 1 AS b FROM e WHERE confidence >= 0.9),
c AS (SELECT scan_id, count(*) FILTER (WHERE a = 1 AND b = 1) AS n_hit, count(*) FILTER (WHERE a IS NULL) AS n_missing, count(*) FILTER (WHERE b IS NULL) AS n_extra FROM f FULL JOIN w USING (scan_id, name) GROUP BY 1),
d AS (SELECT *, CASE WHEN n_hit + n_extra = 0 THEN 1 ELSE n_hit / (n_hit + n_extra) END AS p, CASE WHEN n_hit + n_missing = 0 THEN 1 ELSE n_hit / (n_hit + n_missing) END AS r FROM c)
SELECT scan_id, n_hit, n_missing, n_extra, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM d""",
    "claim_confidence": _W + ", a AS (SELECT n.scan_id, file_path, count(*) FILTER (WHERE confidence >= 0.9) AS v, count(*) FILTER (WHERE confidence < 0.9) AS x FROM n LEFT JOIN e ON src = n.id GROUP BY ALL) SELECT scan_id, file_path, round(CASE WHEN v + x = 0 THEN 0.3 ELSE (v + 0.5 * x) / (v + x) END, 6) AS confidence FROM a",
    "token_costs": "WITH c AS (SELECT source, CAST(floor(coalesce(n_chars, 0) / 4) AS BIGINT) AS t FROM documents), d AS (SELECT source, t, (t * 3.0 + floor(t / 2) * 15.0) / 1000000 AS usd FROM c) SELECT source, count(*) AS n, CAST(sum(t) AS BIGINT) AS tokens, round(sum(usd), 6) AS usd, round(sum(usd) * 0.5, 6) AS low, round(sum(usd) * 2, 6) AS high FROM d GROUP BY 1",
    "edge_dedupe": _W + " SELECT src, dst, edge_type, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, edge_type ORDER BY confidence DESC NULLS LAST, edge_id) AS k FROM e) WHERE k = 1",
    "unresolved_dedupe": _W + ", x AS (SELECT *, row_number() OVER (PARTITION BY caller_id, callee_name ORDER BY id) AS k FROM u WHERE caller_id IS NOT NULL) SELECT id, caller_id, callee_name, reason FROM x WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE dst IS NOT NULL AND e.src = x.caller_id AND e.callee_name = x.callee_name)",
    "callers_callees": _BASE + f""", c AS (SELECT id FROM n WHERE node_type = 'db_model'),
x AS (SELECT dst AS centre, 'caller' AS side, src AS id, e.*, o_conf, o_kind, o_evidence FROM e LEFT JOIN o USING (origin) WHERE dst IN (SELECT id FROM c) AND src NOT IN (SELECT id FROM c) AND src IN (SELECT id FROM n)
UNION ALL SELECT src, 'callee', dst, e.*, o_conf, o_kind, o_evidence FROM e LEFT JOIN o USING (origin) WHERE src IN (SELECT id FROM c) AND dst NOT IN (SELECT id FROM c) AND dst IN (SELECT id FROM n))
SELECT centre, side, id, round(coalesce(o_conf, confidence, 0), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY centre, side, id ORDER BY {_FOLLOW} DESC, coalesce(o_conf, confidence, 0) DESC, edge_id) AS k FROM x) WHERE k = 1""",
    "unique_screen_names": _W + " SELECT id, CASE WHEN k = 1 THEN name ELSE name || '-' || k END AS unique_name FROM (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM n WHERE node_type = 'ui_component')",
    "page_keys": _W + " SELECT id, CASE WHEN count(*) OVER (PARTITION BY scan_id, qn) > 1 THEN qn || '@' || file_path || ':' || coalesce(CAST(line_start AS VARCHAR), '?') ELSE qn END AS key FROM n",
    "previous_run": f"WITH {_STATE} SELECT id, coalesce(CASE WHEN commit_sha IS NOT NULL THEN max(id) OVER (PARTITION BY project_slug, commit_sha ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, max(id) OVER (PARTITION BY project_slug, branch ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS previous FROM s",
    "budget_shedding": "SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY created_at DESC, doc_id ROWS UNBOUNDED PRECEDING) AS u FROM documents WHERE n_chars IS NOT NULL AND created_at IS NOT NULL) WHERE u <= 20000",
    "did_you_mean": _W + " SELECT DISTINCT qn FROM n WHERE instr(lower(qn), 'ledger') > 0 ORDER BY length(qn), qn LIMIT 5",
    "hub_top": _W + " SELECT dst AS id, count(DISTINCT src) AS in_degree FROM e WHERE dst IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "scans_recent": f"WITH {_STATE} SELECT s.id, status, (SELECT count(DISTINCT c.id) FROM code_nodes c WHERE c.scan_id = s.id) AS n_nodes FROM s ORDER BY s.id DESC LIMIT 20",
    "common_callees": _W + """, x AS (SELECT n.scan_id, file_path, src, list_sort(list(DISTINCT callee_name)) AS names FROM e JOIN n ON src = n.id AND e.scan_id = n.scan_id GROUP BY ALL),
c AS (SELECT scan_id, file_path, names, min(src) AS src, count(*) AS m FROM x GROUP BY ALL)
SELECT a.src AS a, b.src AS b, a.m AS n_a, b.m AS n_b, round(len(list_intersect(a.names, b.names)) / len(list_distinct(list_concat(a.names, b.names))), 6) AS jaccard FROM c a JOIN c b USING (scan_id, file_path) WHERE a.src < b.src AND jaccard >= 0.5""",
    "scan_diff": f"""WITH {_STATE}, f AS (SELECT project_slug, scan_id, file_path, max(lower(trim(file_hash))) AS h FROM code_nodes JOIN s ON scan_id = s.id GROUP BY ALL),
c AS (SELECT * FROM f WHERE scan_id IN (SELECT scan_id FROM current_scan)), a AS (SELECT * FROM f WHERE (project_slug, scan_id) IN (SELECT project_slug, min(scan_id) FROM f GROUP BY 1))
SELECT * FROM (SELECT project_slug, file_path, CASE WHEN a.scan_id IS NULL THEN 'added' WHEN c.scan_id IS NULL THEN 'removed' WHEN a.h IS DISTINCT FROM c.h THEN 'changed' END AS change FROM a FULL JOIN c USING (project_slug, file_path)) WHERE change IS NOT NULL""",
}
