"""Queries of hierarchies and catalogues over the scans that readers see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import catalog as C
from codestrata.operators import entities, graph, snapshots, vectors
from codestrata.operators import hierarchy as H
from codestrata.plans import pages as P
from codestrata.plans import relations as R
from codestrata.plans.graph_queries import _BASE, _FOLDERS, _LEVELS, _PATHS, _SLICES, _WALK, _entries, _folders, _impact, _level, primary_walk
from codestrata.runtime import table


def _slices(spark, base) -> DataFrame:
    return graph.slices(R.nodes(spark, base), R.edges(spark, base), _entries(spark, base))


def impact_paths(spark: SparkSession, base: str) -> DataFrame:
    """How far the way back to a seed is, for every node a change reaches."""
    _, _, reached, _ = _impact(spark, base)
    return H.best_paths(reached).select("id", (F.size("path") - 1).cast("long").alias("steps"), F.element_at("path", -1).alias("seed"))


def call_paths_all(spark: SparkSession, base: str) -> DataFrame:
    """call_paths() over all edges between known symbols, whatever their confidence."""
    n, e = R.nodes(spark, base), R.edges(spark, base)
    start = n.where("node_type = 'endpoint'").agg(F.min("id").alias("id"))
    goal = n.where("node_type = 'db_model'").orderBy("id").limit(10).select("id")
    return graph.shortest_paths(e.where("src is not null").join(n.select(F.col("id").alias("dst")), "dst", "left_semi"), start, goal).select(F.concat_ws(">", "path").alias("path"))


def folder_ancestors(spark: SparkSession, base: str) -> DataFrame:
    return H.ascend(_folders(spark, base))


def page_parents(spark: SparkSession, base: str) -> DataFrame:
    ctx = P.Context(R.nodes(spark, base), R.edges(spark, base), R.unresolved(spark, base))
    return H.page_tree(P.run_builders(ctx, ["modules", "files"]).select("page_id"))


def route_menu(spark: SparkSession, base: str) -> DataFrame:
    """Routes as a menu: every level of their paths with the routes below it."""
    route = F.regexp_extract("annotations", r"Route\(([^)]*)\)", 1)
    labels = F.filter(F.split(route, "/"), lambda p: p != "")
    return H.menu_tree(R.nodes(spark, base).where("annotations like '%Route(%'").select(labels.alias("labels"))).withColumn("level", F.col("level").cast("long"))


def common_roots(spark: SparkSession, base: str) -> DataFrame:
    """The folder that holds all Java files."""
    return H.common_root(R.nodes(spark, base).where("lower(language) = 'java'"), "file_path")


def flow_caps(spark: SparkSession, base: str) -> DataFrame:
    return H.cap_flows(_slices(spark, base)).where("stop is not null").groupBy("entry").agg(F.count("*").alias("n_stops"), F.count_if(F.col("stop") == "flow_cap").alias("n_capped"))


def domain_tours(spark: SparkSession, base: str) -> DataFrame:
    return H.tours(R.nodes(spark, base), R.edges(spark, base)).withColumn("step", F.col("step").cast("long"))


def domain_groups(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "discovery_chunk_meta").join(R.current(spark, base), "scan_id", "left_semi")
    return H.groups_by_domain(c)


def dependency_catalog(spark: SparkSession, base: str) -> DataFrame:
    """Clients called by name, endpoints by language, and models as keys."""
    n, e = R.nodes(spark, base), R.edges(spark, base)
    ext = e.where("dst is null").select(F.col("callee_name").alias("name"), F.regexp_extract("callee_name", r"^([^.]+)\.", 1).alias("kind"))
    return C.dependencies(ext, n.where("node_type = 'endpoint'").select(F.lower("language").alias("source")), n.where("node_type = 'db_model'").select(F.col("domain").alias("from_table")))


def flow_touches(spark: SparkSession, base: str) -> DataFrame:
    t = C.touches(_slices(spark, base), R.edges(spark, base), R.nodes(spark, base))
    return t.select("entry", F.array_join("reads", ",").alias("reads"), F.size("writes").cast("long").alias("n_writes"))


def symbol_flows(spark: SparkSession, base: str) -> DataFrame:
    return C.flows_through(_slices(spark, base))


def flow_log(spark: SparkSession, base: str) -> DataFrame:
    return C.event_log(primary_walk(spark, base), R.nodes(spark, base)).withColumn("order", F.col("order").cast("long"))


def model_names(spark: SparkSession, base: str) -> DataFrame:
    """Names under which models and classes are shown."""
    n = R.nodes(spark, base).where("node_type in ('db_model', 'class')")
    return C.display_names(n.select(F.concat_ws(".", F.col("scan_id").cast("string"), "qn").alias("entity"), "name"))


def canonical_models(spark: SparkSession, base: str) -> DataFrame:
    """Of the models and classes of a domain the one it is named after."""
    n = R.nodes(spark, base).where("node_type in ('db_model', 'class') and domain is not null")
    return C.canonical(n.select("domain", "name", F.col("id").alias("entity"), "node_type"), "domain", (F.col("node_type") != "db_model").cast("int"))


def state_subsets(spark: SparkSession, base: str) -> DataFrame:
    """Files whose kinds of symbols all occur in a file with an endpoint, in the same scan."""
    n = R.nodes(spark, base).groupBy("scan_id", "file_path").agg(F.min("id").alias("k"), F.collect_set("node_type").alias("states"), F.count_if(F.col("node_type") == "endpoint").alias("m"))
    return C.contained_in(n.where("m = 0").select("scan_id", F.col("k").alias("a"), "states"), n.where("m > 0").select("scan_id", F.col("k").alias("b"), "states"), ["scan_id"])


def graded_now(spark: SparkSession, base: str) -> DataFrame:
    """Edges of the scans that aren't current as graded ones, against the current edges."""
    all_ = table(spark, base, "call_edges").select("scan_id", "callee_name", "resolved_by", "confidence").join(table(spark, base, "call_edges").select("scan_id").distinct(), "scan_id")
    old = all_.join(R.current(spark, base), "scan_id", "left_anti").where("resolved_by <> ''")
    g = old.select(F.col("callee_name").alias("src"), F.lit("").alias("name"), F.col("resolved_by").alias("stratum"), F.col("callee_name").alias("dst"), (F.coalesce("confidence", F.lit(0.0)) >= 0.5).alias("ok")).distinct()
    now = R.edges(spark, base).select(F.col("callee_name").alias("src"), F.lit("").alias("name"), F.col("callee_name").alias("dst"))
    return C.precision_check(g, now)


def scan_file_scores(spark: SparkSession, base: str) -> DataFrame:
    """Files of every scan against the files of its project's current scan."""
    s = table(spark, base, "scan_runs").select(F.col("id").alias("scan_id"), "project_slug").distinct()
    f = table(spark, base, "code_nodes").select("scan_id", F.col("file_path").alias("file")).distinct().join(s, "scan_id")
    gold = f.join(R.current(spark, base), "scan_id", "left_semi").select("project_slug", "file")
    tasks = f.select("scan_id", "project_slug").distinct().join(gold, "project_slug").select(F.col("scan_id").alias("task"), "file")
    return C.file_scores(f.select(F.col("scan_id").alias("task"), "file"), tasks)


def forbidden_calls(spark: SparkSession, base: str) -> DataFrame:
    """Calls back from a model's name to the one that calls it must not be there."""
    n, e = R.nodes(spark, base), R.edges(spark, base)
    named = e.join(n.select(F.col("id").alias("src"), F.col("qn").alias("caller")), "src").select("caller", F.col("callee_name").alias("callee"))
    back = named.select(F.col("callee").alias("caller_suffix"), F.col("caller").alias("callee_suffix")).distinct()
    return C.forbidden_edges(named, back).withColumn("score", F.round("score", 6))


def symbols_missing(spark: SparkSession, base: str) -> DataFrame:
    """Symbols of current scans that no chunk is made of, and chunks without a symbol."""
    n = R.nodes(spark, base).select("scan_id", "qn")
    c = table(spark, base, "discovery_chunk_meta").join(R.current(spark, base), "scan_id", "left_semi").select("scan_id", F.col("qualified_name").alias("qn"))
    return C.missing_and_extra(c, n, ["scan_id", "qn"])


def offered_routes(spark: SparkSession, base: str) -> DataFrame:
    n = R.nodes(spark, base).select(F.col("scan_id").cast("string").alias("slug"), "name", F.regexp_extract(F.coalesce("annotations", F.lit("")), r"Route\(([^)]*)\)", 1).alias("route"), "qn")
    none = spark.createDataFrame([], "slug string, caller string, name string, target string")
    return C.interfaces(n, none)[0]


def renamed_notes(spark: SparkSession, base: str) -> DataFrame:
    """Documents written about a scan, read at the last scan of its chain."""
    from codestrata.operators.manifest_delta import scan_parents

    chain = scan_parents(table(spark, base, "scan_runs")).where("parent is not null").select(F.col("parent").alias("id"), F.col("version").alias("target"))
    notes = table(spark, base, "documents").where("scan_id is not null").select("doc_id", F.col("scan_id").alias("anchor"))
    return C.anchored(notes, chain, R.current(spark, base).withColumnRenamed("scan_id", "anchor"))


def domain_services(spark: SparkSession, base: str) -> DataFrame:
    """Of every model who calls it, and who calls those."""
    n, e = R.nodes(spark, base), R.edges(spark, base).where("src is not null and dst is not null")
    m = n.where("node_type = 'db_model'").select(F.col("id").alias("dst"), F.col("id").alias("entity"))
    s = C.entity_services(e.join(m, "dst").select("entity", F.col("src").alias("repository")).distinct(), e.select(F.col("src").alias("user"), F.col("dst").alias("used")).distinct())
    return s.select("entity", F.size("repositories").cast("long").alias("n_repositories"), F.size("services").cast("long").alias("n_services"))


def main_successors(spark: SparkSession, base: str) -> DataFrame:
    signal = F.when(F.col("edge_kind") == "framework_binds", 2).when(F.col("edge_kind") == "calls", 1).otherwise(0)
    return C.successors(graph.trusted(R.edges(spark, base)), signal)


def slice_ends(spark: SparkSession, base: str) -> DataFrame:
    """Why flows end, with calls that were not resolved."""
    return graph.leaf_reasons(_slices(spark, base), R.unresolved(spark, base)).where("stop is not null").groupBy("stop").agg(F.count("*").alias("n"))


def impact_unresolved(spark: SparkSession, base: str) -> DataFrame:
    n, _, reached, _ = _impact(spark, base)
    return graph.unresolved_unknowns(n, R.unresolved(spark, base), reached)


def indexed_scans(spark: SparkSession, base: str) -> DataFrame:
    from codestrata.operators.manifest_delta import latest_state

    s = latest_state(table(spark, base, "scan_runs").select("id", "project_slug", "commit_sha", "recorded_at"), "id", "recorded_at")
    return snapshots.newest_indexed(s, table(spark, base, "call_edges"))


def node_lists(spark: SparkSession, base: str) -> DataFrame:
    n = R.rehydrated(R.nodes(spark, base))
    return n.select("id", F.size("params").cast("long").alias("n_params"), F.try_element_at("annotations", F.lit(1)).alias("annotation"))


def federated_merge(spark: SparkSession, base: str) -> DataFrame:
    """The machines of federated_groups, each group as one."""
    n = R.nodes(spark, base).where("domain is not null")
    m = n.groupBy(F.col("domain").alias("stem"), F.col("scan_id").cast("string").alias("repo"), F.col("file_path").alias("entity")).agg(F.sort_array(F.collect_set("node_type")).alias("states"), (F.count("*") / (F.count("*") + 1)).alias("confidence"))
    g = entities.merge_federated(m, entities.federated(m))
    return g.select("stem", "group", F.array_join("states", ",").alias("states"), F.round("confidence", 6).alias("confidence"), F.size("origins").cast("long").alias("n_repos"))


def domain_precision(spark: SparkSession, base: str) -> DataFrame:
    """Share of sure edges per origin with bounds, by the engine's SQL functions."""
    from codestrata.functions import sql as functions

    functions.register(spark)
    R.edges(spark, base).createOrReplaceTempView("_precision_edges")
    return spark.sql("SELECT origin, n, round(wilson_low(k, n), 6) AS low, round(wilson_high(k, n), 6) AS high FROM (SELECT origin, count(*) AS n, count_if(confidence >= 0.8) AS k FROM _precision_edges GROUP BY origin)")


def document_vectors(spark: SparkSession, base: str) -> DataFrame:
    """Vectors of titles by hashed words: how many there are, and of which length."""
    v = vectors.embed(table(spark, base, "documents"), "doc_id", "title", vectors.hashed_words, 64)
    return v.groupBy(F.size("vector").cast("long").alias("dim")).agg(F.count("*").alias("n"))


_W = f"WITH {R.NODES}, {R.EDGES}, {R.UNRESOLVED}"
_DOC = "(SELECT DISTINCT scan_id, file_path, qualified_name, domain, chunk_id FROM discovery_chunk_meta WHERE scan_id IN (SELECT scan_id FROM current_scan))"
_ALL = (impact_paths, call_paths_all, folder_ancestors, page_parents, route_menu, common_roots, flow_caps, domain_tours, domain_groups, dependency_catalog, flow_touches, symbol_flows, flow_log, model_names, canonical_models, state_subsets, graded_now, scan_file_scores, forbidden_calls, symbols_missing, offered_routes, renamed_notes, domain_services, main_successors, slice_ends, impact_unresolved, indexed_scans, node_lists, federated_merge, domain_precision, document_vectors)
QUERIES = {f.__name__: f for f in _ALL}
_STOPS = _SLICES + """, o2 AS (SELECT src AS id, count(*) AS k FROM tn GROUP BY 1), ch AS (SELECT DISTINCT a.entry, a.id FROM sl a JOIN tn ON tn.src = a.id JOIN sl b ON b.entry = a.entry AND b.id = tn.dst AND b.depth = a.depth + 1)"""
ORACLE = {
    "impact_paths": _BASE + "".join(_level(d).replace("bool_or(low OR hint) AS possible", "bool_or(low OR hint) AS possible, arg_max(dst, (s * w * conf, -edge_id, dst)) AS parent") for d in (1, 2, 3)) + """, r AS (SELECT id, parent, depth FROM l1 UNION ALL SELECT id, parent, depth FROM l2 UNION ALL SELECT id, parent, depth FROM l3),
b AS (SELECT id, parent AS up1, depth FROM r UNION ALL SELECT b.id, r.parent, b.depth FROM b JOIN r ON r.id = b.up1) SELECT id, CAST(depth AS BIGINT) AS steps, up1 AS seed FROM b WHERE up1 IN (SELECT id FROM l0)""",
    "forbidden_calls": _W + """, q AS (SELECT DISTINCT n.qn AS caller, callee_name AS callee FROM e JOIN n ON n.id = e.src), f AS (SELECT callee AS c, caller AS d FROM q), x AS (SELECT c, d, EXISTS (SELECT 1 FROM q WHERE (q.caller = c OR ends_with(q.caller, '.' || c)) AND (q.callee = d OR ends_with(q.callee, '.' || d))) AS there FROM f)
SELECT count(*) AS n, count(*) FILTER (WHERE NOT there) AS n_absent, round(count(*) FILTER (WHERE NOT there) / count(*), 6) AS score FROM x""",
    "call_paths_all": _PATHS.replace("tn AS (SELECT DISTINCT src, dst FROM t WHERE", "tn AS (SELECT DISTINCT src, dst FROM e WHERE src IS NOT NULL AND"),
    "folder_ancestors": _FOLDERS.split("\nmk AS")[0] + " an AS (SELECT id, parent AS ancestor, 1 AS level FROM up WHERE parent IS NOT NULL UNION ALL SELECT an.id, up.parent, level + 1 FROM an JOIN up ON an.ancestor = up.id WHERE up.parent IS NOT NULL) SELECT DISTINCT id, ancestor, level FROM an",
    "page_parents": _W + """, f AS (SELECT DISTINCT scan_id, string_split(file_path, '/') AS p FROM n), x AS (SELECT DISTINCT 'module:' || scan_id || '/' || array_to_string(p[1:k], '/') AS page_id, CASE WHEN k > 1 THEN 'module:' || scan_id || '/' || array_to_string(p[1:k - 1], '/') END AS parent, k + 1 AS depth FROM (SELECT *, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1)
UNION ALL SELECT 'file:' || scan_id || '/' || array_to_string(p, '/'), CASE WHEN len(p) > 1 THEN 'module:' || scan_id || '/' || array_to_string(p[1:len(p) - 1], '/') END, len(p) + 1 FROM f) SELECT page_id, parent, depth, (SELECT count(*) FROM x y WHERE y.parent = x.page_id) AS n_children FROM x""",
    "route_menu": _W + r", r AS (SELECT list_filter(string_split(regexp_extract(annotations, 'Route\(([^)]*)\)', 1), '/'), lambda p: p <> '') AS p FROM n WHERE annotations LIKE '%Route(%') SELECT array_to_string(p[1:level], ' / ') AS label_path, level, count(*) AS n_screens FROM (SELECT p, unnest(range(1, len(p) + 1)) AS level FROM r) GROUP BY ALL",
    "common_roots": _W + """, d AS (SELECT DISTINCT string_split(file_path, '/') AS p FROM n WHERE lower(language) = 'java'), k AS (SELECT k, count(DISTINCT CASE WHEN len(p) > k THEN array_to_string(p[1:k], '/') END) AS m, count(*) FILTER (WHERE len(p) <= k) AS s FROM d, range(1, 60) r(k) GROUP BY k)
SELECT coalesce((SELECT any_value(array_to_string(p[1:b], '/')) FROM d, (SELECT max(k) AS b FROM k WHERE m = 1 AND s = 0) WHERE b IS NOT NULL), '') AS root""",
    "flow_caps": _STOPS + " SELECT entry, count(*) AS n_stops, greatest(0, count(*) - 50) AS n_capped FROM sl ANTI JOIN ch USING (entry, id) GROUP BY entry",
    "domain_groups": f"SELECT scan_id, file_path, coalesce((list(domain ORDER BY chunk_id))[1], 'dir:' || regexp_extract(file_path, '^(.*)/[^/]*$', 1)) AS community FROM {_DOC} GROUP BY scan_id, file_path",
    "dependency_catalog": _W + r""" SELECT 'external' AS section, regexp_extract(callee_name, '^([^.]+)\.', 1) AS kind, count(DISTINCT callee_name) AS n FROM e WHERE dst IS NULL GROUP BY 2
UNION ALL SELECT 'endpoint', coalesce(lower(language), '(none)'), count(*) FROM n WHERE node_type = 'endpoint' GROUP BY 2 UNION ALL SELECT 'foreign_key', coalesce(domain, '(none)'), count(*) FROM n WHERE node_type = 'db_model' GROUP BY 2""",
    "flow_touches": _SLICES + """, u AS (SELECT src AS id, qn, CASE WHEN edge_kind = 'writes_table' THEN 'w' WHEN edge_kind = 'reads_table' THEN 'r' WHEN edge_kind = 'calls_proc' THEN 'p' WHEN edge_kind = 'calls_external' THEN 'x' WHEN node_type = 'db_model' THEN 'r' WHEN node_type = 'external_system' THEN 'x' END AS k FROM e JOIN n ON n.id = e.dst),
z AS (SELECT DISTINCT entry, k, qn FROM sl JOIN u USING (id) WHERE k IS NOT NULL) SELECT entry, coalesce(string_agg(qn, ',' ORDER BY qn) FILTER (WHERE k = 'r' AND (entry, qn) NOT IN (SELECT entry, qn FROM z WHERE k = 'w')), '') AS reads, count(*) FILTER (WHERE k = 'w') AS n_writes FROM z GROUP BY entry""",
    "symbol_flows": _SLICES + " SELECT id, count(DISTINCT entry) AS n_flows, min(entry) AS first FROM sl GROUP BY id",
    "flow_log": _WALK.replace("SELECT start, pos, id FROM wk", """SELECT start AS case_id, pos AS "order", name AS event_name, CASE WHEN node_type IN ('endpoint', 'batch_job', 'cli_command', 'event_consumer') THEN 'entry' WHEN node_type = 'db_model' THEN 'data' WHEN node_type = 'external_system' THEN 'external' ELSE 'step' END AS event_type FROM wk JOIN n USING (id)"""),
    "model_names": _W + r", m AS (SELECT scan_id || '.' || qn AS entity, name, count(*) OVER (PARTITION BY name) AS k FROM n WHERE node_type IN ('db_model', 'class')) SELECT entity, CASE WHEN k > 1 THEN name || ' (' || regexp_extract(entity, '^(.*)[./][^./]+$', 1) || ')' ELSE name END AS display FROM m",
    "canonical_models": _W + " SELECT domain, id AS entity, name FROM n WHERE node_type IN ('db_model', 'class') AND domain IS NOT NULL QUALIFY row_number() OVER (PARTITION BY domain ORDER BY node_type <> 'db_model', length(name), name, id) = 1",
    "state_subsets": _W + """, f AS (SELECT scan_id, file_path, min(id) AS k, list_sort(list(DISTINCT node_type)) AS s, bool_or(node_type = 'endpoint') AS m FROM n GROUP BY ALL), g AS (SELECT scan_id, m, s, min(k) AS k, count(*) AS c FROM f GROUP BY ALL)
SELECT a.k AS a, b.k AS b, a.c AS n_a, b.c AS n_b FROM g a JOIN g b USING (scan_id) WHERE NOT a.m AND b.m AND list_has_all(b.s, a.s)""",
    "graded_now": _W + """, g AS (SELECT DISTINCT callee_name AS d, resolved_by AS stratum, coalesce(confidence, 0) >= 0.5 AS ok FROM call_edges WHERE scan_id NOT IN (SELECT scan_id FROM current_scan) AND resolved_by <> ''), j AS (SELECT g.*, d IN (SELECT callee_name FROM e) AS there FROM g)
SELECT stratum, count(*) AS n, count(*) FILTER (WHERE there) AS matched, count(*) FILTER (WHERE there AND ok) AS correct, round(count(*) FILTER (WHERE there AND ok) / nullif(count(*) FILTER (WHERE there), 0), 6) AS precision, count(*) FILTER (WHERE NOT there) > 0.2 * count(*) AS drifted FROM j GROUP BY stratum""",
    "scan_file_scores": """WITH s AS (SELECT DISTINCT id AS scan_id, project_slug FROM scan_runs), f AS (SELECT DISTINCT scan_id, file_path AS file, project_slug FROM code_nodes JOIN s USING (scan_id)), g AS (SELECT project_slug, file FROM f WHERE scan_id IN (SELECT scan_id FROM current_scan)),
t AS (SELECT DISTINCT f.scan_id AS task, g.file FROM (SELECT DISTINCT scan_id, project_slug FROM f) f JOIN g USING (project_slug)), c AS (SELECT DISTINCT scan_id AS task, file FROM f),
j AS (SELECT coalesce(c.task, t.task) AS task, c.file AS a, t.file AS b FROM c FULL JOIN t ON c.task = t.task AND c.file = t.file) SELECT task, count(a) AS n_changed, count(b) AS n_gold, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_both, round(coalesce(n_both / nullif(n_changed, 0), 0), 6) AS precision, round(coalesce(n_both / nullif(n_gold, 0), 0), 6) AS recall FROM j GROUP BY task""",
    "symbols_missing": _W + f", c AS (SELECT DISTINCT scan_id, qualified_name AS qn FROM {_DOC}), s AS (SELECT DISTINCT scan_id, qn FROM n) SELECT *, 'missing' AS side FROM (SELECT * FROM s EXCEPT SELECT * FROM c) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM c EXCEPT SELECT * FROM s)",
    "offered_routes": _W + r" SELECT DISTINCT CAST(scan_id AS VARCHAR) AS slug, coalesce(nullif(upper(regexp_extract(lower(name), '(get|post|put|delete|patch|head)', 1)), ''), 'GET') AS method, regexp_extract(annotations, 'Route\(([^)]*)\)', 1) AS route, qn AS handler FROM n WHERE annotations LIKE '%Route(%'",
    "renamed_notes": """WITH RECURSIVE state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC) AS k FROM scan_runs) WHERE k = 1), done AS (SELECT * FROM state WHERE status = 'completed'),
p AS (SELECT * FROM (SELECT id, lead(id) OVER (PARTITION BY project_slug, branch ORDER BY started_at) AS target FROM done) WHERE target IS NOT NULL), w AS (SELECT id, target, 1 AS hops FROM p UNION ALL SELECT w.id, p.target, hops + 1 FROM w JOIN p ON w.target = p.id WHERE hops < 40),
e AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops DESC) = 1) SELECT coalesce(e.target, d.scan_id) AS anchor, doc_id FROM documents d LEFT JOIN e ON e.id = d.scan_id WHERE d.scan_id IS NOT NULL AND coalesce(e.target, d.scan_id) IN (SELECT scan_id FROM current_scan)""",
    "domain_services": _W + ", x AS (SELECT DISTINCT n.id AS entity, src AS r FROM e JOIN n ON n.id = dst WHERE node_type = 'db_model' AND src IS NOT NULL), y AS (SELECT DISTINCT src, dst FROM e WHERE src IS NOT NULL AND dst IS NOT NULL) SELECT entity, count(DISTINCT r) AS n_repositories, count(DISTINCT y.src) AS n_services FROM x LEFT JOIN y ON y.dst = r GROUP BY entity",
    "slice_ends": _STOPS + """, ur AS (SELECT caller_id AS id, min(CASE reason WHEN 'dynamic' THEN 0 WHEN 'external' THEN 1 ELSE 2 END) AS r FROM unresolved_calls WHERE scan_id IN (SELECT scan_id FROM current_scan) AND caller_id IS NOT NULL GROUP BY 1),
z AS (SELECT CASE WHEN node_type = 'external_system' THEN 'external_boundary' WHEN node_type = 'db_model' THEN 'db_boundary' WHEN k IS NULL THEN CASE r WHEN 0 THEN 'dynamic_dispatch' WHEN 1 THEN 'external_boundary' WHEN 2 THEN 'unresolved_call' ELSE 'leaf_no_callees' END WHEN sl.depth >= 8 THEN 'depth_cap' ELSE 'cycle' END AS stop
  FROM sl ANTI JOIN ch USING (entry, id) LEFT JOIN o2 USING (id) LEFT JOIN n ON n.id = sl.id LEFT JOIN ur ON ur.id = sl.id) SELECT stop, count(*) AS n FROM z GROUP BY stop""",
    "impact_unresolved": _LEVELS + """, re AS (SELECT id FROM l0 UNION SELECT id FROM l1 UNION SELECT id FROM l2 UNION SELECT id FROM l3) SELECT DISTINCT caller_id, callee_name, reason FROM unresolved_calls WHERE scan_id IN (SELECT scan_id FROM current_scan) AND reason NOT IN ('builtin', 'external')
  AND regexp_extract(callee_name, '([^.]+)$', 1) IN (SELECT name FROM n WHERE id IN (SELECT id FROM re)) AND (caller_id IS NULL OR caller_id NOT IN (SELECT id FROM re))""",
    "indexed_scans": "SELECT project_slug, max(id) AS scan_id FROM (SELECT * FROM scan_runs QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC) = 1) WHERE id IN (SELECT scan_id FROM call_edges) GROUP BY project_slug",
    "node_lists": _W + " SELECT id, CAST(json_array_length(params) AS BIGINT) AS n_params, json_extract_string(annotations, '$[0]') AS annotation FROM n",
    "document_vectors": "SELECT CASE WHEN title IS NULL THEN NULL ELSE 64 END AS dim, count(*) AS n FROM documents GROUP BY 1",
    "domain_precision": _W + ", g AS (SELECT origin, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.8) AS k FROM e GROUP BY origin) SELECT origin, n, round(greatest(0.0, (k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 6) AS low, round(least(1.0, (k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)), 6) AS high FROM g",
    "main_successors": _BASE + " SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY CASE edge_kind WHEN 'framework_binds' THEN 2 WHEN 'calls' THEN 1 ELSE 0 END DESC, conf DESC, edge_id) AS k FROM t) WHERE k = 1",
}
