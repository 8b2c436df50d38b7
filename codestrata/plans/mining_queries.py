"""Queries of joins beyond equality, resolution, mining and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import graph, joins, mining, resolve, rollups, snapshots, typed_calls
from codestrata.operators import text as T
from codestrata.operators.manifest_delta import latest_state
from codestrata.plans import relations as R
from codestrata.plans.graph_queries import _BASE
from codestrata.runtime import table


def _hunks(spark, base) -> DataFrame:
    """Lines of unresolved calls, one more on either side, as changed spans."""
    u = R.unresolved(spark, base).where("line is not null")
    return u.select(F.col("id").alias("hunk"), "scan_id", F.col("file").alias("file_path"), (F.col("line") - 1).alias("lo"), (F.col("line") + 1).alias("hi"))


def _hits(spark, base) -> DataFrame:
    n = R.nodes(spark, base).where("line_start is not null").select("id", "scan_id", "file_path", "line_start", "line_end")
    return joins.overlapping(_hunks(spark, base), n, ["scan_id", "file_path"])


def hunk_overlap(spark: SparkSession, base: str) -> DataFrame:
    return _hits(spark, base).select("hunk", "id")


def innermost_span(spark: SparkSession, base: str) -> DataFrame:
    return joins.innermost(_hits(spark, base), ["hunk"], "id").select("hunk", "id")


def longest_prefix_root(spark: SparkSession, base: str) -> DataFrame:
    """Of every file the nearest folder that directly holds a configuration file or an endpoint."""
    n = R.nodes(spark, base)
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    roots = n.where(F.col("node_type").isin("config", "endpoint")).select("scan_id", folder.alias("root"))
    return joins.nearest_ancestor(n, "file_path", roots, "root", ["scan_id"])


def as_of_value(spark: SparkSession, base: str) -> DataFrame:
    """Of every purchase the value of the user's last click before."""
    e = table(spark, base, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = joins.as_of(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'click'").select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", "value", "event_id")
    return out.select("event_id", "last_value")


def provider_consumer(spark: SparkSession, base: str) -> DataFrame:
    """Projects that declare the same route, as providers and consumers of each other."""
    s = latest_state(table(spark, base, "scan_runs").select("id", "project_slug", "recorded_at"), "id", "recorded_at").select(F.col("id").alias("scan_id"), F.col("project_slug").alias("slug"))
    r = R.nodes(spark, base).where("annotations like '%Route(%'").join(s, "scan_id")
    side = r.select("slug", F.lit("GET").alias("method"), T.normal_route(F.regexp_extract("annotations", r"Route\(([^)]*)\)", 1)).alias("route"))
    return joins.providers_and_consumers(side, side)


def convention_tests(spark: SparkSession, base: str) -> DataFrame:
    f = R.nodes(spark, base).select(F.concat_ws("/", F.col("scan_id").cast("string"), "file_path").alias("file")).distinct()
    return joins.convention_tests(f, f)


def module_files(spark: SparkSession, base: str) -> DataFrame:
    """Qualified names of Python symbols without their last part, found among the files of all scans."""
    n = R.nodes(spark, base)
    m = n.where("lower(language) = 'python'").select(F.regexp_extract("qn", r"^(.*)\.[^.]+$", 1).alias("module")).where("module <> ''").distinct()
    return joins.modules_to_files(m, n.select(F.col("file_path").alias("file")).distinct())


def _sites(spark, base) -> DataFrame:
    n = R.nodes(spark, base).select(F.col("id").alias("src"), "scan_id", F.col("qn").alias("caller_qn"), "file_path", "language")
    e = R.edges(spark, base).join(n, ["src", "scan_id"])
    last = F.regexp_extract("callee_name", r"([^.]+)$", 1)
    owner = F.regexp_extract("callee_name", r"([^.]+)\.[^.]+$", 1)
    return e.select(F.col("edge_id").alias("site"), "scan_id", "caller_qn", "file_path", "language", last.alias("name"), F.when(F.col("edge_type") == "dispatch", F.nullif(owner, F.lit(""))).alias("receiver"))


def _symbols(spark, base) -> DataFrame:
    """Symbols by the last part of their qualified name."""
    return R.nodes(spark, base).withColumn("name", F.regexp_extract("qn", r"([^.]+)$", 1))


def resolve_tiers(spark: SparkSession, base: str) -> DataFrame:
    good, _ = resolve.resolve(_sites(spark, base), _symbols(spark, base))
    return good.select("site", "id", "origin")


def unresolved_reasons(spark: SparkSession, base: str) -> DataFrame:
    _, rest = resolve.resolve(_sites(spark, base), _symbols(spark, base))
    return rest.groupBy("reason").agg(F.count("*").alias("n"))


def _typed(spark, base) -> tuple[DataFrame, DataFrame]:
    """Calls whose receiver names a type. Types are what callables belong to by
    their names; the first type of a folder is taken for the base of the others."""
    n = _symbols(spark, base).withColumn("extends_type", F.lit(None).cast("string"))
    callables = n.where(F.col("node_type").isin("method", "function", "endpoint"))
    c = callables.select("scan_id", resolve.owner(F.col("qn")).alias("qn"), "id", "file_path", F.lower("language").alias("language"), F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("dir")).groupBy("scan_id", "qn").agg(F.min("id").alias("id"), F.min("file_path").alias("file_path"), F.min("language").alias("language"), F.min("dir").alias("dir"))
    none = F.lit(None).cast("string")
    types = c.select("id", "scan_id", "qn", typed_calls.short(F.col("qn")).alias("name"), F.lit("class").alias("node_type"), "language", "file_path", none.alias("return_type"), none.alias("extends_type"))
    symbols = callables.select(types.columns).unionByName(types)
    bases = c.join(c.groupBy("scan_id", "dir").agg(F.min("qn").alias("base")), ["scan_id", "dir"]).where("qn <> base").select("scan_id", F.col("qn").alias("class_qn"), "base")
    variables = spark.createDataFrame([], "scan_id long, scope string, variable string, type_name string")
    return typed_calls.resolve_typed(_sites(spark, base), variables, symbols, bases)


def typed_receivers(spark: SparkSession, base: str) -> DataFrame:
    return _typed(spark, base)[0].select("site", "id", "origin", "confidence")


def untyped_receivers(spark: SparkSession, base: str) -> DataFrame:
    return _typed(spark, base)[1].groupBy("reason").agg(F.count("*").alias("n"), F.sum("n_candidates").alias("n_candidates"))


def dispatch_fanout(spark: SparkSession, base: str) -> DataFrame:
    """Calls by name to all methods of that name in the scan, refused above the cap."""
    n = _symbols(spark, base)
    m = n.where(F.col("node_type").isin("method", "function", "endpoint")).select(F.col("scan_id").alias("interface"), "name", "id")
    c = _sites(spark, base).select("site", F.col("scan_id").alias("interface"), "name")
    edges, _ = resolve.implementations(c, m)
    return edges.groupBy("origin").agg(F.count("*").alias("n"))


def _log(spark, base) -> DataFrame:
    return table(spark, base, "events").select("user_id", "ts", "event_id", "event_type", F.when(F.col("value") >= 50, "high").otherwise("low").alias("level"))


def fsm_rollup(spark: SparkSession, base: str) -> DataFrame:
    m = mining.state_machines(mining.transitions(_log(spark, base), "user_id", ["ts", "event_id"], "event_type"))
    return m.select("entity", F.array_join("states", ",").alias("states"), "n_moves", "n_times")


def sequence_mining(spark: SparkSession, base: str) -> DataFrame:
    """Node types along the dominant walks from all symbols."""
    n = R.nodes(spark, base)
    signal = F.when(F.col("edge_kind") == "framework_binds", 2).when(F.col("edge_kind") == "calls", 1).otherwise(0)
    walks = graph.dominant_walk(R.edges(spark, base), n.select("id"), signal).join(n.select("id", "node_type"), "id")
    return mining.sequences(walks, "start", "node_type", "pos", 2, 0.5)


def condition_mining(spark: SparkSession, base: str) -> DataFrame:
    return mining.conditions(_log(spark, base), "user_id", "event_type", "level", ["ts", "event_id"], 2, 0.5)


def machine_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Files of a project's scan compared by the domains of their symbols."""
    n = R.nodes(spark, base).where("domain is not null")
    s = n.groupBy("scan_id", "file_path").agg(F.sort_array(F.collect_set("node_type")).alias("items"), F.min("id").alias("k"), F.min("domain").alias("d"))
    p = mining.set_pairs(s, "k", "items", F.concat_ws("|", F.col("scan_id").cast("string"), "d"))
    return p.withColumn("decision", mining.pair_decision(F.col("jaccard"), F.col("size_ratio"), F.lit(1.0), F.col("coverage")))


def machine_merge(spark: SparkSession, base: str) -> DataFrame:
    n = R.nodes(spark, base).where("domain is not null")
    s = n.groupBy("scan_id", "file_path").agg(F.sort_array(F.collect_set("node_type")).alias("states"), F.min("id").alias("entity"), F.min("domain").alias("d"), F.min("name").alias("name"))
    sets = s.select(F.col("entity").alias("k"), F.col("states").alias("items"), "scan_id", "d")
    block = F.concat_ws("|", F.col("scan_id").cast("string"), "d")
    p = mining.set_pairs(sets, "k", "items", block)
    merges = p.where(mining.pair_decision(F.col("jaccard"), F.col("size_ratio"), F.lit(1.0), F.col("coverage")) == "merge").select("a", "b")
    alike = mining.set_members(sets, "k", "items", block).select(F.col("k").alias("a"), F.col("rep").alias("b"))
    m = mining.merge_machines(s, merges.unionByName(alike))
    return m.select("component", "name", "n_members", F.array_join("states", ",").alias("states"))


def file_communities(spark: SparkSession, base: str) -> DataFrame:
    w = rollups.file_graph(R.nodes(spark, base), R.edges(spark, base)).select(F.col("file_a").alias("a"), F.col("file_b").alias("b"), "weight")
    v = R.nodes(spark, base).select(F.concat_ws("/", F.col("scan_id").cast("string"), "file_path").alias("id")).distinct()
    return mining.communities(w, v).groupBy("community").agg(F.count("*").alias("n_files"))


def pack_batches(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "discovery_chunk_meta").join(R.current(spark, base), "scan_id", "left_semi").select("scan_id", "chunk_id", T.token_estimate(F.col("chunk_text")).alias("tokens")).distinct()
    return mining.pack(c, ["scan_id"], ["chunk_id"], "tokens", 10, 1_500).select("scan_id", "chunk_id", "bin")


def _states(spark, base) -> DataFrame:
    return latest_state(table(spark, base, "scan_runs").select("id", "project_slug", "status", "recorded_at"), "id", "recorded_at")


def snapshot_gc(spark: SparkSession, base: str) -> DataFrame:
    return snapshots.expired(_states(spark, base), table(spark, base, "current_scan"))


def drift_check(spark: SparkSession, base: str) -> DataFrame:
    """Files of every scan against the scan its project's readers see."""
    s = _states(spark, base).select(F.col("id").alias("scan_id"), "project_slug")
    f = table(spark, base, "code_nodes").join(s, "scan_id").groupBy("project_slug", "scan_id", "file_path").agg(F.max(F.lower(F.trim("file_hash"))).alias("h"))
    first = f.join(f.groupBy("project_slug").agg(F.min("scan_id").alias("scan_id")), ["project_slug", "scan_id"], "left_semi")
    return snapshots.drift(first, f.join(R.current(spark, base), "scan_id", "left_semi"), ["project_slug", "file_path"], "h").groupBy("state").agg(F.count("*").alias("n"))


def reuse_by_hash(spark: SparkSession, base: str) -> DataFrame:
    """Nodes of the readers' scans whose return type is known from another scan's node of the same name, path and hash."""
    n = table(spark, base, "code_nodes").select("id", "scan_id", "qualified_name", "file_path", "file_hash", "return_type").distinct()
    now, old = n.join(R.current(spark, base), "scan_id", "left_semi"), n.join(R.current(spark, base), "scan_id", "left_anti")
    values = old.where("return_type is not null").select("id", "return_type")
    have = now.where("return_type is not null").select("id")
    return snapshots.reusable(now, old, values, have, ["qualified_name", "file_path", "file_hash"])


_W = f"WITH {R.NODES}, {R.EDGES}, {R.UNRESOLVED}"
_HIT = _W + """, h AS (SELECT u.id AS hunk, n.id, line_start, coalesce(line_end, line_start) AS line_end FROM u JOIN n ON u.scan_id = n.scan_id AND u.file = n.file_path
  WHERE line IS NOT NULL AND line_start <= line + 1 AND coalesce(line_end, line_start) >= line - 1)"""
_ST = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC) AS k FROM scan_runs) WHERE k = 1)"
_PAIRS = _W + """, g AS (SELECT scan_id, file_path, list_sort(list(DISTINCT node_type)) AS items, min(id) AS k, min(domain) AS d FROM n WHERE domain IS NOT NULL GROUP BY ALL),
h AS (SELECT scan_id, d, items, min(k) AS k, count(*) AS m FROM g GROUP BY ALL),
p AS (SELECT a.k AS a, b.k AS b, a.m AS n_a, b.m AS n_b, len(list_intersect(a.items, b.items)) AS i, len(list_distinct(list_concat(a.items, b.items))) AS uni, least(len(a.items), len(b.items)) AS lo, greatest(len(a.items), len(b.items)) AS hi FROM h a JOIN h b ON a.scan_id = b.scan_id AND a.d = b.d AND a.k < b.k)
SELECT a, b, n_a, n_b, round(i / uni, 6) AS jaccard, round(lo / hi, 6) AS size_ratio, round(i / lo, 6) AS coverage, CASE WHEN (i / uni >= 0.9 AND lo / hi >= 0.7) OR (i / uni >= 0.7 AND lo / hi >= 0.7) THEN 'merge' WHEN lo / hi < 0.5 AND i / lo >= 0.8 THEN 'projection' ELSE 'skip' END AS decision FROM p"""
_SITES = _BASE + r""", si AS (SELECT edge_id AS site, e.scan_id, n.qn AS caller_qn, n.file_path, n.language, regexp_extract(callee_name, '([^.]+)$', 1) AS name,
  CASE WHEN edge_type = 'dispatch' THEN nullif(regexp_extract(callee_name, '([^.]+)\.[^.]+$', 1), '') END AS receiver FROM e JOIN n ON e.src = n.id AND e.scan_id = n.scan_id),
y AS (SELECT * REPLACE (regexp_extract(qn, '([^.]+)$', 1) AS name), regexp_extract(qn, '^(.*)\.[^.]+$', 1) AS own, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir FROM n),
x AS (SELECT *, regexp_extract(caller_qn, '^(.*)\.[^.]+$', 1) AS cown, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS cdir FROM si),
c AS (SELECT site, 1 AS tier, 'self_scope' AS origin, y.id FROM x JOIN y ON x.scan_id = y.scan_id AND x.cown = y.own AND x.name = y.name WHERE receiver IS NULL OR receiver IN ('self', 'this')
UNION SELECT site, 3, 'receiver_typed', y.id FROM x JOIN y ON x.scan_id = y.scan_id AND x.receiver = regexp_extract(y.own, '([^.]+)$', 1) AND x.name = y.name
UNION SELECT site, 5, 'same_file', y.id FROM x JOIN y ON x.scan_id = y.scan_id AND x.file_path = y.file_path AND x.name = y.name WHERE receiver IS NULL
UNION SELECT site, 6, 'same_package', y.id FROM x JOIN y ON x.scan_id = y.scan_id AND x.cdir = y.dir AND x.name = y.name WHERE receiver IS NULL
UNION SELECT site, 7, CASE WHEN receiver IS NULL THEN 'global_unique' ELSE 'receiver_global' END, y.id FROM x JOIN y ON x.scan_id = y.scan_id AND x.name = y.name AND lower(x.language) IS NOT DISTINCT FROM lower(y.language)),
pt AS (SELECT site, tier, count(DISTINCT id) AS n, min(id) AS id, min(origin) AS origin FROM c GROUP BY ALL), f AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY site ORDER BY tier) = 1)"""

_TYPED = _SITES + r""", ca AS (SELECT * FROM y WHERE node_type IN ('method', 'function', 'endpoint')),
cl AS (SELECT scan_id, own AS cqn, regexp_extract(own, '([^.]+)$', 1) AS short, min(id) AS cid, min(file_path) AS cfile, min(dir) AS dir FROM ca GROUP BY scan_id, own),
ba AS (SELECT scan_id, dir, min(cqn) AS base FROM cl GROUP BY ALL), bs AS (SELECT cl.scan_id, cl.cqn, b2.cqn AS base FROM cl JOIN ba USING (scan_id, dir) JOIN cl b2 ON b2.scan_id = cl.scan_id AND b2.short = regexp_extract(ba.base, '([^.]+)$', 1) WHERE cl.cqn <> ba.base AND b2.cqn <> cl.cqn),
tj AS (SELECT site, x.name AS member, x.scan_id, cid, cqn, cfile = file_path OR regexp_extract(cfile, '^(.*)/[^/]*$', 1) = cdir AS near FROM x JOIN cl ON cl.scan_id = x.scan_id AND short = receiver),
tp AS (SELECT site, any_value(member) AS member, any_value(scan_id) AS scan_id, count(DISTINCT cid) FILTER (WHERE near) AS nn, count(DISTINCT cid) AS n, arg_min(cqn, cid) FILTER (WHERE near) AS nq, arg_min(cqn, cid) AS aq FROM tj GROUP BY site),
tq AS (SELECT site, member, scan_id, n, CASE WHEN nn = 1 THEN nq WHEN n = 1 THEN aq END AS cqn, CASE WHEN nn = 1 THEN 'receiver_typed' WHEN n = 1 THEN 'receiver_global' END AS origin FROM tp),
t1 AS (SELECT site, ca.id, tq.origin FROM tq JOIN ca ON ca.scan_id = tq.scan_id AND ca.qn = cqn || '.' || member),
t2 AS (SELECT site, min(ca.id) AS id, 'inherited' AS origin FROM tq JOIN bs USING (scan_id, cqn) JOIN ca ON ca.scan_id = tq.scan_id AND ca.qn = bs.base || '.' || member WHERE site NOT IN (SELECT site FROM t1) GROUP BY site HAVING count(DISTINCT ca.id) = 1),
tg AS (SELECT site, id, origin, o_conf AS confidence FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) JOIN o USING (origin))"""
QUERIES = {f.__name__: f for f in (hunk_overlap, innermost_span, longest_prefix_root, as_of_value, provider_consumer, convention_tests, module_files, resolve_tiers, unresolved_reasons, typed_receivers, untyped_receivers, dispatch_fanout, fsm_rollup, sequence_mining, condition_mining, machine_pairs, machine_merge, file_communities, pack_batches, snapshot_gc, drift_check, reuse_by_hash)}
ORACLE = {
    "hunk_overlap": _HIT + " SELECT hunk, id FROM h",
    "innermost_span": _HIT + " SELECT hunk, id FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.hunk = h.hunk AND h.line_start <= o.line_start AND h.line_end >= o.line_end AND (h.line_start < o.line_start OR h.line_end > o.line_end))",
    "longest_prefix_root": _W + r""", r AS (SELECT DISTINCT scan_id, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS root FROM n WHERE node_type IN ('config', 'endpoint')), f AS (SELECT DISTINCT scan_id, file_path FROM n)
SELECT f.scan_id, f.file_path, (SELECT arg_max(root, length(root)) FROM r WHERE r.scan_id = f.scan_id AND (f.file_path = root OR starts_with(f.file_path, root || '/'))) AS nearest FROM f""",
    "as_of_value": "SELECT p.event_id, (SELECT c.value FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND (c.ts, c.event_id) < (p.ts, p.event_id) ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) AS last_value FROM events p WHERE p.event_type = 'purchase'",
    "provider_consumer": f"WITH {R.NODES}, {_ST}, r AS (SELECT DISTINCT project_slug AS slug, lower(regexp_extract(annotations, 'Route\\(([^)]*)\\)', 1)) AS route FROM n JOIN s ON n.scan_id = s.id WHERE annotations LIKE '%Route(%') SELECT a.slug AS provider, b.slug AS consumer, route FROM r a JOIN r b USING (route) WHERE a.slug <> b.slug",
    "convention_tests": _W + r""", f AS (SELECT DISTINCT CAST(scan_id AS VARCHAR) || '/' || file_path AS file FROM n), b AS (SELECT file, regexp_extract(file, '([^/]+)\.[^.]+$', 1) AS b, regexp_extract(file, '\.([^./]+)$', 1) AS x FROM f),
w AS (SELECT file, unnest(['test_' || b || '.' || x, b || '_test.' || x, b || 'Test.' || x, b || 'Tests.' || x, b || '.test.' || x, b || '.spec.' || x, b || 'Spec.' || x, b || '_spec.' || x]) AS name FROM b)
SELECT w.file, arg_min(t.file, (length(t.file), t.file)) AS test FROM w JOIN f t ON regexp_extract(t.file, '([^/]+)$', 1) = w.name GROUP BY 1""",
    "resolve_tiers": _SITES + " SELECT site, id, origin FROM f WHERE n = 1",
    "unresolved_reasons": _SITES + " SELECT reason, count(*) AS n FROM (SELECT CASE WHEN f.n > 1 THEN 'ambiguous' WHEN name IN ('" + "', '".join(resolve.BUILTINS) + "') OR regexp_matches(name, '^__.*__$') THEN 'builtin' WHEN regexp_matches(coalesce(receiver, ''), '[(\\[]') THEN 'dynamic' ELSE 'not_found' END AS reason FROM si LEFT JOIN f USING (site) WHERE f.n IS NULL OR f.n > 1) GROUP BY 1",
    "typed_receivers": _TYPED + " SELECT site, id, origin, CAST(confidence AS DOUBLE) AS confidence FROM tg",
    "untyped_receivers": _TYPED + " SELECT CASE WHEN cqn IS NULL THEN 'di_ambiguous' ELSE 'not_found' END AS reason, count(*) AS n, CAST(sum(CASE WHEN cqn IS NULL THEN n ELSE 0 END) AS BIGINT) AS n_candidates FROM tq WHERE site NOT IN (SELECT site FROM tg) GROUP BY 1",
    "dispatch_fanout": _SITES + ", m AS (SELECT scan_id, name, count(*) AS k FROM y WHERE node_type IN ('method', 'function', 'endpoint') GROUP BY ALL) SELECT CASE WHEN k = 1 THEN 'framework' ELSE 'dispatch' END AS origin, CAST(sum(k) AS BIGINT) AS n FROM si JOIN m USING (scan_id, name) WHERE k <= 24 GROUP BY 1",
    "fsm_rollup": "WITH x AS (SELECT user_id AS entity, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM events), m AS (SELECT * FROM x WHERE a IS NOT NULL AND a <> b) SELECT entity, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT a AS v FROM m k WHERE k.entity = m.entity UNION SELECT b FROM m k WHERE k.entity = m.entity)) AS states, count(DISTINCT (a, b)) AS n_moves, count(*) AS n_times FROM m GROUP BY entity",
    "sequence_mining": _BASE + f""", nx AS (SELECT src, dst AS nxt FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY CASE edge_kind WHEN 'framework_binds' THEN 2 WHEN 'calls' THEN 1 ELSE 0 END DESC, conf DESC, edge_id) AS k FROM t) WHERE k = 1),
wk AS (SELECT id AS start, 0 AS pos, id, [id] AS path FROM n UNION ALL SELECT start, pos + 1, nxt, list_append(path, nxt) FROM wk JOIN nx ON src = wk.id WHERE pos < {graph.WALK - 1} AND NOT list_contains(path, nxt)),
w AS (SELECT start, node_type AS x, min(pos) AS p FROM wk JOIN n USING (id) GROUP BY ALL), q AS (SELECT a.x AS before, b.x AS after, count(*) AS support FROM w a JOIN w b USING (start) WHERE a.p < b.p GROUP BY ALL)
SELECT q.before, q.after, q.support, round(q.support / (q.support + coalesce(r.support, 0)), 6) AS confidence FROM q LEFT JOIN q r ON r.before = q.after AND r.after = q.before WHERE q.support >= 2 AND q.support / (q.support + coalesce(r.support, 0)) >= 0.5""",
    "condition_mining": """WITH r AS (SELECT user_id, event_type, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
f AS (SELECT user_id, event_type AS target, min(p) AS tp FROM r GROUP BY ALL), z AS (SELECT f.user_id, target, r.event_type AS context, arg_max(s, p) AS state FROM f JOIN r ON f.user_id = r.user_id AND p < tp AND r.event_type <> target GROUP BY ALL),
b AS (SELECT target, context, count(*) AS base FROM z GROUP BY ALL), k AS (SELECT target, context, state, count(*) AS support FROM z GROUP BY ALL) SELECT target, context, state, support, round(support / base, 6) AS consistency FROM k JOIN b USING (target, context) WHERE support >= 2 AND support / base >= 0.5""",
    "machine_pairs": _PAIRS,
    "pack_batches": """WITH RECURSIVE c AS (SELECT scan_id, chunk_id, tokens, row_number() OVER (PARTITION BY scan_id ORDER BY chunk_id) AS k FROM (SELECT DISTINCT scan_id, chunk_id, CAST(floor(coalesce(length(chunk_text), 0) / 4) AS BIGINT) AS tokens FROM discovery_chunk_meta WHERE scan_id IN (SELECT scan_id FROM current_scan))),
p AS (SELECT scan_id, chunk_id, k, 0 AS bin, 1 AS n, tokens AS size FROM c WHERE k = 1
  UNION ALL SELECT c.scan_id, c.chunk_id, c.k, CASE WHEN n < 10 AND size + c.tokens <= 1500 THEN bin ELSE bin + 1 END, CASE WHEN n < 10 AND size + c.tokens <= 1500 THEN n + 1 ELSE 1 END, CASE WHEN n < 10 AND size + c.tokens <= 1500 THEN size + c.tokens ELSE c.tokens END FROM p JOIN c ON c.scan_id = p.scan_id AND c.k = p.k + 1)
SELECT scan_id, chunk_id, bin FROM p""",
    "snapshot_gc": f"WITH {_ST} SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY project_slug ORDER BY id DESC) AS r FROM s) WHERE r > 3 AND status <> 'running' AND id NOT IN (SELECT scan_id FROM current_scan)",
    "drift_check": f"""WITH {_ST}, f AS (SELECT project_slug, scan_id, file_path, max(lower(trim(file_hash))) AS h FROM code_nodes JOIN s ON scan_id = s.id GROUP BY ALL), c AS (SELECT * FROM f WHERE scan_id IN (SELECT scan_id FROM current_scan)), a AS (SELECT * FROM f WHERE (project_slug, scan_id) IN (SELECT project_slug, min(scan_id) FROM f GROUP BY 1))
SELECT CASE WHEN c.scan_id IS NULL THEN 'missing' WHEN a.h IS NOT DISTINCT FROM c.h THEN 'fresh' ELSE 'changed' END AS state, count(*) AS n FROM a LEFT JOIN c USING (project_slug, file_path) GROUP BY 1""",
    "reuse_by_hash": """WITH n AS (SELECT DISTINCT id, scan_id, qualified_name AS q, file_path AS f, file_hash AS h, return_type AS t FROM code_nodes), c AS (SELECT * FROM n WHERE scan_id IN (SELECT scan_id FROM current_scan)), o AS (SELECT * FROM n WHERE scan_id NOT IN (SELECT scan_id FROM current_scan) AND t IS NOT NULL)
SELECT c.id, arg_max(o.t, o.id) AS return_type FROM c JOIN o USING (q, f, h) WHERE c.t IS NULL AND h <> '' GROUP BY c.id""",
}
