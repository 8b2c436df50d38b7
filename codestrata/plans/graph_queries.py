"""Queries of the graph operators over the scans that readers see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import origins as O
from codestrata.operators import graph
from codestrata.plans import relations as R


def _seeds(spark, base) -> DataFrame:
    """Of each scan the data model with the least id."""
    return R.nodes(spark, base).where("node_type = 'db_model'").groupBy("scan_id").agg(F.min("id").alias("id")).select("id")


def _impact(spark, base):
    n, e = R.nodes(spark, base), R.edges(spark, base)
    return n, e, *graph.impact_levels(n, e, _seeds(spark, base))


def impact_reverse(spark: SparkSession, base: str) -> DataFrame:
    n, _, reached, _ = _impact(spark, base)
    return graph.impact_items(n, reached).select("id", "node", "kind", "score", "depth", "certainty")


def impact_unknowns(spark: SparkSession, base: str) -> DataFrame:
    *_, unknowns = _impact(spark, base)
    return unknowns


def impact_top(spark: SparkSession, base: str) -> DataFrame:
    n, _, reached, _ = _impact(spark, base)
    items = graph.impact_items(n, reached)
    return graph.cap(items, graph.ITEMS, F.desc("score"), F.asc("depth"), F.asc("node"), F.asc("id")).select(F.col("rank").cast("long").alias("rank"), "id", "score", "total", "omitted")


def impact_by_kind(spark: SparkSession, base: str) -> DataFrame:
    n, _, reached, _ = _impact(spark, base)
    return graph.impact_items(n, reached).groupBy("kind").agg(F.count("*").alias("n"))


def hub_nodes(spark: SparkSession, base: str) -> DataFrame:
    n, e = R.nodes(spark, base), R.edges(spark, base)
    d = graph.in_degrees(graph.usable_edges(e, n))
    t = graph.hub_threshold(d)
    return d.join(F.broadcast(t)).where("in_degree >= threshold").select("id", "in_degree", "threshold")


def neighbourhood_2(spark: SparkSession, base: str) -> DataFrame:
    n, e = R.nodes(spark, base), R.edges(spark, base)
    first = n.agg(F.min("id").alias("id"))
    return graph.neighbourhood(e, first, 2)


def call_paths(spark: SparkSession, base: str) -> DataFrame:
    """All shortest trusted paths from the endpoint with the least id to any of the ten models with the least ids."""
    n, e = R.nodes(spark, base), R.edges(spark, base)
    start = n.where("node_type = 'endpoint'").agg(F.min("id").alias("id"))
    goal = n.where("node_type = 'db_model'").orderBy("id").limit(10).select("id")
    return graph.shortest_paths(graph.trusted(e).join(n.select(F.col("id").alias("dst")), "dst", "left_semi"), start, goal).select(F.concat_ws(">", "path").alias("path"))


def _entries(spark, base) -> DataFrame:
    return R.nodes(spark, base).where(F.col("node_type").isin("endpoint", "batch_job")).select("id")


def slices_forward(spark: SparkSession, base: str) -> DataFrame:
    return graph.slices(R.nodes(spark, base), R.edges(spark, base), _entries(spark, base)).select("entry", "id", "depth")


def slice_stops(spark: SparkSession, base: str) -> DataFrame:
    s = graph.slices(R.nodes(spark, base), R.edges(spark, base), _entries(spark, base))
    return s.where("stop is not null").groupBy("stop", "depth").agg(F.count("*").alias("n"))


def entry_links(spark: SparkSession, base: str) -> DataFrame:
    n = R.nodes(spark, base)
    e = R.edges(spark, base)
    return graph.entry_links(e, n.where("node_type = 'db_model'").select("id"), _entries(spark, base)).select("start", "entry", "hops", F.round("confidence", 6).alias("confidence"))


def primary_walk(spark: SparkSession, base: str) -> DataFrame:
    signal = F.when(F.col("edge_kind") == "framework_binds", 2).when(F.col("edge_kind") == "calls", 1).otherwise(0)
    return graph.dominant_walk(R.edges(spark, base), _entries(spark, base), signal)


def _folders(spark, base) -> DataFrame:
    """Path of every file and folder with that of its parent; the root has none."""
    f = R.nodes(spark, base).select("scan_id", "file_path").distinct()
    parts = f.select("scan_id", F.split("file_path", "/").alias("p"))
    x = parts.select("scan_id", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    at = lambda k: F.concat_ws("/", F.col("scan_id").cast("string"), F.slice("p", 1, k))
    return x.select(at(F.col("k")).alias("id"), F.when(F.col("k") > 1, at(F.col("k") - 1)).alias("parent")).distinct()


def stale_propagation(spark: SparkSession, base: str) -> DataFrame:
    marks = R.nodes(spark, base).where("file_hash is null or trim(file_hash) = ''").select(F.concat_ws("/", F.col("scan_id").cast("string"), "file_path").alias("id"), F.lit("no hash").alias("reason")).distinct()
    return graph.propagate_up(_folders(spark, base), marks)


def scan_origin(spark: SparkSession, base: str) -> DataFrame:
    """The first scan of every chain of predecessors, as an alias chain."""
    from codestrata.operators.manifest_delta import scan_parents
    from codestrata.runtime import table

    chain = scan_parents(table(spark, base, "scan_runs")).where("parent is not null").select(F.col("version").alias("id"), F.col("parent").alias("target"))
    return graph.resolve_aliases(chain)


def name_components(spark: SparkSession, base: str) -> DataFrame:
    """Symbols linked by trusted dispatch and framework edges, as components."""
    n, e = R.nodes(spark, base), R.edges(spark, base)
    links = graph.trusted(e).where("edge_kind in ('dispatches_to', 'framework_binds')").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ids = n.select("id")
    links = links.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return graph.components(links, ids)


_ORIGINS = "o(origin, o_conf, o_kind, o_evidence) AS (VALUES " + ", ".join(f"('{k}', {c}, '{a}', '{b}')" for k, (c, a, b) in O.ORIGINS.items()) + ")"
_WEIGHT = "CASE edge_kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in O.EDGE_WEIGHTS.items()) + " ELSE 0.5 END"
_BASE = f"""WITH RECURSIVE {R.NODES}, {R.EDGES}, {_ORIGINS},
g AS (SELECT e.*, coalesce(o_conf, confidence, 0) AS conf, {_WEIGHT} AS w, coalesce(o_conf, confidence, 0) < 0.75 AS low, evidence_kind = 'dynamic_hint' OR edge_kind = 'dynamic_hint' AS hint
  FROM e LEFT JOIN o USING (origin) WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) AND evidence_kind NOT IN ('co_change', 'coverage', 'runtime')),
t AS (SELECT e.*, coalesce(o_conf, confidence, 0) AS conf FROM e LEFT JOIN o USING (origin) WHERE src IS NOT NULL AND dst IS NOT NULL
  AND CASE WHEN o_conf IS NOT NULL THEN o_conf >= 0.75 AND o_kind IN ('calls', 'dispatches_to', 'framework_binds', 'calls_external') AND o_evidence IN ('static', 'framework', 'scip') ELSE coalesce(confidence, 0) >= 0.75 END),
deg AS (SELECT dst AS id, count(DISTINCT src) AS in_degree FROM g GROUP BY 1),
hub AS (SELECT greatest(coalesce(max(in_degree) FILTER (WHERE k = least(floor(m * 0.99), m - 1) + 1), 0), 25) AS threshold FROM (SELECT in_degree, row_number() OVER (ORDER BY in_degree) AS k, count(*) OVER () AS m FROM deg)),
adm AS (SELECT * FROM g WHERE evidence_kind IN ('static', 'framework', 'dynamic_hint', 'scip')),
seed0 AS (SELECT min(id) AS id FROM n WHERE node_type = 'db_model' GROUP BY scan_id),
l0 AS (SELECT DISTINCT id, 0 AS depth, CAST(1.0 AS DOUBLE) AS s, false AS possible FROM (SELECT id FROM seed0 UNION ALL
  SELECT m.id FROM n m JOIN n c ON m.file_path = c.file_path AND starts_with(m.qn, c.qn || '.') WHERE c.id IN (SELECT id FROM seed0)))"""


def _level(d: int) -> str:
    before = " UNION ALL ".join(f"SELECT id FROM l{k}" for k in range(d))
    walk = f"SELECT f.* FROM l{d - 1} f LEFT JOIN deg USING (id), hub WHERE NOT (f.depth > 0 AND coalesce(in_degree, 0) >= threshold) AND NOT f.possible"
    return f""", l{d} AS (SELECT src AS id, {d} AS depth, sum(s * w * conf) AS s, bool_or(low OR hint) AS possible FROM ({walk}) f JOIN adm ON dst = f.id
      WHERE (NOT low OR f.depth = 0) AND src NOT IN ({before}) GROUP BY src)"""


_LEVELS = _BASE + "".join(map(_level, (1, 2, 3)))
_KIND = r"CASE WHEN regexp_matches(replace(coalesce(file_path, ''), '\', '/'), '(^|/)(tests?|__tests__|spec)(/|$)|(Tests?|_test|\.test|\.spec|Spec)\.[A-Za-z]+$') THEN 'test' WHEN node_type IN ('endpoint', 'batch_job', 'cli_command', 'event_consumer') THEN node_type ELSE 'symbol' END"
_ITEMS = _LEVELS + f""", items AS (SELECT id, qn AS node, {_KIND} AS kind, round(least(1.0, s * pow(0.7, depth - 1)), 4) AS score, depth, CASE WHEN possible THEN 'possible' ELSE 'likely' END AS certainty
  FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) JOIN n USING (id))"""


def _unknowns(d: int) -> str:
    return f"""SELECT CASE WHEN f.depth > 0 AND coalesce(in_degree, 0) >= threshold THEN 'hub_not_expanded' ELSE 'possible_not_expanded' END AS kind, f.id AS where_id, CAST(NULL AS BIGINT) AS to_id
      FROM l{d} f LEFT JOIN deg USING (id), hub WHERE (f.depth > 0 AND coalesce(in_degree, 0) >= threshold) OR (f.possible AND coalesce(in_degree, 0) > 0)
    UNION SELECT 'low_confidence_edge_not_followed', src, dst FROM l{d} f LEFT JOIN deg USING (id), hub, adm
      WHERE dst = f.id AND low AND f.depth > 0 AND NOT f.possible AND coalesce(in_degree, 0) < threshold"""


_ENTRY = "en AS (SELECT id FROM n WHERE node_type IN ('endpoint', 'batch_job'))"


def _slice(d: int) -> str:
    return f""", s{d} AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT entry, dst AS id, {d} AS depth FROM s{d - 1} JOIN tn ON src = s{d - 1}.id) x ANTI JOIN a{d - 1} USING (entry, id)),
    a{d} AS MATERIALIZED (SELECT * FROM a{d - 1} UNION ALL SELECT entry, id FROM s{d})"""


_DEPTHS, _HOPS = range(1, O.FLOW_DEPTH + 1), range(1, graph.HOPS + 1)
_SLICES = _BASE + f", {_ENTRY}, tn AS MATERIALIZED (SELECT DISTINCT src, dst FROM t WHERE dst IN (SELECT id FROM n)), s0 AS (SELECT id AS entry, id, 0 AS depth FROM en), a0 AS (SELECT entry, id FROM s0)" + "".join(map(_slice, _DEPTHS)) + ", sl AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM s{d}" for d in (0, *_DEPTHS)) + ")"


def _back(d: int) -> str:
    return f""", b{d} AS MATERIALIZED (SELECT x.* FROM (SELECT start, src AS id, {d} AS hops, max(least(b.confidence, tc.conf)) AS confidence FROM b{d - 1} b JOIN tc ON dst = b.id
      WHERE b.hops = 0 OR b.id NOT IN (SELECT id FROM en) GROUP BY start, src) x ANTI JOIN c{d - 1} USING (start, id)), c{d} AS MATERIALIZED (SELECT * FROM c{d - 1} UNION ALL SELECT start, id FROM b{d})"""


_LINKS = _BASE + f", {_ENTRY}, tc AS MATERIALIZED (SELECT src, dst, max(conf) AS conf FROM t GROUP BY ALL), b0 AS (SELECT id AS start, id, 0 AS hops, CAST(1.0 AS DOUBLE) AS confidence FROM n WHERE node_type = 'db_model'), c0 AS (SELECT start, id FROM b0)" + "".join(map(_back, _HOPS))
_LINKS += " SELECT start, id AS entry, hops, round(confidence, 6) AS confidence FROM (" + " UNION ALL ".join(f"SELECT * FROM b{d}" for d in (0, *_HOPS)) + ") WHERE id IN (SELECT id FROM en)"
_WALK = _BASE + f""", {_ENTRY}, nx AS (SELECT src, dst AS nxt FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY CASE edge_kind WHEN 'framework_binds' THEN 2 WHEN 'calls' THEN 1 ELSE 0 END DESC, conf DESC, edge_id) AS k FROM t) WHERE k = 1),
wk AS (SELECT id AS start, 0 AS pos, id, [id] AS path FROM en UNION ALL SELECT start, pos + 1, nxt, list_append(path, nxt) FROM wk JOIN nx ON src = wk.id WHERE pos < {graph.WALK - 1} AND NOT list_contains(path, nxt))
SELECT start, pos, id FROM wk"""
_PATHS = _BASE + """, st AS (SELECT min(id) AS id FROM n WHERE node_type = 'endpoint'), go AS (SELECT id FROM n WHERE node_type = 'db_model' ORDER BY id LIMIT 10),
tn AS (SELECT DISTINCT src, dst FROM t WHERE dst IN (SELECT id FROM n)),
pt AS (SELECT id, [id] AS path, 0 AS d FROM st UNION ALL SELECT dst, list_append(path, dst), d + 1 FROM pt JOIN tn ON src = pt.id WHERE d < 4 AND NOT list_contains(path, dst)),
hit AS (SELECT path, d FROM pt WHERE d > 0 AND id IN (SELECT id FROM go))
SELECT array_to_string(path, '>') AS path FROM (SELECT path FROM hit WHERE d = (SELECT min(d) FROM hit) ORDER BY path LIMIT 20)"""
_FOLDERS = f"""WITH RECURSIVE {R.NODES}, f AS (SELECT DISTINCT scan_id, string_split(file_path, '/') AS p FROM n),
up AS (SELECT DISTINCT CAST(scan_id AS VARCHAR) || '/' || array_to_string(p[1:k], '/') AS id, CASE WHEN k > 1 THEN CAST(scan_id AS VARCHAR) || '/' || array_to_string(p[1:k - 1], '/') END AS parent FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM f)),
mk AS (SELECT DISTINCT CAST(scan_id AS VARCHAR) || '/' || file_path AS id FROM n WHERE file_hash IS NULL OR trim(file_hash) = ''),
an AS (SELECT id, 0 AS d FROM mk UNION ALL SELECT parent, d + 1 FROM an JOIN up USING (id) WHERE parent IS NOT NULL)
SELECT id, 'no hash' AS reason, min(d) AS distance FROM an GROUP BY id"""
_COMPONENTS = _BASE + """, li AS (SELECT src AS a, dst AS b FROM t WHERE edge_kind IN ('dispatches_to', 'framework_binds') AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)),
bo AS (SELECT a, b FROM li UNION SELECT b, a FROM li),
re AS (SELECT id, id AS r FROM n UNION SELECT re.id, bo.b FROM re JOIN bo ON re.r = bo.a)
SELECT id, min(r) AS component FROM re GROUP BY id"""
_CHAIN = """WITH RECURSIVE state AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC) AS k FROM scan_runs) WHERE k = 1),
done AS (SELECT * FROM state WHERE status = 'completed'),
p AS (SELECT * FROM (SELECT id, lag(id) OVER (PARTITION BY project_slug, branch ORDER BY started_at) AS target FROM done) WHERE target IS NOT NULL),
w AS (SELECT id, target, 1 AS hops FROM p UNION ALL SELECT w.id, p.target, hops + 1 FROM w JOIN p ON w.target = p.id WHERE hops < 40)
SELECT id, CASE WHEN hops <= 32 THEN target END AS target, CASE WHEN hops <= 32 THEN hops END AS hops FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hops DESC) AS k FROM w) WHERE k = 1"""

QUERIES = {f.__name__: f for f in (impact_reverse, impact_unknowns, impact_top, impact_by_kind, hub_nodes, neighbourhood_2, call_paths, slices_forward, slice_stops, entry_links, primary_walk, stale_propagation, scan_origin, name_components)}
ORACLE = {
    "impact_reverse": _ITEMS + " SELECT * FROM items",
    "impact_unknowns": _LEVELS + " SELECT * FROM (" + " UNION ".join(map(_unknowns, (0, 1, 2))) + ")",
    "impact_top": _ITEMS + " SELECT row_number() OVER (ORDER BY score DESC, depth, node, id) AS rank, id, score, (SELECT count(*) FROM items) AS total, greatest(0, (SELECT count(*) FROM items) - 50) AS omitted FROM items QUALIFY rank <= 50",
    "impact_by_kind": _ITEMS + " SELECT kind, count(*) AS n FROM items GROUP BY kind",
    "hub_nodes": _BASE + " SELECT id, in_degree, threshold FROM deg, hub WHERE in_degree >= threshold",
    "neighbourhood_2": _BASE + """, bo AS (SELECT src AS a, dst AS b FROM e WHERE src IS NOT NULL AND dst IS NOT NULL UNION SELECT dst, src FROM e WHERE src IS NOT NULL AND dst IS NOT NULL),
d0 AS (SELECT min(id) AS id FROM n), d1 AS (SELECT DISTINCT b AS id FROM bo JOIN d0 ON a = id WHERE b NOT IN (SELECT id FROM d0)),
d2 AS (SELECT DISTINCT b AS id FROM bo JOIN d1 ON a = id WHERE b NOT IN (SELECT id FROM d0 UNION SELECT id FROM d1))
SELECT id, 0 AS distance FROM d0 UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2""",
    "call_paths": _PATHS, "slices_forward": _SLICES + " SELECT entry, id, depth FROM sl",
    "slice_stops": _SLICES + """, o2 AS (SELECT src AS id, count(*) AS k FROM tn GROUP BY 1), ch AS (SELECT DISTINCT a.entry, a.id FROM sl a JOIN tn ON tn.src = a.id JOIN sl b ON b.entry = a.entry AND b.id = tn.dst AND b.depth = a.depth + 1),
z AS (SELECT sl.depth, CASE WHEN ch.id IS NOT NULL THEN NULL WHEN node_type = 'external_system' THEN 'external_boundary' WHEN node_type = 'db_model' THEN 'db_boundary' WHEN k IS NULL THEN 'leaf_no_callees' WHEN sl.depth >= 8 THEN 'depth_cap' ELSE 'cycle' END AS stop FROM sl LEFT JOIN o2 USING (id) LEFT JOIN ch ON ch.entry = sl.entry AND ch.id = sl.id LEFT JOIN n ON n.id = sl.id)
SELECT stop, depth, count(*) AS n FROM z WHERE stop IS NOT NULL GROUP BY ALL""",
    "entry_links": _LINKS, "primary_walk": _WALK, "stale_propagation": _FOLDERS, "scan_origin": _CHAIN, "name_components": _COMPONENTS,
}
