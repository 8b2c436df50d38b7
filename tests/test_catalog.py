"""Hierarchies and catalogues on small fixtures, nulls, ties and empty tables included."""

from pyspark.sql import functions as F

from codestrata.operators import catalog as C
from codestrata.operators import hierarchy as H

EDGE = "edge_id long, src long, dst long, callee_name string, origin string, edge_kind string, evidence_kind string, confidence double"


def test_paths_back(spark):
    r = spark.createDataFrame([(1, 0, None), (2, 1, 1), (3, 2, 2), (4, 3, 3)], "id long, depth int, parent long")
    assert {x.id: x.path for x in H.best_paths(r).collect()} == {2: [2, 1], 3: [3, 2, 1], 4: [4, 3, 2, 1]}
    assert H.best_paths(r.limit(0)).count() == 0


def test_ascend_ends_in_cycles(spark):
    p = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None), (5, 5)], "id long, parent long")
    assert {(x.id, x.ancestor, x.level) for x in H.ascend(p).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (2, 1, 2), (3, 1, 1), (3, 2, 2)}


def test_names_of_pages(spark):
    a = spark.createDataFrame([("x", "y"), ("y", "z"), ("q", "q")], "id string, target string")
    assert sorted(r.alias for r in H.aliases_of(a, spark.createDataFrame([("z",)], "id string")).collect()) == ["x", "y", "z"]


def test_common_root(spark):
    root = lambda *p: H.common_root(spark.createDataFrame([(x,) for x in p], "p string"), "p").first().root
    assert root("a/b/x", "a/b/c/y", None) == "a/b" and root("a/b", "c/d") == "" and root("a/x.py") == "a" and root(None) == "" and root("ab/x", "abc/y") == ""


def test_flow_cap_and_tours(spark):
    s = spark.createDataFrame([(1, i, 1, "leaf_no_callees") for i in range(60)] + [(1, 99, 0, None), (2, 5, 1, "cycle")], "entry long, id long, depth int, stop string")
    got = {(r.entry, r.stop): r["count"] for r in H.cap_flows(s).groupBy("entry", "stop").count().collect()}
    assert got == {(1, "leaf_no_callees"): 50, (1, "flow_cap"): 10, (1, None): 1, (2, "cycle"): 1}
    nodes = spark.createDataFrame([(i, 1, "d" if i != 4 else "other", f"q{i}", "endpoint" if i == 1 else "function") for i in range(1, 7)] + [(9, 1, None, "n", "endpoint")], "id long, scan_id long, domain string, qn string, node_type string")
    edges = spark.createDataFrame([(1, 1, 2, "", "import_module", "calls", "static", 0.8), (2, 1, 3, "", "scip", "calls", "scip", 1.0), (3, 1, 4, "", "scip", "calls", "scip", 1.0), (4, 3, 5, "", "scip", "calls", "scip", 1.0), (5, 5, 1, "", "scip", "calls", "scip", 1.0), (6, 1, 6, "", "global_unique", "calls", "static", 0.5), (7, None, 2, "", "scip", "calls", "scip", 1.0)], EDGE)
    assert [(r.step, r.id) for r in H.tours(nodes, edges).orderBy("step").collect()] == [(1, 1), (2, 3), (3, 2), (4, 5)]
    assert H.tours(nodes, edges, 2).count() == 2 and H.tours(nodes.limit(0), edges).count() == 0


def test_registered_entries(spark):
    found = spark.createDataFrame([(1, "route", "handle"), (1, "hosted", "Worker"), (1, "route", "none")], "scan_id long, kind string, name string")
    classes = spark.createDataFrame([(1, "Worker", "a.Worker")], "scan_id long, name string, qn string")
    methods = spark.createDataFrame([(1, "handle", "a.handle", 7), (1, "ExecuteAsync", "a.Worker.ExecuteAsync", 8), (2, "handle", "b.handle", 9)], "scan_id long, name string, qn string, id long")
    assert {(r.kind, r.id) for r in H.entry_edges(found, classes, methods, {"hosted": ["ExecuteAsync", "StartAsync"]}).collect()} == {("route", 7), ("hosted", 8)}


def test_relative(spark):
    p = spark.createDataFrame([("/r/a/b",), ("/rx/a",), (None,)], "p string")
    assert [r.p for r in p.select(H.relative(F.col("p"), "/r/").alias("p")).collect()] == ["a/b", "/rx/a", None]


def test_subsets(spark):
    rows = [(1, 10, ["a"]), (1, 11, ["a", "a"]), (1, 12, ["z"]), (1, 13, []), (2, 14, ["a"]), (1, 15, None)]
    small = spark.createDataFrame(rows, "blk long, a long, states array<string>")
    large = spark.createDataFrame([(1, 20, ["b", "a"]), (1, 21, ["a", "b"]), (1, 22, ["b"])], "blk long, b long, states array<string>")
    assert [tuple(r) for r in C.contained_in(small, large, ["blk"]).collect()] == [(10, 20, 2, 2)]


def test_precision_and_scores(spark):
    graded = spark.createDataFrame([(1, "f", "s", 2, True), (1, "g", "s", 3, False), (1, "h", "t", 4, True), (1, "i", "u", 5, False), (1, "j", "u", 6, True)], "src long, name string, stratum string, dst long, ok boolean")
    now = spark.createDataFrame([(1, "f", 2), (1, "g", 3), (1, "i", 5), (1, "j", 6), (1, "j", 6)], "src long, name string, dst long")
    got = {r.stratum: (r.n, r.matched, r.correct, r.precision, r.drifted) for r in C.precision_check(graded, now, spark.createDataFrame([("u", 0.6)], "stratum string, lower double")).collect()}
    assert got == {"s": (2, 2, 1, 0.5, False), "t": (1, 0, 0, None, True), "u": (2, 2, 1, 0.5, True)}
    bad = spark.createDataFrame([("B.x", "y"), ("Q.x", "y")], "caller_suffix string, callee_suffix string")
    edges = spark.createDataFrame([("a.B.x", "c.y"), ("a.QB.x", "c.y")], "caller string, callee string")
    assert tuple(C.forbidden_edges(edges, bad).first()) == (2, 1, 0.5) and C.forbidden_edges(edges, bad.limit(0)).first().score == 1.0
    f = C.file_scores(spark.createDataFrame([("t", "a"), ("t", "b")], "task string, file string"), spark.createDataFrame([("t", "a"), ("u", "c")], "task string, file string"))
    assert {r.task: (r.precision, r.recall) for r in f.collect()} == {"t": (0.5, 1.0), "u": (0.0, 0.0)}


def test_touches_and_names(spark):
    nodes = spark.createDataFrame([(1, "f", "function"), (2, "T", "db_model"), (3, "U", "db_model"), (4, "X", "external_system")], "id long, qn string, node_type string")
    edges = spark.createDataFrame([(1, 1, 2, "", "", "writes_table", "static", 1.0), (2, 1, 2, "", "", "reads_table", "static", 1.0), (3, 1, 3, "", "", "calls", "static", 1.0), (4, 1, 4, "", "", "calls_external", "static", 1.0), (5, 1, None, "", "", "calls", "static", 1.0)], EDGE)
    t = C.touches(spark.createDataFrame([(9, 1)], "entry long, id long"), edges, nodes).first()
    assert (t.reads, t.writes, t.external) == (["U"], ["T"], ["X"])
    m = spark.createDataFrame([("a.B", "B"), ("c.B", "B"), ("D", "D"), ("E", "B")], "entity string, name string")
    assert {r.entity: r.display for r in C.display_names(m).collect()} == {"a.B": "B (a)", "c.B": "B (c)", "D": "D", "E": "B"}


def test_notes_follow_their_anchor(spark):
    notes = spark.createDataFrame([(1, "old", "x"), (2, "new", "y"), (3, "else", "z"), (4, None, "w")], "note long, anchor string, text string")
    aliases = spark.createDataFrame([("old", "mid"), ("mid", "new")], "id string, target string")
    assert sorted((r.note, r.anchor) for r in C.anchored(notes, aliases, spark.createDataFrame([("new",)], "anchor string")).collect()) == [(1, "new"), (2, "new")]


def test_interfaces(spark):
    nodes = spark.createDataFrame([("s", "getUser", "/u/{id}", "h"), ("s", "x", None, "g")], "slug string, name string, route string, qn string")
    sites = spark.createDataFrame([("t", "c", "post", "https://s/u/12?x=1"), ("t", "c", "get", "not a path")], "slug string, caller string, name string, target string")
    a, b = C.interfaces(nodes, sites)
    assert [(r.method, r.route) for r in a.collect()] == [("GET", "/u/{}")] and [(r.method, r.route) for r in b.collect()] == [("POST", "/u/{}")]
