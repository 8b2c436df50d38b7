from pyspark.sql import functions as F

from codestrata.operators import graph as G

NODES = "id long, qn string, name string, node_type string, file_path string, line_start int, line_end int"
EDGES = "edge_id long, src long, dst long, origin string, edge_kind string, evidence_kind string, confidence double"


def hand_drawn(spark):
    """table <- a <- b <- c (endpoint); d reaches b by a guess; e and f form a cycle with b; hub has 30 callers; t is a test."""
    names = [(1, "m.a", "method", "src/a.py"), (2, "m.b", "method", "src/b.py"), (3, "m.c", "endpoint", "src/c.py"), (4, "m.d", "method", "src/d.py"), (5, "m.e", "method", "src/e.py"), (6, "m.f", "method", "src/f.py"), (7, "m.hub", "method", "src/h.py"), (8, "m.t", "method", "tests/t.py"), (9, "m.tab", "db_model", "src/tab.py"), (10, "m.cls", "class", "src/k.py"), (11, "m.cls.x", "method", "src/k.py")]
    names += [(100 + i, f"m.u{i}", "method", "src/u.py") for i in range(30)]
    nodes = spark.createDataFrame([(i, q, q.rsplit(".", 1)[-1], t, f, 1, 9) for i, q, t, f in names], NODES)
    e = [(2, 1, "receiver_typed"), (3, 2, "import_exact"), (4, 2, "global_unique"), (5, 2, "same_file"), (6, 5, "same_file"), (2, 6, "same_file"), (7, 1, "same_file"), (8, 1, "same_file"), (4, 1, "global_unique"), (3, 4, "same_file"), (11, 1, "dispatch")]
    rows = [(i, s, d, o, "dispatches_to" if o == "dispatch" else "calls", "static", 0.1) for i, (s, d, o) in enumerate(e)]
    rows += [(50 + i, 100 + i, 7, "same_file", "calls", "static", 0.9) for i in range(30)]
    rows += [(90, 1, 9, "sql_parsed", "writes_table", "static", 0.9), (91, 3, 1, "x", "co_change", "co_change", 1.0), (92, None, 1, "same_file", "calls", "static", 1.0), (93, 3, None, "same_file", "calls", "static", 1.0)]
    return nodes, spark.createDataFrame(rows, EDGES)


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_impact(spark):
    nodes, edges = hand_drawn(spark)
    reached, unknowns = G.impact_levels(nodes, edges, seeds(spark, 1), 3)
    items = {r.node: r for r in G.impact_items(nodes, reached).collect()}
    assert items["m.b"].score == round(0.8 * 0.93, 4) and items["m.b"].depth == 1 and items["m.b"].certainty == "likely"
    assert items["m.d"].certainty == "possible" and items["m.t"].kind == "test" and items["m.c"].kind == "endpoint" and items["m.c"].depth == 2
    assert "m.u0" not in items and "m.a" not in items
    u = {(r.kind, r.where_id) for r in unknowns.collect()}
    assert ("hub_not_expanded", 7) in u and ("possible_not_expanded", 4) in u and ("low_confidence_edge_not_followed", 4) in u
    tables = G.written_tables(nodes, edges, reached).collect()
    assert [(t.node, t.score, t.depth) for t in tables] == [("m.tab", 0.9, 1)]


def test_class_seeds_bring_their_members(spark):
    nodes, _ = hand_drawn(spark)
    assert sorted(r.id for r in G.expand_seeds(nodes, seeds(spark, 10)).collect()) == [10, 11]


def test_cap_tells_what_it_leaves_out(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "id long, s int")
    got = G.cap(df, 4, F.desc("s"), F.asc("id")).collect()
    assert [(r.id, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(2, 1), (5, 2), (8, 3), (1, 4)] and {(r.total, r.omitted) for r in got} == {(10, 6)}


def test_shortest_paths(spark):
    nodes, edges = hand_drawn(spark)
    t = G.trusted(edges)
    assert [r.path for r in G.shortest_paths(t, seeds(spark, 3), seeds(spark, 1)).collect()] == [[3, 2, 1]]
    assert G.shortest_paths(t, seeds(spark, 9), seeds(spark, 1)).count() == 0


def test_slices_and_stops(spark):
    nodes, edges = hand_drawn(spark)
    s = {(r.id): (r.depth, r.stop) for r in G.slices(nodes, edges, seeds(spark, 3)).collect()}
    assert s[3] == (0, None) and s[2][0] == 1 and s[1] == (2, "leaf_no_callees") and s[4][0] == 1


def test_aliases_components_and_staleness(spark):
    a = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)] + [(100 + i, 101 + i) for i in range(40)], "id long, target long")
    got = {r.id: (r.target, r.hops) for r in G.resolve_aliases(a).collect()}
    assert got[1] == (3, 2) and got[5] == (None, None) and got[100] == (None, None) and got[139] == (140, 1) and got[120] == (140, 20)
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(70, 71), (71, 70), (80, 80)], "a long, b long")
    comp = {r.id: r.component for r in G.components(links, spark.range(90).select("id")).collect()}
    assert all(comp[i] == 0 for i in range(61)) and comp[71] == 70 and comp[80] == 80 and comp[65] == 65
    p = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (3, None)], "id long, parent long")
    m = spark.createDataFrame([(1, "b"), (1, "a"), (4, "z")], "id long, reason string")
    assert sorted(map(tuple, G.propagate_up(p, m).collect())) == [(1, "a", 0), (2, "a", 1), (3, "z", 1), (4, "z", 0)]


def test_empty_graph(spark):
    nodes, edges = hand_drawn(spark)
    none = nodes.limit(0)
    reached, unknowns = G.impact_levels(none, edges.limit(0), none.select("id"))
    assert reached.count() == 0 and unknowns.count() == 0
    assert G.components(spark.createDataFrame([], "a long, b long"), none.select("id")).count() == 0
