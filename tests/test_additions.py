"""SQL functions, embedders, flattening, handlers and other small operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata import runtime
from codestrata.functions import sql
from codestrata.operators import entities, graph, rollups, snapshots, vectors
from codestrata.operators import text as T
from codestrata.plans import relations as R
from codestrata.sources import files, parsers, projects


def test_sql_functions(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    r = spark.sql("SELECT last_part('a.b.C') AS a, owner_of('a.b.C') AS b, folder_of('x/y.z') AS c, extension_of('x/y.JS') AS d, snake('orderItem') AS e, slug(' Ä b--c ') AS f, normal_hash('  ') AS g, route_of('/A/{id}/:x?q=1') AS h, tokens_in('12345678') AS i, overlap(array('a','b'), array('b','c')) AS j, clamp(5.0, 0.0, 1.0) AS k, tokens_in(NULL) AS l").first()
    assert tuple(r)[:9] == ("C", "a.b", "x", "js", "order_item", "ä-b-c", None, "/a/*/*", 2) and round(r.j, 6) == 0.333333 and r.k == 1.0 and r.l == 0
    low, high = rollups.wilson(F.col("k"), F.col("n"))
    w = spark.createDataFrame([(8, 10), (0, 0), (3, 3)], "k long, n long").select("k", "n", low.alias("a"), high.alias("b"))
    w.createOrReplaceTempView("w_")
    assert spark.sql("SELECT * FROM w_ WHERE abs(a - wilson_low(k, n)) > 1e-9 OR abs(b - wilson_high(k, n)) > 1e-9").count() == 0


def test_embedders(spark):
    df = spark.createDataFrame([(1, "order total", 0), (2, "total order", 0), (3, None, 0), (4, "", 0)], "id long, t string, vector int")
    v = {r.id: r.vector for r in vectors.embed(df, "id", "t", vectors.hashed_words, 64).collect()}
    assert v[1] == v[2] and len(v[1]) == 64 and abs(np.linalg.norm(v[1]) - 1) < 1e-6 and v[3] is None and v[4] == [0.0] * 64
    with pytest.raises(Exception, match="vectors"):
        vectors.embed(df.coalesce(1), "id", "t", lambda ts: np.zeros((1, 2)), 2).collect()
    assert vectors.embed(df.limit(0), "id", "t", vectors.hashed_words, 64).count() == 0


def test_queries_in_blocks_by_hash(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(40)], "id long, v array<float>")
    whole = sorted(map(tuple, vectors.knn(rows, rows.where("id % 5 = 0"), "id", "v", 3).collect()))
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 3)
    assert sorted(map(tuple, vectors.knn(rows, rows.where("id % 5 = 0"), "id", "v", 3).collect())) == whole and len(whole) == 24


def test_facts_as_text(spark):
    df = spark.createDataFrame([('{"a": "x \\"y\\"", "b": [1, {"c": "z"}], "d": 2.5, "e": null}',), (None,), ("{",)], "f string")
    assert [r[0] for r in df.select(T.facts_text(F.col("f"))).collect()] == ['x "y" 1 z 2.5', "", ""]


def test_words_without_marks(spark):
    df = spark.createDataFrame([("Crème état ŁÓDŹ İx",), (None,)], "t string")
    assert [r[0] for r in df.select(T.tokens(F.col("t"))).collect()] == [["creme", "etat", "łodz", "ix"], []]


def test_ends_of_flows_and_unresolved(spark):
    s = spark.createDataFrame([(1, 2, 1, "leaf_no_callees"), (1, 3, 1, "leaf_no_callees"), (1, 4, 1, "cycle"), (1, 5, 1, "leaf_no_callees"), (1, 1, 0, None), (1, 6, 1, "leaf_no_callees")], "entry long, id long, depth int, stop string")
    u = spark.createDataFrame([(2, "a.f", "not_found"), (2, "a.f", "dynamic"), (3, "g", "ambiguous"), (4, "h", "dynamic"), (None, "x.run", "ambiguous"), (6, "z", "external"), (9, "y.run", "builtin")], "caller_id long, callee_name string, reason string")
    assert {r.id: r.stop for r in graph.leaf_reasons(s, u).collect()} == {2: "dynamic_dispatch", 3: "unresolved_call", 4: "cycle", 5: "leaf_no_callees", 1: None, 6: "external_boundary"}
    nodes = spark.createDataFrame([(1, "run"), (2, "g"), (3, "other")], "id long, name string")
    reached = spark.createDataFrame([(1,), (2,)], "id long")
    got = {(r.caller_id, r.callee_name, r.reason) for r in graph.unresolved_unknowns(nodes, u, reached).collect()}
    assert got == {(3, "g", "ambiguous"), (None, "x.run", "ambiguous")}


def test_merged_machines_and_verdicts(spark):
    m = spark.createDataFrame([("order", "a", "Order", ["x", "y"], 0.9), ("order", "b", "Orders", ["x", "y"], 0.7), ("order", "c", "Other", ["q"], 0.5), ("order", "a", "Order2", ["y", "x"], 0.8), ("e", "a", "E", [], 1.0)], "stem string, repo string, entity string, states array<string>, confidence double")
    got = {(r.stem, tuple(r.states)): (r.confidence, r.origins) for r in entities.merge_federated(m, entities.federated(m)).collect()}
    assert got == {("order", ("x", "y")): (0.7, {"a": "Order", "b": "Orders"}), ("order", ("q",)): (0.5, {"c": "Other"}), ("e", ()): (1.0, {"a": "E"})}
    v = rollups.verdicts(spark.createDataFrame([(1, "verified"), (1, "contradicted"), (2, "unverified"), (2, None)], "doc long, verdict string"), ["doc"])
    assert {r.doc: (r.verified, r.unverified, r.contradicted, r.share) for r in v.collect()} == {1: (1, 0, 1, 0.5), 2: (0, 1, 0, 1.0)}


def test_stores_and_artifacts(spark, tmp_path):
    s = spark.createDataFrame([(1, "p", "c1"), (2, "p", "c2"), (3, "p", "c2"), (4, "q", None)], "id long, project_slug string, commit_sha string")
    e = spark.createDataFrame([(1,), (2,), (2,), (4,)], "scan_id long")
    assert {tuple(r) for r in snapshots.newest_indexed(s, e).collect()} == {("p", 2), ("q", 4)} and [tuple(r) for r in snapshots.newest_indexed(s, e, "c1").collect()] == [("p", 1)]
    n = R.rehydrated(spark.createDataFrame([('["a"]', "no json", None)], "annotations string, params string, framework_hints string")).first()
    assert (n.annotations, n.params, n.framework_hints) == (["a"], [], {})
    for repo in ("one", "two"):
        (tmp_path / repo).mkdir()
        (tmp_path / repo / "machines.json").write_text('{"entity": "E", "states": ["x"]}\nnot json\n')
    a = files.artifacts(spark, [str(tmp_path / r) for r in ("one", "two")], "entity string, states array<string>").where("entity is not null")
    assert sorted((r.repo, r.entity) for r in a.collect()) == [("one", "E"), ("two", "E")]


def test_handlers(spark):
    java = '@Controller @RequestMapping("/shop")\npublic class A {\n@GetMapping("/list") public String list() { return "shop/list"; }\n@PostMapping("save")\npublic ModelAndView save() { return new ModelAndView("done"); }\n@GetMapping("/x") public String x() { return y; } }'
    got = projects.page_handlers(spark.createDataFrame([("p", "A.java", java), ("p", "B.java", None)], "project string, path string, text string"))
    assert sorted((r.route, r.handler, r.view) for r in got.collect()) == [("/shop/list", "list", "shop/list"), ("/shop/save", "save", "done")]
    rows = parsers.javascript("src/a.js", "app.get('/users/:id', show);\nrouter.post(`/x`, (a) => { b(); });\nconfig.get('/no');")
    assert [r[1] for r in rows if r[2] == "endpoint"] == ["GET /users/:id", "POST /x"]


def test_spread_and_retry(spark):
    one = spark.range(100).coalesce(1)
    assert runtime.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    grouped = spark.range(10).groupBy("id").count()
    assert runtime.spread(grouped) is grouped
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert runtime.retry(flaky, first_wait=0.0) == "ok" and len(calls) == 3
    with pytest.raises(ConnectionError):
        runtime.retry(lambda: (_ for _ in ()).throw(ConnectionError()), 2, 0.0)
    assert runtime.small_side(spark.range(5), 10).count() == 5
