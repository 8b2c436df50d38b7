"""Answers, sinks, stages and locks on small fixtures."""

import os

import pytest

from codestrata.operators import snapshots as S
from codestrata.plans import answers as A
from codestrata.plans import pages as P
from codestrata.sources import sinks as K

NODE = "id long, scan_id long, qn string, name string, node_type string, file_path string, language string, line_start int, line_end int, domain string, annotations string, params string, return_type string, file_hash string"


@pytest.fixture(scope="module")
def ctx(spark):
    n = lambda i, q, t, **k: (i, 1, q, q.split(".")[-1], t, f"src/{q}.py", "python", 1, 9, k.get("domain"), k.get("annotations"), None, None, None)
    nodes = spark.createDataFrame([n(1, "a.Page", "ui_component"), n(2, "a.get", "endpoint"), n(3, "a.Orders", "db_model", domain="d"), n(4, "b.Orders", "class"), n(5, "a.job", "batch_job", annotations='["Cron(0 * * * *)"]'), n(6, "x.sp_fill", "stored_proc")], NODE)
    edges = spark.createDataFrame([(1, 1, 1, 2, "a.get", "direct", "same_file", "calls", "static", 1.0), (2, 1, 2, 3, "a.Orders", "direct", "sql_parsed", "writes_table", "static", 0.9), (3, 1, 1, 3, "a.Orders", "direct", "sql_parsed", "reads_table", "static", 0.9), (4, 1, 2, None, "sp_fill", "direct", "proc_call", "calls_proc", "static", 0.9), (5, 1, 6, 3, "a.Orders", "direct", "sql_parsed", "writes_table", "static", 0.9)],
                                  "edge_id long, scan_id long, src long, dst long, callee_name string, edge_type string, origin string, edge_kind string, evidence_kind string, confidence double")
    u = spark.createDataFrame([], "id long, scan_id long, caller_id long, callee_name string, reason string")
    moves = spark.createDataFrame([("a.Orders", "new", "paid"), ("a.Orders", "new", "paid")], "entity string, from_state string, to_state string")
    seq = spark.createDataFrame([("Orders", "Bills", 3, 1.0)], "before string, after string, support long, confidence double")
    return P.Context(nodes, edges, u, {"moves": moves, "keys": spark.createDataFrame([("bills", "orders")], "from_table string, to_table string"), "sequences": seq})


def test_answers(ctx):
    page = A.call("screen", ctx, key="Page").data["page"]
    assert page["calls"] == 2 and page["entries"] == 1 and page["tables"] == ["a.Orders"] and page["links"] == ["table:1/a.Orders"]
    assert A.call("screen", ctx, key="nothing").status == A.MISSING
    assert A.call("entity", ctx, key="orders").status == A.AMBIGUOUS
    e = A.call("entity", ctx, key="entity:1/a.Orders")
    assert e.data["moves"] == [{"from_state": "new", "to_state": "paid", "n": 2}] and e.data["page"]["writers"] == 2
    t = A.call("table", ctx, key="orders")
    assert {(u["qn"], u["edge_kind"]) for u in t.data["users"]} == {("a.get", "writes_table"), ("a.Page", "reads_table"), ("x.sp_fill", "writes_table")} and t.totals["keys"] == 1
    assert A.call("table", ctx, key="none").status == A.MISSING
    f = A.call("flow", ctx, key="a.Page")
    assert [s["qn"] for s in f.data["steps"]] == ["a.Page", "a.get"] and f.data["touches"][0]["writes"] == ["a.Orders"]
    assert A.call("entity_impact", ctx, key="bills").totals["sequences"] == 1 and A.call("entity_impact", ctx, key="x").status == A.MISSING


def test_pages(ctx, spark):
    p = P.run_builders(ctx, ["batch_jobs", "stored_procs", "endpoints"]).cache()
    facts = {r.page_id: r.facts for r in p.collect()}
    assert '"schedule":"0 * * * *"' in facts["batch_job:1/a.job"] and '"callers":1,"defined":true,"tables":["a.Orders"]' in facts["stored_proc:1/sp_fill"] and "endpoint:1/a.get" in facts
    assert [r.page_id for r in A.list_pages(p, prefix="e").collect()] == ["endpoint:1/a.get"] and A.list_pages(p, offset=1, limit=1).first().page_id == "endpoint:1/a.get"
    assert A.list_pages(p, kind="table").count() == 0


def test_annotations_and_meta(ctx, spark):
    a = spark.createDataFrame([(1, "a.get", "note", "proposed"), (2, "gone", "note", "accepted")], "id long, target string, kind string, status string")
    assert [(r.id, r.orphaned) for r in A.list_annotations(a, ctx.nodes).collect()] == [(2, True), (1, False)] and A.list_annotations(a, ctx.nodes, status="proposed").count() == 1
    built = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file string, hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "file string, hash string")
    m = A.answer_meta(spark.createDataFrame([("a",), ("b",), ("b",)], "file string"), built, now, spark.createDataFrame([("parse", "lossy", 2)], "stage string, kind string, count long"))
    assert m == {"files": 2, "changed": 1, "fresh": False, "changed_files": ["b"], "degraded": ["parse: lossy (2)"]}


def test_sinks(ctx, spark, tmp_path):
    K.export_html(P.run_builders(ctx, ["screens"]), str(tmp_path / "h"), "<t>")
    text = (tmp_path / "h" / "screen" / "1" / "a.Page.html").read_text()
    assert '<a href="../../table/1/a.Orders.html">' in text and "screen: 1" in (tmp_path / "h" / "index.html").read_text()
    m = spark.createDataFrame([("b", ["y", "x", "x"]), ("a", [])], "entity string, states array<string>")
    K.export_federation({"m": m}, str(tmp_path / "f"), {"m": ["entity"]})
    K.export_machines(m, str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ['{"entity":"a","states":[]}', '{"entity":"b","states":["x","y"]}']
    log = str(tmp_path / "l.jsonl")
    for k in range(40):
        K.record_call(log, {"k": k}, 100, 2)
    assert os.path.exists(log + ".2") and not os.path.exists(log + ".3") and os.path.getsize(log) <= 110
    c = "path string, parser_version string, encoding string, content_hash string, payload string"
    got = K.merge_parses(spark.createDataFrame([("a", "1", "utf-8", "x", "old"), ("b", "1", "utf-8", "y", "kept")], c), spark.createDataFrame([("a", "1", "utf-8", "z", "new")], c))
    assert {r.path: r.payload for r in got.collect()} == {"a": "new", "b": "kept"}
    s = K.by_symbol(spark.createDataFrame([("a.get", "s1"), ("a.get", "s2"), ("none", "s")], "qn string, summary string"), ctx.nodes, 1)
    assert [(r.node_id, r.summary) for r in s.collect()] == [(2, "s1")]
    ph = K.phase_state(spark.createDataFrame([(1, 1.0, "started", 1), (1, 1.0, "complete", 2), (1, 2.0, "started", 3)], "scan_id long, phase double, status string, at long"))
    assert {(r.phase, r.status) for r in ph.collect()} == {(1.0, "complete"), (2.0, "started")}
    q = K.cost_rows(spark.createDataFrame([(1, 2.0, 1.0, 4.0, "yes"), (2, 1.0, 0.5, 2.0, "no")], "scan_id long, quoted double, low double, high double, decision string"), spark.createDataFrame([(1, 0.5), (1, 1.0)], "scan_id long, usd double"))
    assert {r.scan_id: (r.actual, r.within) for r in q.collect()} == {1: (1.5, True), 2: (None, None)}


def test_stages_locks_and_caches(spark, tmp_path):
    log, done = {}, []
    record = lambda n, s, f: log.__setitem__(n, (s, f))
    stages = [("a", "1", {}, lambda: done.append("a")), ("b", "1", {}, lambda: done.append("b"))]
    assert S.run_stages(stages, "c", log, record) == {"a": "run", "b": "run"} and S.run_stages(stages, "c", dict(log), record) == {"a": "reuse", "b": "reuse"}
    stages[0] = ("a", "2", {}, lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        S.run_stages(stages, "c", dict(log), record)
    assert log["a"][0] == "error" and done == ["a", "b"]
    path = str(tmp_path / "lock")
    with S.RunLock(path):
        with pytest.raises(RuntimeError), S.RunLock(path):
            pass
    open(path, "w").write("999999999")
    with S.RunLock(path):
        pass
    assert not os.path.exists(path)
    hit, miss = S.cached_answers(spark.createDataFrame([("x",), ("y",)], "key string"), spark.createDataFrame([("x", 1, "old"), ("x", 2, "new")], "key string, at long, answer string"))
    assert [(r.key, r.answer) for r in hit.collect()] == [("x", "new")] and [r.key for r in miss.collect()] == ["y"]
    f = "path string, mtime long, size long"
    w = S.watch_changes(spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], f), spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], f))
    assert {(r.path, r.change) for r in w.collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}
