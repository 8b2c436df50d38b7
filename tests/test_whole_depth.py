"""The traversals registered at their full depth, against walks by hand."""

import pytest

import __spark_entry__ as entry

CODE = "id long, scan_id long, qualified_name string, name string, node_type string, file_path string, language string, line_start int, line_end int, domain string, annotations string, params string, return_type string, file_hash string"
CALLS = "id long, scan_id long, caller_id long, callee_id long, callee_name string, edge_type string, resolved_by string, edge_kind string, evidence_kind string, confidence double"
# 0 is an entry and begins a chain of 20; 8 also goes to 3, 2 also to 30 that ends there, 15 is a table.
LINKS = {i: [i + 1] for i in range(20)}
LINKS[8] = [9, 3]
LINKS[2] = [3, 30]
number = lambda a, b: 100 * a + b + (50 if b < a else 0)


@pytest.fixture(scope="module")
def chain(spark, small, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("chain"))
    kind = lambda i: "endpoint" if i in (0, 9) else "db_model" if i == 15 else "method"
    nodes = [(i, 1, f"m.n{i}", f"n{i}", kind(i), f"src/{i}.py", "python", 1, 9, None, None, None, None, "h") for i in (*range(21), 30)]
    edges = [(number(a, b), 1, a, b, f"n{b}", "call", "same_file", "calls", "static", 0.9) for a, to in LINKS.items() for b in to]
    spark.createDataFrame(nodes, CODE).write.parquet(f"{base}/code_nodes.parquet")
    spark.createDataFrame(edges, CALLS).write.parquet(f"{base}/call_edges.parquet")
    spark.createDataFrame([(1,)], "scan_id long").write.parquet(f"{base}/current_scan.parquet")
    spark.read.parquet(f"{small}/unresolved_calls.parquet").limit(0).write.parquet(f"{base}/unresolved_calls.parquet")
    return base


def forward(start, most):
    depth, level = {start: 0}, [start]
    for d in range(1, most + 1):
        level = sorted({b for a in level for b in LINKS.get(a, []) if b not in depth})
        depth |= dict.fromkeys(level, d)
    return depth


def test_slices(spark, chain):
    got = {(r.entry, r.id, r.depth) for r in entry.queries()["slices_forward"](spark, chain).collect()}
    assert got == {(e, i, d) for e in (0, 9) for i, d in forward(e, 8).items()} and (0, 8, 8) in got
    stops = {(r.stop, r.depth): r.n for r in entry.queries()["slice_stops"](spark, chain).collect()}
    assert stops == {("leaf_no_callees", 3): 1, ("depth_cap", 8): 2}


def test_entry_links(spark, chain):
    assert [(r.start, r.entry, r.hops) for r in entry.queries()["entry_links"](spark, chain).collect()] == [(15, 9, 6)]


def test_walks(spark, chain):
    got = sorted((r.start, r.pos, r.id) for r in entry.queries()["primary_walk"](spark, chain).collect())
    assert got == [(0, i, i) for i in range(15)] + [(9, i, 9 + i) for i in range(12)]
    # Six steps lie between the endpoint 9 and the table 15: a shorter walk would not hold both.
    pairs = [r.asDict() for r in entry.queries()["sequence_mining"](spark, chain).collect()]
    assert any({"endpoint", "db_model"} <= set(p.values()) for p in pairs)


def test_flow_pages(spark, chain):
    got = {r.page_id: (r.steps, r.depth) for r in entry.queries()["flow_facts"](spark, chain).collect()}
    assert got == {f"flow:1/m.n{e}": (len(forward(e, 8)), 8) for e in (0, 9)}
