import random
from datetime import datetime, timedelta

import pytest

from codestrata.operators import manifest_delta as M
from codestrata.sources.versioned import VersionedTable, process_new

T0 = datetime(2024, 1, 1)
RUNS = "id long, project_slug string, branch string, started_at timestamp, status string, recorded_at timestamp"
NODES = "id long, scan_id long, file_path string, qualified_name string, file_hash string, version_ string"
CHUNKS = "chunk_id long, scan_id long, file_path string, qualified_name string, chunk_hash string, chunk_index int"


def brute(runs, nodes, chunks):
    state = {}
    for r in runs:
        if r[0] not in state or r[5] > state[r[0]][5]:
            state[r[0]] = r
    done = [r for r in state.values() if r[4] == "completed"]
    norm = lambda h: (h or "").strip().lower() or None
    recs = {("node", n[0], n[1], n[2], n[3], norm(n[4]), None) for n in nodes} | {("chunk", c[0], c[1], c[2], c[3], norm(c[4]), c[5]) for c in chunks}
    out = set()
    for d in done:
        earlier = [e for e in done if e[1] == d[1] and e[2] == d[2] and e[3] < d[3]]
        parent = max(earlier, key=lambda e: (e[3], e[0]))[0] if earlier else None
        had = {(r[0], *r[3:]) for r in recs if r[2] == parent}
        out |= {(r[0], r[1]) for r in recs if r[2] == d[0] and (parent is None or r[5] is None or (r[0], *r[3:]) not in had)}
    return sorted(out)


def test_scan_delta_against_brute_force(spark):
    rng = random.Random(3)
    runs, nodes, chunks = [], [], []
    for i in range(1, 25):
        start = T0 + timedelta(hours=rng.randint(0, 12))  # ties are wanted
        for k in range(rng.randint(1, 3)):
            runs.append((i, rng.choice(["p", "q"]) if k == 0 else runs[-1][1], rng.choice(["main", None]) if k == 0 else runs[-1][2], start, rng.choice(["completed", "completed", "failed", "running"]), start + timedelta(minutes=k)))
        for f in range(4):
            for q in range(rng.randint(1, 3)):
                row = (len(nodes) * 10 + 1, i, f"f{f}", f"q{q}", rng.choice(["a", "A ", " a", "b", None, "  "]), "x")
                nodes += [row] * rng.randint(1, 2)
                chunks.append((len(chunks) + 1, i, f"f{f}", f"q{q}", rng.choice(["a", "b", "B", None]), rng.randint(0, 1)))
    got = M.scan_delta(spark.createDataFrame(nodes, NODES), spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(runs, RUNS))
    assert sorted((r.rec_kind, r.rec_id) for r in got.collect()) == brute(runs, nodes, chunks)


def test_scan_delta_of_empty_tables(spark):
    e = M.scan_delta(spark.createDataFrame([], NODES), spark.createDataFrame([], CHUNKS), spark.createDataFrame([], RUNS))
    assert e.count() == 0


def test_record_delta_keeps_clashing_columns_and_nulls(spark):
    rows = [(1, "f", "a", "keep"), (2, "f", "a", "keep"), (2, "f", "b", None), (2, None, "c", "n"), (2, None, "c", "n")]
    df = spark.createDataFrame(rows, "version long, file string, k string, parent_ string").withColumnRenamed("version", "v")
    parents = spark.createDataFrame([(1, None), (2, 1)], "version long, parent long")
    got = sorted((r.v, r.file or "", r.k, r.parent_ or "") for r in M.record_delta(df, parents, "v", "file", ["k"]).collect())
    assert got == [(1, "f", "a", "keep"), (2, "", "c", "n"), (2, "", "c", "n"), (2, "f", "b", "")]


def test_changes_of_a_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None and t.version().number == 0
    t.append(spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string"))
    t.append(spark.createDataFrame([(3, "c")], "id long, x string"))
    t.delete("id = 2")
    t.replace("id = 3", spark.createDataFrame([(3, "C")], "id long, x string"))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (3, "C")]
    assert sorted((r.id, r.x, r._change) for r in t.changes(2).collect()) == [(2, "b", "delete"), (3, "C", "insert"), (3, "c", "delete")]
    assert t.changes(4, 4) is None
    assert sorted(map(tuple, t.read(2).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_failed_runs_neither_skip_nor_repeat(spark, tmp_path):
    source, sink = VersionedTable(spark, str(tmp_path / "s")), VersionedTable(spark, str(tmp_path / "k"))
    work = lambda d: d.where("_change = 'insert'").select("id")

    def broken(d):
        raise RuntimeError("lost")

    source.append(spark.createDataFrame([(1,), (2,)], "id long"))
    with pytest.raises(RuntimeError):
        process_new(source, sink, "s", broken)
    # data written, but the run dies before its commit
    work(source.changes(0)).write.parquet(str(tmp_path / "k/data/orphan"))
    process_new(source, sink, "s", work)
    assert process_new(source, sink, "s", work).number == 1
    source.append(spark.createDataFrame([(3,)], "id long"))
    process_new(source, sink, "s", work)
    assert sorted(r.id for r in sink.read().collect()) == [1, 2, 3]
    assert sink.version().processed == {"s": 2}


def test_two_writers_cannot_take_the_same_version(spark, tmp_path):
    a, b = VersionedTable(spark, str(tmp_path / "t")), VersionedTable(spark, str(tmp_path / "t"))
    old = b.version()
    a.append(spark.createDataFrame([(1,)], "id long"))
    b.version = lambda number=None: old
    with pytest.raises(FileExistsError):
        b.append(spark.createDataFrame([(2,)], "id long"))
