import random
from collections import defaultdict

from codestrata.operators import skew

EDGES = "caller_id long, callee_id long, confidence double, key string, salt string"


def brute(rows):
    by = defaultdict(list)
    for a, b, c, *_ in rows:
        if b is not None:
            by["callee", b].append((a, c))
        if a is not None:
            by["caller", a].append((b, c))
    return {k: (len(v), len({x for x, _ in v if x is not None}), (lambda m: round(sum(m) / len(m), 6) if m else None)([c for _, c in v if c is not None])) for k, v in by.items()}


def test_edge_sides_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randint(1, 40), 7 if rng.random() < 0.5 else rng.choice([None, *range(1, 30)]), rng.choice([None, 0.5, 0.9, 1.0]), "k", "s") for _ in range(3000)]
    rows += [rows[0]] * 500 + [(None, 3, 0.5, None, None)]
    for chunk in (1, 37, 100_000):
        got = skew.edge_sides(spark.createDataFrame(rows, EDGES).repartition(5), chunk)
        got, want = {(r.key_side, r.node_id): (r.n_edges, r.n_partners, r.mean_confidence) for r in got.collect()}, brute(rows)
        assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
        assert all(v[2] == want[k][2] or abs(v[2] - want[k][2]) < 2e-6 for k, v in got.items())


def test_row_numbers_are_exact(spark):
    rows = [(1, i % 10, 1.0, "", "") for i in range(1000)] + [(2, None, None, "", "")] * 3
    n = skew.numbered(spark.createDataFrame(rows, EDGES), "caller_id", "callee_id", "confidence", 64)
    got = defaultdict(list)
    for r in n.collect():
        got[r.key].append((r.row, r.value, r.chunk))
    assert [x[0] for x in sorted(got[1])] == list(range(1000)) and [x[1] for x in sorted(got[1])] == sorted(i % 10 for i in range(1000))
    assert max(sum(1 for x in got[1] if x[2] == c) for c in range(16)) == 64 and len(got[2]) == 3


def test_empty_and_heavy(spark):
    assert skew.edge_sides(spark.createDataFrame([], EDGES)).count() == 0
    stats = spark.createDataFrame([(1, 2), (2, 98)], "key long, n_rows long")
    assert [r.key for r in skew.heavy_keys(stats, 100, 0.02).collect()] == [1, 2]
    assert [r.key for r in skew.heavy_keys(stats, 101, 0.02).collect()] == [2]
