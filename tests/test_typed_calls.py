"""Typed tiers on a hand-made project."""

import pytest
from pyspark.sql import functions as F

from codestrata.operators import typed_calls as T

SYMBOLS = [
    (1, "a.Base", "Base", "class", "app/a/Base.cs", None, None), (2, "a.Base.save", "save", "method", "app/a/Base.cs", "Order", None),
    (3, "a.Repo", "Repo", "class", "app/a/Repo.cs", None, None), (4, "a.Repo.find", "find", "method", "app/a/Repo.cs", "List<Order>?", None),
    (5, "a.Order", "Order", "class", "app/a/Order.cs", None, None), (6, "a.Order.total", "total", "method", "app/a/Order.cs", "Money", None),
    (7, "b.One", "One", "class", "app/b/One.cs", None, None), (8, "b.One.send", "send", "method", "app/b/One.cs", None, None),
    (9, "b.Two", "Two", "class", "app/b/Two.cs", None, None), (10, "b.Two.send", "send", "method", "app/b/Two.cs", None, None),
    (11, "c.Twin", "Twin", "class", "app/c/Twin.cs", None, None), (12, "d.Twin", "Twin", "class", "app/d/Twin.cs", None, None),
    (13, "e.Ext.grow", "grow", "method", "app/e/Ext.cs", None, "Builder"), (14, "x.Main", "Main", "class", "app/x/Main.cs", None, None), (15, "x.Main.run", "run", "method", "app/x/Main.cs", None, None),
    (16, "b.Only", "Only", "class", "app/b/Only.cs", None, None), (17, "b.Only.ping", "ping", "method", "app/b/Only.cs", None, None),
    (18, "a.Shop", "Shop", "class", "app/a/Shop.cs", None, None), (19, "a.Shop.pick", "pick", "method", "app/a/Shop.cs", "Order", None), (20, "a.Repo.save", "save", "method", "app/a/Repo.cs", None, None),
]
VARIABLES = [("x.Main.run", "repo", "a.Repo"), ("x.Main", "sender", "ISend"), ("x.Main", "shop", "Shop"), ("x.Main", "log", "ILogger<T>"), ("x.Main", "twin", "Twin"), ("x.Main", "builder", "Builder"), ("x.Main", "only", "IOnly"), ("x.Main", "repo", "Order")]
BASES = [("a.Repo", "Base"), ("a.Shop", "Base"), ("a.Order", "Entity"), ("b.One", "ISend"), ("b.Two", "ISend"), ("b.Only", "IOnly")]
SITES = [
    (1, "find", "repo"), (2, "save", "shop"), (3, "send", "sender"), (4, "info", "log"), (5, "go", "twin"), (6, "grow", "builder"), (7, "ping", "this.only"), (8, "total", "shop.pick(a, b)"),
    (9, "pick", "Shop"), (10, "missing", "repo"), (11, "missing", "shop.pick()"), (12, "f", "unknown"), (13, "Order", None), (14, "Twin", None), (15, "f", None), (16, None, "repo"),
]


@pytest.fixture(scope="module")
def store(spark):
    symbols = spark.createDataFrame([(i, 1, q, n, k, "csharp", f, r, e) for i, q, n, k, f, r, e in SYMBOLS], "id long, scan_id long, qn string, name string, node_type string, language string, file_path string, return_type string, extends_type string")
    variables = spark.createDataFrame([(1, *v) for v in VARIABLES], "scan_id long, scope string, variable string, type_name string")
    bases = spark.createDataFrame([(1, *b) for b in [*BASES, *BASES]], "scan_id long, class_qn string, base string")
    sites = spark.createDataFrame([(s, 1, "x.Main.run", "app/x/Main.cs", n, r, "csharp") for s, n, r in SITES], "site long, scan_id long, caller_qn string, file_path string, name string, receiver string, language string")
    return symbols, variables, bases, sites


def test_typed(store):
    symbols, variables, bases, sites = store
    good, rest = T.resolve_typed(sites, variables, symbols, bases)
    assert sorted((r.site, r.id, r.origin) for r in good.collect()) == [
        (1, 4, "receiver_global"), (2, 2, "inherited"), (3, 8, "dispatch"), (3, 10, "dispatch"), (6, 13, "receiver_typed"), (7, 17, "framework"), (8, 6, "receiver_global"), (9, 19, "receiver_global")]
    got = {r.site: (r.reason, r.n_candidates) for r in rest.collect()}
    assert got == {4: ("external", 0), 5: ("di_ambiguous", 2), 10: ("not_found", 0), 11: ("external", 0), 16: ("not_found", 0)}


def test_registered(store, spark):
    symbols, variables, bases, sites = store
    reg = spark.createDataFrame([(1, "ISend", "Two", "app")], "scan_id long, interface string, impl string, project string")
    good, _ = T.resolve_typed(sites.where("site = 3"), variables, symbols, bases, reg)
    assert [(r.id, r.origin) for r in good.collect()] == [(10, "framework")]
    both = reg.unionByName(spark.createDataFrame([(1, None, "One", "other")], reg.schema))
    good, _ = T.resolve_typed(sites.where("site = 3"), variables, symbols, bases, both)
    assert [(r.id, r.origin) for r in good.collect()] == [(10, "framework")]


def test_type_references(store):
    symbols, _, _, sites = store
    good, rest = T.type_references(sites, symbols)
    assert [(r.site, r.id, r.origin) for r in good.collect()] == [(13, 5, "receiver_global")] and [(r.site, r.n_candidates) for r in rest.collect()] == [(14, 2)]


def test_ancestors_and_overrides(store, spark):
    symbols, _, bases, _ = store
    loop = spark.createDataFrame([(1, "a.Base", "Shop")], bases.schema)
    up = {(r.class_qn, r.base_qn, r.level) for r in T.ancestors(bases.unionByName(loop), symbols).collect()}
    assert up == {("a.Repo", "a.Base", 1), ("a.Shop", "a.Base", 1), ("a.Base", "a.Shop", 1), ("a.Repo", "a.Shop", 2)}
    assert [(r.src, r.dst) for r in T.override_edges(bases, symbols).collect()] == [(2, 20)] and T.override_edges(bases, symbols, 0).count() == 0


def test_relative_modules(spark):
    imports = spark.createDataFrame([("src/a/x.js", "./y"), ("src/a/x.js", "../b"), ("src/a/x.js", "lodash"), ("x.js", "./src/a/x.js"), ("src/a/x.js", "./none")], "importer string, module string")
    files = spark.createDataFrame([("src/a/y.ts",), ("src/a/y.js",), ("src/b/index.ts",), ("src/a/x.js",)], "file string")
    got = {(r.importer, r.module): r.file for r in T.relative_modules(imports, files).collect()}
    assert got == {("src/a/x.js", "./y"): "src/a/y.js", ("src/a/x.js", "../b"): "src/b/index.ts", ("x.js", "./src/a/x.js"): "src/a/x.js"}


def test_reexports(spark):
    e = spark.createDataFrame([("i.js", "*", "*", "j.js"), ("j.js", "A", "a", "k.js"), ("j.js", "*", "*", "i.js"), ("m.js", "*", "*", "k.js"), ("m.js", "*", "*", "l.js")], "file string, name string, source_name string, source string")
    d = spark.createDataFrame([("k.js", "a", 1), ("l.js", "a", 2)], "file string, name string, id long")
    got = {(r.file, r.name): r.id for r in T.reexported(e, d).collect()}
    assert got == {("k.js", "a"): 1, ("l.js", "a"): 2, ("j.js", "A"): 1, ("i.js", "A"): 1}
    assert T.reexported(e.limit(0), d.limit(0)).count() == 0


def test_very_many_implementations(spark):
    """Beyond the cap a site costs one row, unless something registered decides."""
    n = 40
    symbols = spark.createDataFrame([(i, 1, f"b.C{i}.send", "send", "method", "csharp", f"b/C{i}.cs", None, None) for i in range(n)], "id long, scan_id long, qn string, name string, node_type string, language string, file_path string, return_type string, extends_type string")
    bases = spark.createDataFrame([(1, f"b.C{i}", "ISend") for i in range(n)], "scan_id long, class_qn string, base string")
    typed = spark.createDataFrame([(s, 1, "ISend", "send", "app/x.cs") for s in (1, 2)] + [(3, 1, "ISend", "none", "app/x.cs")], "site long, scan_id long, type_name string, name string, file_path string")
    edges, rest = T.implementing(typed, bases, symbols)
    assert edges.count() == 0 and sorted(map(tuple, rest.collect())) == [(1, "dispatch_cap", 40), (2, "dispatch_cap", 40)]
    edges, rest = T.implementing(typed, bases, symbols, None, 40)
    assert edges.where("origin = 'dispatch'").count() == 80 and rest.count() == 0
    reg = spark.createDataFrame([(1, "ISend", "C7", "app"), (1, "ISend", "C8", "lib")], "scan_id long, interface string, impl string, project string")
    edges, rest = T.implementing(typed, bases, symbols, reg)
    assert sorted(map(tuple, edges.collect())) == [(1, 7, "framework"), (2, 7, "framework")] and rest.count() == 0
    edges, rest = T.implementing(typed, bases, symbols, reg.withColumn("project", F.lit("lib")))
    assert edges.count() == 0 and sorted(map(tuple, rest.collect())) == [(1, "di_ambiguous", 2), (2, "di_ambiguous", 2)]
