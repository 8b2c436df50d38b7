from pyspark.sql import functions as F

from codestrata.operators import chunks as C


def test_line_chunks(spark):
    t = "".join(f"line {i}\n" for i in range(400)) + "x" * 4000
    got = spark.createDataFrame([(t,), (None,), ("a",)], "t string").select(C.line_chunks(F.col("t")).alias("c")).collect()
    assert got[1].c is None and got[2].c == ["a"]
    assert all(len(c) <= 1500 for c in got[0].c) and "".join([got[0].c[0], *(c[200:] for c in got[0].c[1:])]) == t


def test_class_chunks_and_costs(spark):
    body = "public class A {\n" + "".join(f"    public void m{i}() {{\n{'        x();' * 60}\n    }}\n" for i in range(10)) + "}"
    n = spark.createDataFrame([(1, "class", body), (2, "method", "x"), (3, "class", None)], "id long, node_type string, t string")
    got = C.class_chunks(n, "t").collect()
    assert len([r for r in got if r.id == 1]) == 11 and all(r.chunk_text.startswith("public class A {") for r in got if r.id == 1)
    s = C.scan_shape(n.where("id = 2"), "t")
    r = C.cost_estimate(s, spark.createDataFrame([("summaries", 2.0, 3.0)], "stage string, per_node double, usd_per_million double")).first()
    assert (r.usd, r.low, r.high) == (0.0003, 0.00015, 0.0006)


def test_bindings_and_inputs(spark):
    nodes = spark.createDataFrame([(1, "app.P.onSave", "onSave", "p.vue"), (2, "x.Q.go", "go", "q.vue"), (3, "y.Q.go", "go", "q.vue")], "id long, qn string, name string, file_path string")
    good, rest = C.bind_markup(spark.createDataFrame([(1, "app.P", "onSave"), (2, "z.Q", "go"), (3, "n", "no"), (4, "lib.P", "onSave")], "site long, owner string, member string"), nodes)
    assert sorted(map(tuple, good.collect())) == [(1, 1), (4, 1)] and sorted(map(tuple, rest.collect())) == [(2, "ambiguous"), (3, "not_found")]
    t = C.bind_templates(spark.createDataFrame([(1, "p.vue", "onSave"), (2, "q.vue", "go")], "site long, file_path string, name string"), nodes)
    assert [tuple(r) for r in t.collect()] == [(1, 1)]
    j = C.etl_jobs(spark.createDataFrame([("j", "load Stage_A into stage_b"), ("k", "nothing")], "job string, text string"), spark.createDataFrame([("stage_a",), ("stage_b",), ("c",)], "table string"))
    assert [(r.job, r.confidence) for r in j.collect()] == [("j", 0.9)]
    m = spark.range(1).select(C.redact_map(F.create_map(F.lit("db_password"), F.lit("x"), F.lit("name"), F.lit("y"))), C.view_names(F.lit("WEB/a/b.jsp"), ["WEB/"])).first()
    assert m[0] == {"db_password": "[masked]", "name": "y"} and "a/b" in m[1]
    x = C.table_extras(spark.createDataFrame([("t",)], "table string"), spark.createDataFrame([("s", ["t", "u"])], "screen string, tables array<string>"), spark.createDataFrame([("f", "t")], "from_table string, to_table string"), spark.createDataFrame([("table:f",)], "node string"))
    assert [tuple(r) for r in x.collect()] == [("screen:s", "screen")]
