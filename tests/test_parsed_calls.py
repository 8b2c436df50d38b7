import json

import __spark_entry__ as entry
from codestrata.sources.parsers import PARSERS

LONG = "class A {\n  public void run(int a) {\n" + "".join(f"    call{i:04d}(a);{' ' * 60}\n" for i in range(500)) + "  }\n  public void next(int a) {\n    other(a);\n  }\n}\n"


def test_all_calls_of_a_long_method_and_none_of_the_next():
    calls = {r[1]: json.loads(r[5])["calls"] for r in PARSERS["java"]("a/A.java", LONG) if r[2] == "method"}
    assert calls == {"run": [f"call{i:04d}" for i in range(500)], "next": ["other"]}


def test_a_declaration_has_no_calls():
    text = "trait T {\n  fn a(x: [u8; 4]);\n  fn b(x: [u8; 4]) {\n    c(x);\n  }\n}\n"
    assert {r[1]: json.loads(r[5])["calls"] for r in PARSERS["rust"]("a/t.rs", text) if r[2] != "class"} == {"a": [], "b": ["c"]}


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a/A.java", "Java", LONG)], "id long, scan_id long, file_path string, language string, source_code string").write.parquet(f"{tmp_path}/code_nodes.parquet")
    spark.createDataFrame([(1,)], "scan_id long").write.parquet(f"{tmp_path}/current_scan.parquet")
    got = {r.callee: r.n for r in entry.queries()["parsed_calls"](spark, str(tmp_path)).collect()}
    assert got == {f"call{i:04d}": 1 for i in range(500)} | {"other": 1}
