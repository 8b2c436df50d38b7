import __spark_entry__ as entry


def test_the_body_is_part_of_the_index(spark, tmp_path):
    rows = [(1, "Ledger notes", "the ledger, the LEDGER and a gauge", "wiki"), (2, None, "gauge", "wiki"), (3, "Gauge", None, None)]
    spark.createDataFrame(rows, "doc_id long, title string, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.token: (r.n_pages, r.n_uses) for r in entry.queries()["index_stats"](spark, str(tmp_path)).collect()}
    assert got == {"ledger": (1, 3), "notes": (1, 1), "the": (1, 2), "and": (1, 1), "a": (1, 1), "gauge": (3, 3), "wiki": (2, 2)}
