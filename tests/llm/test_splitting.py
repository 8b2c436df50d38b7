import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.llm import split


def cut(spark, texts, limit, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return {r.id: r.p for r in df.select("id", split.pieces(F.col("text"), limit, overlap).alias("p")).collect()}


def check(text, pieces, limit, overlap):
    assert [p.chunk_index for p in pieces] == list(range(len(pieces)))
    assert "".join(p.piece[p.overlap :] for p in pieces) == text
    for i, p in enumerate(pieces):
        assert len(p.piece) <= limit and p.overlap <= overlap
        assert text[p.start : p.start + len(p.piece)] == p.piece
        assert (p.overlap > 0) == (i > 0 and overlap > 0) or not p.overlap


def test_round_trip_of_awkward_texts(spark):
    rng = random.Random(2)
    code = "".join(f"def f{i}(a):\n    if a:\n        return {i};\n\n" for i in range(200))
    texts = [code, code.replace("\n", "\r\n"), code.replace("\n", "\r"), "x" * 5000, " " * 5000, "\n" * 5000, "\r\n" * 3000, "🚚a" * 2500, "漢字。" * 2000, "", None, "short", "".join(rng.choice("ab \n🚚}；;é") for _ in range(20_000)), "a" * 300]
    got = cut(spark, texts, 300, 50)
    assert got[10] is None and [p.piece for p in got[9]] == [""] and len(got[11]) == 1 and len(got[13]) == 1
    for i, t in enumerate(texts):
        if t is not None:
            check(t, got[i], 300, 50)
    ends = [p.piece for p in got[0][:-1]]
    assert all(e.endswith("\n") for e in ends)
    assert not any(p.piece.endswith("\r") and texts[1][p.start + len(p.piece) : p.start + len(p.piece) + 1] == "\n" for p in got[1])


def test_very_long_texts_do_not_overflow(spark):
    t = "🚚x\n" * 200_000
    check(t, cut(spark, [t], 1500, 200)[0], 1500, 200)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab;{}\n\r é漢🚚", max_size=200), min_size=1, max_size=5), st.integers(2, 40), st.integers(0, 20))
def test_any_text(spark, texts, limit, overlap):
    overlap = min(overlap, limit - 1)
    got = cut(spark, texts, limit, overlap)
    for i, t in enumerate(texts):
        check(t, got[i], limit, overlap)


def test_oversized_records(spark):
    nodes = spark.createDataFrame([(1, "a" * 6001, 5), (1, "a" * 6001, 5), (2, "b" * 6000, 5), (3, None, 5)], "id long, source_code string, pieces int")
    chunks = spark.createDataFrame([(9, "é" * 1501)], "chunk_id long, chunk_text string")
    got = split.split_records(nodes, chunks)
    assert sorted((r.rec_kind, r.rec_id, len(r.pieces)) for r in got.collect()) == [("chunk", 9, 2), ("node", 1, 2)]
    assert split.split_records(nodes.limit(0), chunks.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.pieces(F.lit(""), 10, 10)
