import itertools
import random

import pytest

from codestrata.llm import spans as S

rng = random.Random(5)


def text(n, alphabet="abcdefgh \n"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def brute(rows, least=200):
    by = {}
    for k, t in rows:
        if t is not None:
            by[k] = t
    windows = {}
    for k, t in by.items():
        for i in range(len(t) - least + 1):
            windows.setdefault(t[i : i + least], set()).add(k)
    return sorted({p for ks in windows.values() for p in itertools.combinations(sorted(ks), 2)})


def cases():
    shared, short, one_line = text(260), text(199), text(230, "abcxyz")
    rows = [(1, text(500) + shared + text(50)), (2, shared + text(700)), (3, text(90) + short), (4, short + text(300)), (5, one_line + text(10)), (6, text(3) + one_line), (7, None), (8, ""), (9, "x" * 900), (10, "y" + "x" * 400), (11, text(5000)), (12, "漢🚚" * 150), (13, "é" + "漢🚚" * 110), (5, one_line + text(10))]
    rows[-1] = rows[4]
    return rows + [(20 + i, f"{i} " + shared[20:240]) for i in range(8)] + [(40, rows[0][1]), (41, rows[0][1])]


@pytest.mark.parametrize("hot", [64, 1])
def test_pairs_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = cases()
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "id long, src string, cid string")
    assert sorted(map(tuple, S.sharing_pairs(df, "id", "src").collect())) == brute(rows)


def test_amount_against_brute_force(spark):
    rows = cases()
    by = {k: t for k, t in rows if t is not None}
    got = {r.id: r for r in S.shared_amount(spark.createDataFrame(rows, "id long, src string"), "id", "src").collect()}
    for k, t in by.items():
        cover = set()
        for i in range(len(t) - 199):
            if any(t[i : i + 200] in u for q, u in by.items() if q != k):
                cover.update(range(i, i + 200))
        assert (got[k].n_shared if k in got else 0) == len(cover), k
    assert got[41].n_later == len(by[41])


def test_guarantee_and_empty(spark):
    assert S.guaranteed() <= S.LEAST
    df = spark.createDataFrame([], "id long, src string")
    assert S.sharing_pairs(df, "id", "src").count() == 0 and S.shared_amount(df, "id", "src").count() == 0
    with pytest.raises(ValueError):
        S.shared_spans(df.selectExpr("id as cid", "src as text"), 100)


def test_every_shared_stretch_holds_a_common_run():
    for _ in range(200):
        core = text(200, rng.choice(["ab", "abcdefgh", "a"]))
        a, b = text(rng.randint(0, 300)) + core + text(rng.randint(0, 300)), text(rng.randint(0, 300)) + core + text(rng.randint(0, 300))
        runs = [set(h.tolist()) for t in (a, b) for _, _, h in S.runs_of([t])]
        assert runs[0] & runs[1]


def test_repeats_are_removed_once(spark):
    rows = cases()
    by = {k: t for k, t in rows if t is not None}
    got = {r.id: r for r in S.without_repeats(spark.createDataFrame([(k, t, 1) for k, t in rows], "id long, src string, cid int"), "id", "src").collect()}
    for k, t in by.items():
        lesser = [u for q, u in by.items() if q < k]
        cover = {i for j in range(len(t) - 199) if any(t[j : j + 200] in u for u in lesser) for i in range(j, j + 200)}
        ends = S.sentences(t)
        kept = "".join(t[a:b] for a, b in zip(ends, ends[1:]) if not set(range(a, b)) <= cover)
        if k in (40, 41):
            kept = ""
        assert (got[k].kept, got[k].n_removed) == (kept, len(t) - len(kept)) if k in got else kept == t, k
    assert 1 not in got and got[41].n_removed == len(by[41]) and sum(r.n_removed > 100 for r in got.values()) > 8
    assert S.without("", []) == ("", 0) and S.without("abc", [(0, 3)]) == ("", 3) and S.without("abc", [(0, 2)]) == ("abc", 0)
    assert S.without_repeats(spark.createDataFrame([], "id long, src string"), "id", "src").count() == 0
