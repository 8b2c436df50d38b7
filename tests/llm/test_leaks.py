import random

from codestrata.llm import leaks as L

rng = random.Random(4)
WORDS = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(rng.choice(WORDS) for _ in range(30))


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = L.words(t)
        have = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
        for k, u in items:
            v = L.words(u)
            if any(tuple(v[i : i + 13]) in have for i in range(len(v) - 12)):
                out.add((d, k))
    return sorted(out)


def test_masks_find_every_window_with_two_words_replaced():
    assert L.masks_cover(L.MASKS, L.SPAN, L.MOST_DIFFERENT)


def data():
    p = PASSAGE.split()
    other = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs = [(1, other(40) + " " + " ".join(p[5:20]) + " " + other(20)), (2, other(9) + " -- ".join(x.upper() for x in p[3:16])), (3, " ".join(p[3:15])), (4, None), (5, ""), (6, " ".join(p[:6] + ["zzz"] + p[7:13])), (1, "again " + " ".join(p[:13]))]
    docs += [(100 + i, "x " * (i % 3) + PASSAGE) for i in range(300)]
    items = [(1, PASSAGE), (2, "before " + " ".join(p[4:18])), (3, None), (4, "too short"), (5, other(30))]
    return docs, items


def test_exact_leaks_against_brute_force(spark, monkeypatch):
    docs, items = data()
    d, i = spark.createDataFrame([(*x, "s") for x in docs], "doc_id long, text string, seed string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sorted(map(tuple, L.exact_leaks(d, i).collect())) == want
    monkeypatch.setattr(L, "BROADCAST_ROWS", 3)  # the other way of joining
    assert sorted(map(tuple, L.exact_leaks(d, i).collect())) == want


def test_substitutions_and_passages(spark):
    docs, items = data()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in L.leaks(d, i).collect()}
    assert not got[6, 1].exact and got[6, 1].n_words == 13
    assert got[100, 1].exact and got[100, 1].n_words == 30 and [tuple(p) for p in got[100, 1].passages] == [(0, 29, 0, 29)]
    assert L.leaks(d.limit(0), i).count() == 0 and L.leaks(d, i.limit(0)).count() == 0
