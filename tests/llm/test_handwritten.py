import random

import numpy as np

from codestrata.llm import handwritten as H

rng = random.Random(6)
BODY = "\n".join(f"    value_{i} = compute(source_{i}, {i})\n    if value_{i} is None:\n        return other_{i}" for i in range(8))


def make(n):
    rows = []
    for i in range(n):
        kind, p = i % 8, f"project_{i % 7}"
        body = BODY.replace("value", rng.choice(["ledger", "ticket", "gauge", "crate"])).replace("source", rng.choice(["mill", "loan"]))
        path, text, bad = f"{p}/src/part{i % 11}/file_{i}.py", body, False
        if kind == 0:
            text, bad = f"# Code generated by {rng.choice(['foo', 'bar'])}gen v{i}.2. DO NOT EDIT.\n" + body, True
        elif kind == 1:
            path, bad = f"{p}/third_party/lib{i}/file_{i}.py", True
        elif kind == 2:
            text, bad = "".join(f"function f{j}(a,b){{var c={j};return a.x(b||{j},\"k\")}}" for j in range(30)), True
        elif kind == 3:
            text, bad = "\n".join("_t_%d = [%s]" % (j, ",".join(str(rng.randint(-400, 900)) for _ in range(25))) for j in range(30)), True
        elif kind == 4:
            text = f"# the number {i} is generated by Crate, do not edit the sequence by hand\n" + body
        rows.append((i, i % 7, path, "python", text, bad))
    return rows


def test_held_out_projects_and_records():
    rows = make(480)
    kinds = [sorted(H.label(r[2], r[4])) for r in rows]
    assert [bool(k) for k in kinds] == [r[5] for r in rows]
    m = H.fit([r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], kinds, [r[1] for r in rows])
    assert m.report and all(x["precision"] >= 0.9 and x["recall"] >= 0.9 for x in m.report.values())
    new = make(160)
    said = H.score([r[2] for r in new], [r[3] for r in new], [r[4] for r in new], np.ascontiguousarray(m.weights.T), m.biases) > 0
    right = [bool(a.any()) == r[5] for a, r in zip(said, new)]
    assert sum(right) / len(right) >= 0.95


def test_score_is_what_features_and_weights_give():
    rows = make(16)
    w = np.random.default_rng(1).normal(size=(4, 1 << H.BITS)).astype(np.float32)
    args = [[r[k] for r in rows] for k in (2, 3, 4)]
    head, rest = H.features(*args)
    want = np.stack([head.dots(x) + rest.dots(x) for x in w], 1)
    assert np.allclose(H.score(*args, np.ascontiguousarray(w.T), np.zeros(4)), want, atol=1e-3)


def test_table(spark):
    rows = make(240) + [(900, 1, None, None, None, False), (901, 1, "a.py", None, "", False), (902, 1, "web/x.min.js", "javascript", "", True)]
    rows += rows[:20]
    df = spark.createDataFrame([r[:5] + ("x",) for r in rows], "id long, scan_id long, file_path string, language string, source_code string, kinds string")
    got = {(r.scan_id, r.file_path) for r in H.not_handwritten(df).collect()}
    want = {(r[1], r[2]) for r in rows if r[5]}
    assert len(got ^ want) <= 0.03 * len(want)
    assert H.not_handwritten(df.limit(0)).count() == 0


LICENCE = "/*\n" + "\n".join(f" * Licence clause {i} of many, without warranty" for i in range(30)) + "\n */\n"
NOTE = "Code generated by foogen v1.2. DO NOT EDIT."


def test_notices_below_the_first_lines():
    js = "function a(x) {\n  return x\n}\n"
    long_ = "/*! " + "no warranty " * 600 + "*/\n"
    for text in (LICENCE + f"// {NOTE}\n" + js, long_ + f"// {NOTE}\n" + js, "#!/bin/sh\n" + "# about\n" * 9 + f"# {NOTE}\necho", '"""About\n' + "words\n" * 9 + f'{NOTE}\n"""\nx = 1', "<!--\nwords\n\nwords\n\nwords\nwords\n" + f"{NOTE}\n-->\n<a/>", js * 5 + f"// {NOTE}\n" + js):
        assert H.label("src/a.x", text) == {"generated"}, text[-200:]
        head, rest = H.parts_of(text)
        assert "generated by" not in rest.lower()
    assert H.label("src/a.x", LICENCE + "// Copied unchanged from libfoo\n" + js) == H.label("src/a.x", "// Copied unchanged from libfoo\n" + js) == {"vendored"}


def test_remarks_below_the_opening_are_masked_but_label_nothing():
    text = "import a\n" + "x = 1\n" * 9 + "# do not edit the next line\ny = 2\n# copied from the wiki\nz = 3\n"
    assert H.label("src/a.py", text) == set()
    assert "do not edit" not in H.parts_of(text)[1] and "z = 3" in H.parts_of(text)[1]


def test_signs_settle_a_kind_that_was_not_trained():
    paths, texts = ["web/node_modules/x/a.js", "src/a.js"], ["x = 1", "x = 1"]
    m = H.fit(["src/b.py"], ["python"], ["y = 2"], [[]], ["p"])
    margin = H.settle(H.score(paths, [None, None], texts, np.ascontiguousarray(m.weights.T), m.biases), paths, texts)
    assert (margin > 0).tolist() == [[False, True, False, False], [False] * 4]


def test_report_keeps_projects_apart(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(H, "trained", lambda nodes, repository, validate: seen.append((repository, validate, {r.project_slug for r in nodes.collect()})) or H.Model(None, None, {"data": {"precision": 1.0, "recall": 0.5, "cases": 4}}))
    nodes, scans = spark.createDataFrame([(1, "a"), (2, "a")], "scan_id long, file_path string"), spark.createDataFrame([(1, "p"), (2, "p"), (2, "p")], "id long, project_slug string")
    assert [tuple(r) for r in H.report(nodes, scans).collect()] == [("data", 1.0, 0.5, 4)] and seen == [("project_slug", True, {"p"})]
