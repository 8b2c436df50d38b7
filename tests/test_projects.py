"""Projects: checkouts, frameworks, menus, screens, usings, beans."""

import subprocess

from pyspark.sql import functions as F

from codestrata.sources import projects as P


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "project string, path string, text string")


def test_checkout_and_state(tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    assert P.checkout(str(repo), str(tmp_path))[1] is None
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (repo / "a.txt").write_text("a")
    git("add", "."), git("commit", "-qm", "x")
    path, commit = P.checkout(str(repo), str(tmp_path))
    assert len(commit) == 40 and P.worktree_state(path) == ""
    (repo / "b.txt").write_text("b")
    one = P.worktree_state(path)
    (repo / "b.txt").write_text("c")
    assert one and P.worktree_state(path) not in ("", one)
    clone, again = P.checkout(f"file://{repo}", str(tmp_path))
    assert again == commit and clone != path and P.checkout(f"file://{repo}", str(tmp_path)) == (clone, commit)


def test_framework(spark):
    f = frame(spark, ("a", "pom.xml", "<g>org.springframework</g>"), ("a", "package.json", '{"express": 1}'), ("b", "x/package.json", '{"dependencies": {"express": "4"}}'), ("c", "package.json", "{}"), ("d", "Web.csproj", None))
    assert {r.project: r.framework for r in P.framework(f).collect()} == {"a": "spring", "b": "express"}


def test_menus_and_screens(spark):
    yaml = "# menu\n- label: Sales\n  children:\n    - label: Orders\n      path: /orders\n    - label: Orders\n      path: /orders/old\n- label: Home\n  path: /\n"
    ts = "import x from 'y';\nexport const MENU: Item[] = [\n  { label: 'Sales', icon: Icon.Cart, children: [{ label: 'Bills', path: '/bills', }, ] }, // x\n];"
    f = frame(spark, ("y", "conf/menu.yml", yaml), ("t", "src/menu.ts", ts), ("j", "nav.json", '[{"title": "A", "items": [{"title": "B", "url": "/b"}]}]'), ("j", "src/menu.ts", ts), ("r", "src/router.js", "[{path: '/user-list', component: UserList}, {path: '*'}]"),
              ("w", "web/Pages/Sales/OrderList.aspx", None), ("p", "WEB-INF/jsp/sales/orderList.jsp", "<x/>"), ("p", "WEB-INF/jsp/includes/head.jsp", ""), ("n", "a.txt", "x"))
    got = sorted((r.project, r.screen_id, r.label, r.menu, r.target) for r in P.screen_map(P.menus(f)).collect())
    assert got == [
        ("j", "a-b", "B", "A / B", "/b"), ("p", "sales-order-list", "Order List", "Sales / Order List", "WEB-INF/jsp/sales/orderList.jsp"), ("r", "user-list", "User List", "User List", "/user-list"), ("t", "sales-bills", "Bills", "Sales / Bills", "/bills"),
        ("w", "sales-order-list", "Order List", "Sales / Order List", "web/Pages/Sales/OrderList.aspx"), ("y", "home", "Home", "Home", "/"), ("y", "sales-orders", "Orders", "Sales / Orders", "/orders"), ("y", "sales-orders-2", "Orders", "Sales / Orders", "/orders/old")]
    assert P.menus(f.limit(0)).count() == 0 and P.json_menu("x", "{not json") == []


def test_usings_beans_entries(spark):
    f = frame(spark, ("a", "src/A/A.csproj", '<Using Include="A.Core" />'), ("a", "src/A/x/U.cs", "global using System.Linq;\nglobal using static A.B;\nusing No;"), ("a", "other/U.cs", "global using Lost;"),
              ("b", "S.java", '@Service("mail") @Primary\npublic class Mail {}\n@Entity class No {}\n@Component class Sms {}\n@Bean\npublic Bus bus() { return new RealBus(1); }'), ("b", "b.xml", '<bean id="q" class="a.b.Queue" primary="true"/><bean id="z"/>'),
              ("c", "P.cs", 'app.MapGet("/x", Api.List); s.AddSubscription<E, EHandler>(); s.AddHostedService<Worker>();'), ("c", "N.cs", None))
    assert {(r.project_dir, r.module) for r in P.project_usings(f).collect()} == {("src/A", "A.Core"), ("src/A", "System.Linq"), ("src/A", "A.B")}
    assert {(r.bean, r.impl, r.is_primary) for r in P.beans(f).collect()} == {("mail", "Mail", True), ("sms", "Sms", False), ("bus", "RealBus", False), ("q", "Queue", True)}
    assert {(r.kind, r.name) for r in P.registered_entries(f).collect()} == {("route", "List"), ("event", "EHandler"), ("hosted", "Worker")}


def test_filters(spark):
    d = spark.createDataFrame([("a/tests/x.py", "t"), ("a/x.py", " "), ("a/x.py", None), ("a/x.py", "t"), (None, "t")], "p string, t string")
    assert [r[0] for r in d.select(P.is_index_chunk(F.col("p"), F.col("t"))).collect()] == [False, False, False, True, True]
    t = spark.createDataFrame([("INFORMATION_SCHEMA.tables",), ("[sys].x",), ("#t",), ("orders",)], "n string")
    assert [r[0] for r in t.select(P.is_catalog_table(F.col("n"))).collect()] == [True, True, True, False]
    assert P.phase_runs(3, None, []) and not P.phase_runs(3, 4, []) and not P.phase_runs(3.0, None, ["3"]) and P.phase_runs(3.5, 3, ["3"])
