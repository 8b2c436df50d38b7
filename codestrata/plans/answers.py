"""What a caller can ask: answers with status, data, totals and what was left out."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata import origins as O
from codestrata.operators import graph, joins, rollups
from codestrata.operators import text as T
from codestrata.plans.pages import Context

OK, MISSING, AMBIGUOUS = "ok", "not_found", "ambiguous"


@dataclass
class Answer:
    """A result and how much of it there is. `data` is small by then: capped lists only."""

    status: str = OK
    data: dict = field(default_factory=dict)
    totals: dict[str, int] = field(default_factory=dict)
    omitted: dict[str, int] = field(default_factory=dict)

    def cap(self, name: str, items: DataFrame, limit: int, *order) -> list[dict]:
        """The first `limit` rows as dictionaries; total and omitted are kept under `name`."""
        self.totals[name] = items.count()
        self.omitted[name] = max(0, self.totals[name] - limit)
        return [r.asDict(recursive=True) for r in items.orderBy(*order).limit(limit).collect()]

    @property
    def truncated(self) -> bool:
        return any(self.omitted.values())


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., Answer]
    budget: int = 8_000  # estimated tokens
    shed: tuple[str, ...] = ()  # lists to shorten, in order


TOOLS: dict[str, Tool] = {}


def tool(name: str, budget: int = 8_000, shed: tuple[str, ...] = ()):
    def keep(f):
        TOOLS[name] = Tool(name, f, budget, shed)
        return f

    return keep


def call(name: str, ctx: Context, **args) -> Answer:
    """Run a tool, mask secrets in its strings, flag text that tries to steer, and shorten it to its budget."""
    import json

    t = TOOLS[name]
    a = t.run(ctx, **args)
    n_masked = 0

    def clean(x):
        nonlocal n_masked
        if isinstance(x, str):
            for p in T.SECRET_FORMS:
                x, k = re.subn(p, "[masked]", x)
                n_masked += k
            return x
        return {k: clean(v) for k, v in x.items()} if isinstance(x, dict) else [clean(v) for v in x] if isinstance(x, list) else x

    a.data = clean(a.data)
    if n_masked:
        a.totals["masked"] = n_masked
    flags = re.findall(T.INSTRUCTION, json.dumps(a.data, default=str))
    if flags:
        a.totals["flagged"] = len(flags)
    for key in t.shed:
        rows = a.data.get(key)
        while isinstance(rows, list) and rows and len(json.dumps(a.data, default=str)) // 4 > t.budget:
            cut = max(1, len(rows) // 4)
            del rows[-cut:]
            a.omitted[key] = a.omitted.get(key, 0) + cut
    return a


def resolve_symbol(ctx: Context, key: str) -> tuple[str, DataFrame]:
    """By qualified name, else id, else name or dotted ending; several different names are ambiguous."""
    n = ctx.nodes
    for hit in (n.where(F.col("qn") == key), n.where(F.col("id") == int(key)) if key.isdigit() else None, n.where((F.col("name") == key) | F.col("qn").endswith("." + key))):
        if hit is not None:
            k = hit.select("qn").distinct().limit(2).count()
            if k:
                return (OK if k == 1 else AMBIGUOUS), hit
    return MISSING, n.limit(0)


def _unknown(ctx: Context, status: str, hit: DataFrame, key: str) -> Answer:
    a = Answer(status)
    near = hit if status == AMBIGUOUS else ctx.nodes.where(F.instr(F.lower("qn"), key.lower()) > 0)
    a.data["candidates"] = [r.qn for r in near.select("qn").distinct().orderBy(F.length("qn"), "qn").limit(5).collect()]
    return a


@tool("overview")
def overview(ctx: Context) -> Answer:
    a = Answer()
    a.data["counts"] = a.cap("counts", rollups.overview(ctx.nodes), 50, "section", F.desc("n"), "key")
    a.data["unresolved"] = a.cap("unresolved", rollups.unresolved_ratio(ctx.nodes, ctx.edges, ctx.unresolved), 50, F.desc("ratio"), "language")
    entries = rollups.out_degrees(ctx.nodes, ctx.edges, O.ENTRY_KINDS).join(ctx.nodes.select("id", "qn"), "id")
    a.data["entry_points"] = a.cap("entry_points", entries, 20, F.desc("n_out"), "qn")
    return a


@tool("context", shed=("callees", "callers"))
def context(ctx: Context, target: str) -> Answer:
    status, hit = resolve_symbol(ctx, target)
    if status != OK:
        return _unknown(ctx, status, hit, target)
    a, ids = Answer(), hit.select("id")
    a.data["symbol"] = hit.select("id", "qn", "node_type", "file_path", "line_start", "line_end").orderBy("id").limit(1).collect()[0].asDict()
    around = rollups.neighbours(ctx.nodes, ctx.edges, ids).join(ctx.nodes.select("id", "qn"), "id")
    for side in ("caller", "callee"):
        a.data[side + "s"] = a.cap(side + "s", around.where(F.col("side") == side).select("qn", "confidence"), 20, F.desc("confidence"), "qn")
    u = ctx.unresolved.join(ids.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi").select("callee_name", "reason")
    a.data["unresolved"] = a.cap("unresolved", u, 20, "callee_name", "reason")
    return a


@tool("impact", shed=("items", "unknowns"))
def impact(ctx: Context, target: str, depth: int = graph.DEPTH, max_items: int = graph.ITEMS) -> Answer:
    status, hit = resolve_symbol(ctx, target)
    if status != OK:
        return _unknown(ctx, status, hit, target)
    return impact_of(ctx, hit.select("id"), depth, max_items)


def impact_of(ctx: Context, seeds: DataFrame, depth: int = graph.DEPTH, max_items: int = graph.ITEMS) -> Answer:
    a = Answer()
    reached, unknowns = graph.impact_levels(ctx.nodes, ctx.edges, seeds, depth)
    items = graph.impact_items(ctx.nodes, reached).unionByName(graph.written_tables(ctx.nodes, ctx.edges, reached))
    a.data["items"] = a.cap("items", items.drop("parent"), min(max_items, 100), F.desc("score"), "depth", "node", "id")
    calls = graph.unresolved_unknowns(ctx.nodes, ctx.unresolved, reached).select(F.concat(F.lit("unresolved_call: "), "reason").alias("kind"), F.col("caller_id").alias("where_id"), F.lit(None).cast("long").alias("to_id"))
    unknowns = unknowns.unionByName(calls).distinct()
    a.data["unknowns"] = a.cap("unknowns", unknowns, graph.UNKNOWNS, "kind", "where_id", "to_id")
    a.data["by_kind"] = {r.kind: r.n for r in items.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    return a


@tool("change_impact", shed=("items", "unknowns"))
def change_impact(ctx: Context, hunks: DataFrame, depth: int = graph.DEPTH) -> Answer:
    """Impact of changed lines given as `file`, `lo`, `hi`."""
    n = ctx.nodes.where("line_start is not null").select("id", F.col("file_path").alias("file"), "line_start", "line_end")
    changed = joins.innermost(joins.overlapping(hunks.select("file", "lo", "hi"), n, ["file"]), ["file", "lo", "hi"], "id").select("id").distinct()
    a = impact_of(ctx, changed, depth)
    a.data["changed"] = a.cap("changed", changed.join(ctx.nodes.select("id", "qn"), "id"), 50, "qn", "id")
    return a


@tool("verification_plan")
def verification_plan(ctx: Context, hunks: DataFrame) -> Answer:
    """Tests that name conventions or calls tie to the changed files, and what else is affected."""
    a = change_impact(ctx, hunks)
    f = ctx.nodes.select(F.col("file_path").alias("file")).distinct()
    a.data["tests"] = a.cap("tests", joins.convention_tests(hunks.select("file").distinct(), f), 50, "file")
    a.data["tests_reached"] = [i["node"] for i in a.data["items"] if i["kind"] == "test"]
    return a


@tool("call_path")
def call_path(ctx: Context, source: str, target: str, max_depth: int = 4) -> Answer:
    ends = []
    for key in (source, target):
        status, hit = resolve_symbol(ctx, key)
        if status != OK:
            return _unknown(ctx, status, hit, key)
        ends.append(hit.select("id"))
    a = Answer()
    paths = graph.shortest_paths(graph.trusted(ctx.edges), ends[0], ends[1], max_depth)
    names = {r.id: r.qn for r in paths.select(F.explode("path").alias("id")).distinct().join(ctx.nodes.select("id", "qn"), "id").collect()}  # at most PATHS times the depth
    a.data["paths"] = [[names.get(i) for i in r.path] for r in paths.collect()]
    return a if a.data["paths"] else Answer(MISSING, a.data)


@tool("search", shed=("results",))
def search(ctx: Context, query: str, pages: DataFrame | None = None, limit: int = 20) -> Answer:
    """Names and, if given, pages (`page_id`, `title`, `body`, `facts`), fused by rank."""
    a = Answer()
    named = T.find_symbols(ctx.nodes.select("qn").distinct(), "qn", query).withColumn("rank", F.row_number().over(rollups.W.orderBy("tier", F.length("qn"), "qn"))).select(F.col("qn").alias("key"), "rank")
    lists = {"symbol": named}
    if pages is not None:
        postings, lengths = T.build_index(pages, "page_id", ["title", "body", "facts"])
        lists["fts"] = T.ranked(T.bm25(postings, lengths, "page_id", query), F.desc("score"), F.asc("page_id")).select(F.col("page_id").alias("key"), "rank")
    a.data["results"] = a.cap("results", T.fuse(lists, "key"), min(limit, 50), F.desc("score"), "key")
    return a


@tool("symbol_source")
def symbol_source(ctx: Context, sources: DataFrame, target: str, context_lines: int = 0) -> Answer:
    """Lines of a symbol out of `file_path`, `text`."""
    status, hit = resolve_symbol(ctx, target)
    if status != OK:
        return _unknown(ctx, status, hit, target)
    s = hit.orderBy("id").limit(1).join(sources, "file_path")
    first = F.greatest(F.col("line_start") - context_lines, F.lit(1))
    lines = F.slice(F.split("text", "\n"), first, F.coalesce("line_end", "line_start") - F.col("line_start") + 1 + 2 * context_lines)
    rows = s.select("qn", first.alias("line"), F.array_join(lines, "\n").alias("source")).collect()
    return Answer(OK, rows[0].asDict()) if rows else Answer(MISSING)


def _pages_of(ctx: Context, kind: str) -> DataFrame:
    from codestrata.plans.pages import run_builders

    return run_builders(ctx, [kind])


def _one(pages: DataFrame, key: str, *also) -> tuple[str, DataFrame]:
    """The page of an id, else of a title, whatever its case, else of one of the conditions; several are ambiguous."""
    for hit in (pages.where(F.col("page_id") == key), pages.where(F.lower("title") == key.lower()), *(pages.where(c) for c in also)):
        k = hit.select("page_id").distinct().limit(2).count()
        if k:
            return (OK if k == 1 else AMBIGUOUS), hit
    return MISSING, pages.limit(0)


def _page_answer(pages: DataFrame, key: str, *also) -> tuple[Answer, dict | None]:
    import json

    status, hit = _one(pages, key, *also)
    if status != OK:
        near = hit if status == AMBIGUOUS else pages.where(F.instr(F.lower("title"), key.lower()) > 0)
        return Answer(status, {"candidates": [r.page_id for r in near.orderBy(F.length("page_id"), "page_id").limit(5).collect()]}), None
    r = hit.limit(1).collect()[0]
    page = {"page_id": r.page_id, "title": r.title, "links": r.links, **json.loads(r.facts)}
    return Answer(OK, {"page": page}), page


@tool("screen")
def screen(ctx: Context, key: str) -> Answer:
    """A part of the user interface by id, label or route: what it calls and the tables behind."""
    return _page_answer(_pages_of(ctx, "screens"), key, F.get_json_object("facts", "$.file_path") == key)[0]


@tool("entity", shed=("moves",))
def entity(ctx: Context, key: str) -> Answer:
    """An entity by id or name; its moves are those of `ctx.options["moves"]` (`entity`, `from_state`, `to_state`)."""
    a, page = _page_answer(_pages_of(ctx, "entities"), key)
    moves = ctx.options.get("moves")
    if page and moves is not None:
        of = moves.where(F.col("entity") == page["page_id"].split("/", 1)[-1]).groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
        a.data["moves"] = a.cap("moves", of, 50, F.desc("n"), "from_state", "to_state")
    return a


@tool("flow", shed=("steps",))
def flow(ctx: Context, key: str) -> Answer:
    """What an entry point runs, step by step, with what it touches."""
    from codestrata.operators import catalog

    status, hit = resolve_symbol(ctx, key)
    if status != OK:
        return _unknown(ctx, status, hit, key)
    a = Answer()
    s = graph.slices(ctx.nodes, ctx.edges, hit.select("id"), ctx.options.get("flow_depth", O.FLOW_DEPTH))
    a.data["steps"] = a.cap("steps", s.join(ctx.nodes.select("id", "qn"), "id").select("depth", "qn", "stop"), 50, "depth", "qn")
    a.data["touches"] = [r.asDict() for r in catalog.touches(s, ctx.edges, ctx.nodes).collect()]  # one row
    return a


@tool("table", shed=("users",))
def table(ctx: Context, key: str) -> Answer:
    """A table by name: who reads and writes it, and keys to and from it (`ctx.options["keys"]`: `from_table`, `to_table`)."""
    models = ctx.nodes.where("node_type = 'db_model'")
    hit = models.where((F.col("qn") == key) | (F.lower("name") == key.lower()))
    k = hit.select("qn").distinct().limit(2).count()
    if k != 1:
        return _unknown(ctx, AMBIGUOUS if k else MISSING, hit, key)
    a = Answer()
    users = ctx.edges.join(hit.select(F.col("id").alias("dst")), "dst", "left_semi").join(ctx.nodes.select(F.col("id").alias("src"), "qn"), "src").select("qn", "edge_kind").distinct()
    a.data["users"] = a.cap("users", users, 50, "edge_kind", "qn")
    keys = ctx.options.get("keys")
    if keys is not None:
        a.data["keys"] = a.cap("keys", keys.where((F.lower("from_table") == key.lower()) | (F.lower("to_table") == key.lower())), 50, "from_table", "to_table")
    return a


@tool("entity_impact", shed=("links", "conditions"))
def entity_impact(ctx: Context, key: str) -> Answer:
    """What moves with an entity: mined sequences and conditions that name it
    (`ctx.options["sequences"]`, `ctx.options["conditions"]`)."""
    a = Answer()
    for name, cols in (("sequences", ("before", "after")), ("conditions", ("target", "context"))):
        rows = ctx.options.get(name)
        if rows is not None:
            of = rows.where((F.lower(cols[0]) == key.lower()) | (F.lower(cols[1]) == key.lower()))
            a.data[name] = a.cap(name, of, 50, F.desc("support"), *cols)
    return a if any(a.data.values()) else Answer(MISSING, a.data)


def list_pages(pages: DataFrame, kind: str | None = None, prefix: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Pages of a type, or whose id begins so, in order of their ids."""
    p = pages.where(F.col("type") == kind) if kind else pages
    p = p.where(F.col("page_id").startswith(prefix)) if prefix else p
    return p.orderBy("page_id").offset(max(0, offset)).limit(min(max(0, limit), 500))


def list_annotations(annotations: DataFrame, nodes: DataFrame, target: str | None = None, kind: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """Annotations, newest first, with `orphaned`: whether their symbol is gone."""
    a = annotations
    for column, value in (("target", target), ("kind", kind), ("status", status)):
        a = a.where(F.col(column) == value) if value is not None else a
    live = nodes.select(F.col("qn").alias("target"), F.lit(True).alias("_live")).distinct()
    return a.join(live, "target", "left").select(*annotations.columns, F.col("_live").isNull().alias("orphaned")).orderBy(F.desc("id")).limit(limit)


def answer_meta(answered: DataFrame, built: DataFrame, now: DataFrame, degraded: DataFrame | None = None) -> dict:
    """Which of the files behind an answer (`file`) changed since they were read
    (`file`, `hash`), and what the scan could not do: counts and the first few."""
    from codestrata.operators.snapshots import drift

    f = answered.select("file").distinct()
    changed = drift(built.join(f, "file", "left_semi"), now, ["file"], "hash").where("state <> 'fresh'")
    n = changed.count()
    out = {"files": f.count(), "changed": n, "fresh": n == 0, "changed_files": [r.file for r in changed.orderBy("file").limit(20).collect()]}
    if degraded is not None:
        out["degraded"] = [f"{r.stage}: {r.kind} ({r.n})" for r in degraded.groupBy("stage", "kind").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "stage", "kind").limit(20).collect()]
    return out


KINDS = ("correction", "note", "question", "decision")
STATUSES = ("proposed", "accepted", "rejected")


def new_annotations(existing: DataFrame, new: DataFrame, per_session: int = 20) -> DataFrame:
    """Those of `new` (`session`, `kind`, `target`, `text`, `at`) that are allowed: known kinds, and no more than a session may write."""
    n = existing.groupBy("session").agg(F.count("*").alias("_n"))
    k = F.row_number().over(rollups.W.partitionBy("session").orderBy("at", "target"))
    return new.where(F.col("kind").isin(*KINDS)).join(n, "session", "left").withColumn("_k", k + F.coalesce("_n", F.lit(0))).where(F.col("_k") <= per_session).drop("_k", "_n")


def set_status(annotations: DataFrame, annotation_id: int, status: str, human: bool) -> DataFrame:
    """Only people decide, and only about what is proposed."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    if status != "proposed" and not human:
        raise PermissionError("only a person may accept or reject")
    hit = (F.col("id") == annotation_id) & (F.col("status") == "proposed")
    return annotations.withColumn("status", F.when(hit, status).otherwise(F.col("status")))


def orphaned(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Annotations whose symbol is no more."""
    return annotations.join(nodes.select(F.col("qn").alias("target")).distinct(), "target", "left_anti")
