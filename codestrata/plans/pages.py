"""Materialised pages: builders over the graph, their registry, and answers with budgets.

A builder gives rows of PAGE: `page_id`, `type`, `title`, `facts` (JSON),
`links` (ids of other pages). Builders are registered with what they emit;
running them checks that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata import origins as O
from codestrata.operators import graph, rollups
from codestrata.operators.text import page_id

PAGE_TYPES = ["overview", "module", "file", "symbol", "screen", "endpoint", "entity", "table", "interface", "flow", "domain", "onboarding", "batch_job", "stored_proc", "note", "index", "search"]


@dataclass
class Context:
    """What builders read."""

    nodes: DataFrame
    edges: DataFrame
    unresolved: DataFrame
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Builder:
    name: str
    emits: tuple[str, ...]
    version: str
    run: Callable[[Context], DataFrame]


BUILDERS: dict[str, Builder] = {}
POST_SCAN: dict[str, Callable[[Context], None]] = {}


def page_builder(name: str, emits: tuple[str, ...], version: str = "1"):
    def keep(f):
        BUILDERS[name] = Builder(name, emits, version, f)
        return f

    return keep


def register_post_scan(name: str, hook: Callable[[Context], None]) -> None:
    POST_SCAN[name] = hook


def run_post_scan(ctx: Context) -> dict[str, str]:
    """'ok' or the error of every hook; one that fails doesn't stop the others."""
    out = {}
    for name, hook in POST_SCAN.items():
        try:
            hook(ctx)
            out[name] = "ok"
        except Exception as e:  # noqa: BLE001
            out[name] = f"{type(e).__name__}: {e}"
    return out


def run_builders(ctx: Context, names: list[str] | None = None) -> DataFrame:
    """All pages; each of a type its builder says it emits."""
    out = None
    for name in names or BUILDERS:
        b = BUILDERS[name]
        if set(b.emits) - set(PAGE_TYPES):
            raise ValueError(f"{name} emits unknown page types")
        pages = b.run(ctx).select("page_id", "type", "title", "facts", "links")
        pages = pages.withColumn("type", F.when(F.col("type").isin(list(b.emits)), F.col("type")).otherwise(F.raise_error(F.concat(F.lit(f"{name} may not emit "), F.col("type")))))
        out = pages if out is None else out.unionByName(pages)
    return out


def page(kind: str, key: Column, title: Column, facts: Column, links: Column | None = None) -> list[Column]:
    return [page_id(F.lit(kind), key).alias("page_id"), F.lit(kind).alias("type"), title.alias("title"), F.to_json(facts).alias("facts"), (links if links is not None else F.array().cast("array<string>")).alias("links")]


def _scope(c: str = "scan_id") -> Column:
    return F.col(c).cast("string")


@page_builder("overview", ("overview",))
def overview(ctx: Context) -> DataFrame:
    n = ctx.nodes.groupBy("scan_id").agg(F.count("*").alias("symbols"), F.count_distinct("file_path").alias("files"), F.count_if(F.col("node_type").isin(O.ENTRY_KINDS)).alias("entries"))
    return n.select(*page("overview", _scope(), _scope(), F.struct("symbols", "files", "entries")))


@page_builder("modules", ("module",))
def modules(ctx: Context) -> DataFrame:
    """Every folder above a file, with files and symbols below it."""
    parts = F.split("file_path", "/")
    f = ctx.nodes.groupBy("scan_id", "file_path").agg(F.count("*").alias("symbols"))
    up = f.select("scan_id", "file_path", "symbols", F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))).alias("k"), parts.alias("p")).where("size(p) > 1")
    d = up.groupBy("scan_id", F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("dir")).agg(F.count("*").alias("files"), F.sum("symbols").alias("symbols"))
    parent = F.when(F.instr("dir", "/") > 0, F.array(page_id(F.lit("module"), F.concat_ws("/", _scope(), F.regexp_extract("dir", r"^(.*)/[^/]*$", 1))))).otherwise(F.array().cast("array<string>"))
    return d.select(*page("module", F.concat_ws("/", _scope(), "dir"), F.col("dir"), F.struct("files", "symbols"), parent))


@page_builder("files", ("file",))
def files(ctx: Context) -> DataFrame:
    calls = ctx.edges.where("dst is not null").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"))
    f = ctx.nodes.join(calls, "id", "left").groupBy("scan_id", "file_path").agg(F.count("*").alias("symbols"), F.sum(F.coalesce("callers", F.lit(0))).alias("callers"))
    most = ctx.options.get("file_cap")
    if most:
        f = f.withColumn("_k", F.row_number().over(W.partitionBy("scan_id").orderBy(F.desc("callers"), "file_path"))).where(F.col("_k") <= most)
    return f.select(*page("file", F.concat_ws("/", _scope(), "file_path"), F.col("file_path"), F.struct("symbols", "callers")))


@page_builder("symbols", ("symbol",))
def symbols(ctx: Context) -> DataFrame:
    """Entry points and hubs, with the first hundred callers and callees."""
    d = graph.in_degrees(ctx.edges.where("dst is not null"))
    hubs = d.orderBy(F.desc("in_degree"), "id").limit(ctx.options.get("hubs", 20)).select("id")
    pick = ctx.nodes.where(F.col("node_type").isin(O.ENTRY_KINDS)).select("id").unionByName(hubs).distinct()
    n = rollups.page_keys(ctx.nodes).join(pick, "id", "left_semi")
    around = rollups.neighbours(ctx.nodes, ctx.edges, pick)
    names = around.join(ctx.nodes.select("id", "qn"), "id").withColumn("k", F.row_number().over(W.partitionBy("centre", "side").orderBy(F.desc("confidence"), "qn", "id"))).where("k <= 100")
    lists = names.groupBy(F.col("centre").alias("id")).agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("k", "qn")))), lambda x: x["qn"]).alias(s + "s") for s in ("caller", "callee")])
    j = n.join(lists, "id", "left")
    return j.select(*page("symbol", F.concat_ws("/", _scope(), "key"), F.col("name"), F.struct("qn", "node_type", "file_path", "callers", "callees")))


@page_builder("endpoints", ("endpoint",))
def endpoints(ctx: Context) -> DataFrame:
    n = ctx.nodes.where("node_type = 'endpoint'").withColumn("route", F.regexp_extract(F.coalesce("annotations", F.lit("")), r"Route\(([^)]*)\)", 1))
    same = F.count("*").over(W.partitionBy("scan_id", "route")) > 1
    key = F.concat_ws("/", _scope(), F.when((F.col("route") == "") | same, F.col("qn")).otherwise(F.col("route")))
    return n.select(*page("endpoint", key, F.col("name"), F.struct("route", F.col("qn").alias("handler"), "file_path")))


@page_builder("batch_jobs", ("batch_job",))
def batch_jobs(ctx: Context) -> DataFrame:
    """Jobs, with when they run as far as an annotation says so."""
    said = F.regexp_extract(F.coalesce("annotations", F.lit("")), r"(?:Scheduled|Cron|Schedule|RecurringJob)\(([^)]*)\)", 1)
    n = ctx.nodes.where("node_type = 'batch_job'")
    return n.select(*page("batch_job", F.concat_ws("/", _scope(), "qn"), F.col("name"), F.struct(F.nullif(said, F.lit("")).alias("schedule"), F.col("qn").alias("handler"), "file_path")))


@page_builder("screens", ("screen",))
def screens(ctx: Context) -> DataFrame:
    """Parts of the user interface, with what they call and the tables behind that."""
    out = ctx.edges.where("dst is not null").select(F.col("src").alias("id"), "dst").distinct().join(ctx.nodes.select(F.col("id").alias("dst"), F.col("qn").alias("callee"), F.col("node_type").alias("t")), "dst")
    per = out.groupBy("id").agg(F.count("*").alias("calls"), F.count_if(F.col("t").isin(O.ENTRY_KINDS)).alias("entries"), F.sort_array(F.collect_set(F.when(F.col("t") == "db_model", F.col("callee")))).alias("tables"))
    n = ctx.nodes.where("node_type = 'ui_component'").join(per, "id", "left")
    links = F.transform(F.coalesce("tables", F.array().cast("array<string>")), lambda t: page_id(F.lit("table"), F.concat_ws("/", _scope(), t)))
    return n.select(*page("screen", F.concat_ws("/", _scope(), "qn"), F.col("name"), F.struct("file_path", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("entries", F.lit(0)).alias("entries"), "tables"), links))


@page_builder("entities", ("entity",))
def entities(ctx: Context) -> DataFrame:
    """What is kept, with its state machine (`ctx.options["machines"]`: `entity`,
    `states`, `n_moves`) where one was mined, and who writes it."""
    machines = ctx.options.get("machines")
    n = ctx.nodes.where(F.col("node_type").isin("db_model", "class"))
    w = ctx.edges.where("edge_kind = 'writes_table' and dst is not null").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("writers"))
    n = n.join(w, "id", "left")
    if machines is None:
        n = n.withColumns({"states": F.array().cast("array<string>"), "n_moves": F.lit(0).cast("long")})
    else:
        n = n.join(machines.select(F.col("entity").alias("qn"), "states", "n_moves"), "qn", "left")
    return n.select(*page("entity", F.concat_ws("/", _scope(), "qn"), F.col("name"), F.struct("domain", "states", "n_moves", F.coalesce("writers", F.lit(0)).alias("writers"))))


@page_builder("stored_procs", ("stored_proc",))
def stored_procs(ctx: Context) -> DataFrame:
    """Procedures that are called or defined, with their callers and their tables."""
    called = ctx.edges.where("edge_kind = 'calls_proc'").select("scan_id", F.lower("callee_name").alias("proc"), F.col("src").alias("caller"), F.lit(False).alias("defined"))
    defined = ctx.nodes.where("node_type = 'stored_proc'").select("scan_id", F.lower("name").alias("proc"), F.lit(None).cast("long").alias("caller"), F.lit(True).alias("defined"))
    p = called.unionByName(defined).groupBy("scan_id", "proc").agg(F.count_distinct("caller").alias("callers"), F.bool_or("defined").alias("defined"))
    own = ctx.nodes.where("node_type = 'stored_proc'").select(F.col("id").alias("src"), F.lower("name").alias("proc"))
    t = ctx.edges.where("edge_kind in ('reads_table', 'writes_table')").join(own, "src").groupBy("scan_id", "proc").agg(F.sort_array(F.collect_set("callee_name")).alias("tables"))
    return p.join(t, ["scan_id", "proc"], "left").select(*page("stored_proc", F.concat_ws("/", _scope(), "proc"), F.col("proc"), F.struct("callers", "defined", "tables")))


@page_builder("tables", ("table",))
def tables(ctx: Context) -> DataFrame:
    """Data models, with who uses them."""
    use = ctx.edges.where("dst is not null").join(ctx.nodes.where("node_type = 'db_model'").select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("users"))
    return ctx.nodes.where("node_type = 'db_model'").join(use, "id", "left").select(*page("table", F.concat_ws("/", _scope(), "qn"), F.col("name"), F.struct("qn", F.coalesce("users", F.lit(0)).alias("users"))))


@page_builder("interfaces", ("interface",))
def interfaces(ctx: Context) -> DataFrame:
    """What is called by name and not found: systems outside."""
    u = ctx.unresolved.where("reason = 'external'").groupBy("scan_id", "callee_name").agg(F.count("*").alias("calls"), F.count_distinct("caller_id").alias("callers"))
    return u.select(*page("interface", F.concat_ws("/", _scope(), "callee_name"), F.col("callee_name"), F.struct("calls", "callers")))


@page_builder("domains", ("domain",))
def domain_pages(ctx: Context) -> DataFrame:
    d = ctx.nodes.where("domain is not null").groupBy("scan_id", "domain").agg(F.count("*").alias("symbols"), F.count_if(F.col("node_type").isin(O.ENTRY_KINDS)).alias("entries"))
    return d.select(*page("domain", F.concat_ws("/", _scope(), "domain"), F.col("domain"), F.struct("symbols", "entries")))


@page_builder("flows", ("flow",))
def flows(ctx: Context) -> DataFrame:
    """What every entry point runs."""
    s = graph.slices(ctx.nodes, ctx.edges, ctx.nodes.where(F.col("node_type").isin(O.ENTRY_KINDS)).select("id"), ctx.options.get("flow_depth", O.FLOW_DEPTH))
    f = s.groupBy("entry").agg(F.count("*").alias("steps"), F.max("depth").alias("depth"), F.count("stop").alias("stops"))
    return f.join(ctx.nodes.select(F.col("id").alias("entry"), "scan_id", "qn", "name"), "entry").select(*page("flow", F.concat_ws("/", _scope(), "qn"), F.col("name"), F.struct("steps", "depth", "stops")))


@page_builder("onboarding", ("onboarding",))
def onboarding(ctx: Context) -> DataFrame:
    """Per domain with at least three symbols the order to read them in: entries, then by callers."""
    d = graph.in_degrees(ctx.edges.where("dst is not null"))
    n = ctx.nodes.where("domain is not null").join(d, "id", "left")
    k = F.row_number().over(W.partitionBy("scan_id", "domain").orderBy(F.col("node_type").isin(O.ENTRY_KINDS).desc(), F.coalesce("in_degree", F.lit(0)).desc(), "qn", "id"))
    t = n.withColumn("k", k).where("k <= 15").groupBy("scan_id", "domain").agg(F.count("*").alias("steps"), F.transform(F.sort_array(F.collect_list(F.struct("k", "qn"))), lambda x: x["qn"]).alias("tour")).where("steps >= 3")
    return t.select(*page("onboarding", F.concat_ws("/", _scope(), "domain"), F.col("domain"), F.struct("steps", "tour")))


def injection_points(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """`table`, `confidence`: tables that are read and never written, so filled from elsewhere."""
    return reads.select("table").distinct().join(writes.select("table").distinct(), "table", "left_anti").withColumn("confidence", F.lit(0.8))


def procedure_points(procedures: DataFrame, views: DataFrame, jobs: DataFrame) -> DataFrame:
    """`table`, `kind`, `confidence`: other ways by which tables are filled:
    procedures, views and jobs that import."""
    kind = lambda df, name, c: df.select("table", F.lit(name).alias("kind"), F.lit(c).alias("confidence"))
    return kind(procedures, "procedure", 0.6).unionByName(kind(views, "view", 0.5)).unionByName(kind(jobs.where(F.lower("job").rlike("import|load|sync|ingest|etl")), "import", 0.7)).distinct()


def decision_table(conditions: DataFrame) -> DataFrame:
    """Markdown lines of a decision table per target of mined conditions."""
    rows = conditions.withColumn("k", F.row_number().over(W.partitionBy("target").orderBy("context", "state")))
    return rows.select("target", "k", F.format_string("| %d | %s = %s | %s | %d |", F.col("k"), F.col("context"), F.col("state"), F.col("target"), F.col("support")).alias("line"))


def requirement(conditions: DataFrame) -> DataFrame:
    return conditions.select("target", F.format_string("WHILE %s is %s, WHEN %s moves, the system SHALL keep %s (seen %d times).", "context", "state", "target", "context", "support").alias("text"))


def diagram(machines: DataFrame, entity: str, source: str, to: str) -> DataFrame:
    """A state diagram per entity; each is as long as its distinct moves."""
    line = F.concat(F.lit("  "), F.col(source), F.lit(" --> "), F.col(to))
    d = machines.select(entity, line.alias("line")).distinct().groupBy(entity).agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("body"))
    return d.select(entity, F.concat(F.lit("stateDiagram-v2\n"), F.col("body")).alias("diagram"))
