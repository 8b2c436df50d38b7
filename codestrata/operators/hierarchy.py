"""Trees, closures and orders: paths back to a seed, ancestors, pages, menus, tours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata import origins as O
from codestrata.operators.graph import MAX_DEPTH, resolve_aliases, trusted
from codestrata.runtime import cut_lineage

TOUR_STEPS, TOUR_LEVELS = 15, 15


def best_paths(reached: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """`id`, `path` (ids from a node back to its seed) of every node that
    graph.impact_levels() reached: each step is the parent that gave it most."""
    back = cut_lineage(reached.select(F.col("id").alias("_id"), F.col("parent").alias("_up")))
    paths = reached.where("depth > 0").select("id", F.array("id", "parent").alias("path"))
    for _ in range(depth - 1):
        on = paths.join(back, F.element_at("path", -1) == F.col("_id"), "left")
        paths = on.select("id", F.when(F.col("_up").isNotNull(), F.array_append("path", F.col("_up"))).otherwise(F.col("path")).alias("path"))
    return paths


def ascend(parents: DataFrame, most: int = 64) -> DataFrame:
    """`id`, `ancestor`, `level` of (`id`, `parent`) over at most `most` steps,
    each ancestor at its least level. Nobody is its own ancestor, so cycles end."""
    one = cut_lineage(parents.where("parent is not null and id <> parent").select("id", F.col("parent").alias("ancestor")).distinct())
    step = one.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("_next"))
    out = level = one.withColumn("level", F.lit(1))
    for k in range(2, most + 1):
        nxt = level.join(step, "ancestor").where("id <> _next").select("id", F.col("_next").alias("ancestor")).distinct()
        level = cut_lineage(nxt.join(out.select("id", "ancestor"), ["id", "ancestor"], "left_anti").withColumn("level", F.lit(k)))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def aliases_of(aliases: DataFrame, pages: DataFrame) -> DataFrame:
    """`id`, `alias`: all names under which a page of `pages` (`id`) is known, its own first."""
    r = resolve_aliases(aliases).where("target is not null").select(F.col("target").alias("id"), F.col("id").alias("alias"))
    p = pages.select("id").distinct()
    return p.withColumn("alias", F.col("id")).unionByName(r.join(p, "id", "left_semi"))


def page_tree(pages: DataFrame) -> DataFrame:
    """`page_id`, `parent`, `depth`, `n_children` of module and file pages whose
    ids are paths: the parent is the longest folder above that has a page."""
    p = pages.select("page_id", F.substring_index("page_id", ":", 1).alias("type"), F.regexp_extract("page_id", r"^[^:]*:(.*)$", 1).alias("path")).distinct()
    parts = F.split("path", "/")
    up = p.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("path")))).alias("a"), F.col("path").alias("own"), "type").select("page_id", "a.depth", "a.path", "own", "type")
    folders = p.where("type = 'module'").select("path", F.col("page_id").alias("parent"))
    hit = up.where((F.col("path") != F.col("own"))).join(folders, "path")
    best = hit.groupBy("page_id").agg(F.max_by("parent", "depth").alias("parent"))
    tree = p.select("page_id", F.size(parts).alias("depth")).join(best, "page_id", "left")
    n = tree.where("parent is not null").groupBy(F.col("parent").alias("page_id")).agg(F.count("*").alias("n_children"))
    return tree.join(n, "page_id", "left").select("page_id", "parent", "depth", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))


def menu_tree(screens: DataFrame) -> DataFrame:
    """`label_path`, `level`, `n_screens`: every menu above a screen (`labels`,
    an array from the top) with the screens below it."""
    x = screens.select("labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("level")).where(F.size("labels") > 0)
    return x.groupBy(F.array_join(F.slice("labels", F.lit(1), F.col("level")), " / ").alias("label_path"), "level").agg(F.count("*").alias("n_screens"))


def common_root(paths: DataFrame, path: str) -> DataFrame:
    """`root`, one row: the folder that holds all paths; empty if there's none.
    What the least and the greatest path begin with, all between begin with."""
    ends = paths.agg(F.min(path).alias("a"), F.max(path).alias("b"))
    folders = lambda c: F.slice(F.split(c, "/"), F.lit(1), F.greatest(F.size(F.split(c, "/")) - 1, F.lit(0)))
    pairs = F.arrays_zip(folders(F.col("a")).alias("x"), folders(F.col("b")).alias("y"))
    same = F.aggregate(pairs, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("p")), lambda s, z: F.struct((s["on"] & z["x"].eqNullSafe(z["y"])).alias("on"), F.when(s["on"] & z["x"].eqNullSafe(z["y"]), F.array_append(s["p"], z["x"])).otherwise(s["p"]).alias("p")))["p"]
    return ends.select(F.coalesce(F.array_join(same, "/"), F.lit("")).alias("root"))


def cap_flows(slices: DataFrame, cap: int = O.FLOW_CAP) -> DataFrame:
    """The rows of graph.slices() with `stop` flow_cap where an entry has
    recorded `cap` ends before, in order of depth and id."""
    ends = F.count("stop").over(W.partitionBy("entry").orderBy("depth", "id").rowsBetween(W.unboundedPreceding, 0))
    return slices.withColumn("stop", F.when(F.col("stop").isNotNull() & (ends > cap), "flow_cap").otherwise(F.col("stop")))


def tours(nodes: DataFrame, edges: DataFrame, most: int = TOUR_STEPS, levels: int = TOUR_LEVELS) -> DataFrame:
    """`scan_id`, `domain`, `step`, `id`: in which order to read a domain: from
    its entry points on along trusted calls inside the domain, nearer ones
    first, among equals the surest call, then the name; at most `most` steps."""
    n = nodes.where("domain is not null").select("id", "scan_id", "domain", "qn", "node_type")
    a, b = n.select(F.col("id").alias("src"), "scan_id", "domain"), n.select(F.col("id").alias("dst"), F.col("scan_id").alias("_s"), F.col("domain").alias("_d"))
    e = trusted(edges).select("src", "dst", O.confidence(F.col("origin"), F.col("confidence")).alias("conf")).join(a, "src").join(b, "dst").where("scan_id = _s and domain = _d and src <> dst")
    e = cut_lineage(e.groupBy("src", "dst").agg(F.max("conf").alias("conf")))
    reached = level = cut_lineage(n.where(F.col("node_type").isin(O.ENTRY_KINDS)).select("id", F.lit(0).alias("level"), F.lit(1.0).alias("conf")))
    for k in range(1, levels + 1):
        nxt = level.select(F.col("id").alias("src")).join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.max("conf").alias("conf"))
        level = cut_lineage(nxt.join(reached.select("id"), "id", "left_anti").select("id", F.lit(k).alias("level"), "conf"))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    order = W.partitionBy("scan_id", "domain").orderBy("level", F.desc("conf"), "qn", "id")
    return reached.join(n, "id").withColumn("step", F.row_number().over(order)).where(F.col("step") <= most).select("scan_id", "domain", "step", "id")


def groups_by_domain(chunks: DataFrame) -> DataFrame:
    """`scan_id`, `file_path`, `community`: files grouped by the domain of their
    first chunk, where no links tell communities; files without one by their folder."""
    first = chunks.groupBy("scan_id", "file_path").agg(F.min(F.struct("chunk_id", "domain")).alias("f"))
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    return first.select("scan_id", "file_path", F.coalesce(F.col("f.domain"), F.concat(F.lit("dir:"), folder)).alias("community"))


def entry_edges(found: DataFrame, classes: DataFrame, methods: DataFrame, members: dict[str, list[str]]) -> DataFrame:
    """`kind`, `id`: what source registers to be run. found: `scan_id`, `kind`,
    `name` (a handler, or a class whose `members[kind]` are run)."""
    kinds = [(k, m) for k, ms in members.items() for m in ms]
    direct = found.join(methods.select("scan_id", "name", "id"), ["scan_id", "name"]).where(~F.col("kind").isin(list(members))).select("kind", "id")
    if not kinds:
        return direct.distinct()
    spark = found.sparkSession
    run = F.broadcast(spark.createDataFrame(kinds, "kind string, member string"))
    of = found.join(classes.select("scan_id", "name", F.col("qn").alias("class_qn")), ["scan_id", "name"]).join(run, "kind")
    m = methods.select("scan_id", F.col("qn").alias("_q"), "id")
    by_class = of.withColumn("_q", F.concat("class_qn", F.lit("."), "member")).join(m, ["scan_id", "_q"]).select("kind", "id")
    return direct.unionByName(by_class).distinct()


def relative(path: Column, root: str) -> Column:
    """A path below a root; others as they are. Null stays null."""
    r = root.rstrip("/") + "/"
    return F.when(path.startswith(r), F.substr(path, F.lit(len(r) + 1))).otherwise(path)
