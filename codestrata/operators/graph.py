"""Level-synchronous traversals of the code graph.

Each level is one join of the frontier with the edges, one aggregation and one
anti-join with what was reached before; lineage is cut per level in the
reliable checkpoint folder. Only a level's emptiness is looked at by the
driver. Edge relations have `src`, `dst`, `origin`, `edge_kind`,
`evidence_kind`, `confidence` and `edge_id`; node relations `id`, `qn`,
`name`, `node_type`, `file_path` and more. Null ends of edges reach nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata import origins as O
from codestrata.runtime import cut_lineage

DECAY, HUB_SHARE, HUB_LEAST = 0.7, 0.99, 25
DEPTH, MAX_DEPTH, ITEMS, UNKNOWNS = 3, 6, 50, 50
INCLUDE = ("static", "framework", "dynamic_hint")
PATHS = 20
HOPS, WALK = 6, 15


def usable_edges(edges: DataFrame, nodes: DataFrame, include: tuple[str, ...] = INCLUDE) -> DataFrame:
    """Edges between known nodes that are no overlay, with effective confidence `conf`,
    `weight`, `admitted` (evidence asked for; scip rides with static) and `low`."""
    kinds = [*include, *(["scip"] if "static" in include else [])]
    known = nodes.select("id")
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & ~F.col("evidence_kind").isin(O.OVERLAYS))
    e = e.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    conf = O.confidence(F.col("origin"), F.col("confidence"))
    return e.withColumns({"conf": conf, "weight": O.weight(F.col("edge_kind")), "admitted": F.col("evidence_kind").isin(kinds), "low": conf < O.FLOW_FLOOR})


def in_degrees(edges: DataFrame) -> DataFrame:
    """`id`, `in_degree`: distinct callers of every called node."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("in_degree"))


def hub_threshold(degrees: DataFrame) -> DataFrame:
    """`threshold`, one row: the degree at index int(n * 0.99) in rising order, 25 at least.
    Degrees repeat a lot, so ranks come from their histogram, not from a sort of nodes."""
    histogram = degrees.groupBy("in_degree").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())
    upto = F.sum("n").over(W.orderBy("in_degree"))
    at = F.least(F.floor(total * HUB_SHARE), total - 1)
    return histogram.select("in_degree", (upto > at).alias("past")).where("past").agg(F.greatest(F.coalesce(F.min("in_degree"), F.lit(0)), F.lit(HUB_LEAST)).alias("threshold"))


def expand_seeds(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """`id` of the seeds and of the members of seeds that are classes."""
    own = nodes.join(seeds.select("id"), "id", "left_semi").where(F.col("node_type").isin("class", "db_model", "interface"))
    owner = own.select(F.col("file_path").alias("f"), F.concat("qn", F.lit(".")).alias("prefix"))
    members = nodes.join(owner, (F.col("file_path") == F.col("f")) & F.col("qn").startswith(F.col("prefix"))).select("id")
    return seeds.select("id").unionByName(members).distinct()


def kind_of(path: Column, node_type: Column) -> Column:
    return F.when(F.coalesce(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("")).rlike(O.TEST_PATH), "test").when(node_type.isin(O.ENTRY_KINDS), node_type).otherwise("symbol")


def impact_levels(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = DEPTH, include: tuple[str, ...] = INCLUDE) -> tuple[DataFrame, DataFrame]:
    """Who is affected by a change of the seeds: callers, callers of callers, and so on.

    First: `id`, `depth`, `score_sum`, `possible`, `parent` of every reached
    node, seeds at depth 0. All parents of a level add up; nodes reached
    earlier aren't reached again. Second: `kind`, `where_id`, `to_id` of what
    was not walked: hubs, nodes reached through doubtful edges only, and
    doubtful edges beyond the first level.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 1 to {MAX_DEPTH}")
    usable = usable_edges(edges, nodes, include).select("edge_id", "src", "dst", "conf", "weight", "low", "admitted", ((F.col("evidence_kind") == "dynamic_hint") | (F.col("edge_kind") == "dynamic_hint")).alias("hint"))
    usable = cut_lineage(usable)
    degrees = cut_lineage(in_degrees(usable))
    threshold = hub_threshold(degrees).first()[0]
    e = usable.where("admitted").drop("admitted")
    reached = cut_lineage(expand_seeds(nodes, seeds).select("id", F.lit(0).alias("depth"), F.lit(1.0).alias("score_sum"), F.lit(False).alias("possible"), F.lit(None).cast("long").alias("parent")))
    frontier, unknowns = reached, None
    for d in range(1, depth + 1):
        at = frontier.join(degrees, "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
        hub = (F.col("depth") > 0) & (F.col("in_degree") >= threshold)
        kind = F.when(hub, "hub_not_expanded").when(F.col("possible") & (F.col("in_degree") > 0), "possible_not_expanded")
        stopped = at.select(kind.alias("kind"), F.col("id").alias("where_id"), F.lit(None).cast("long").alias("to_id")).where("kind is not null")
        walked = at.where(~hub & ~F.col("possible")).select(F.col("id").alias("dst"), "score_sum", (F.col("depth") == 0).alias("seed"))
        steps = walked.join(e, "dst")
        doubtful = steps.where(F.col("low") & ~F.col("seed")).select(F.lit("low_confidence_edge_not_followed").alias("kind"), F.col("src").alias("where_id"), F.col("dst").alias("to_id"))
        unknowns = stopped.unionByName(doubtful) if unknowns is None else unknowns.unionByName(stopped).unionByName(doubtful)
        good = steps.where(~F.col("low") | F.col("seed")).withColumn("gain", F.col("score_sum") * F.col("weight") * F.col("conf"))
        best = F.max(F.struct(F.col("gain"), (-F.col("edge_id")).alias("k"), F.col("dst").alias("parent")))
        new = good.groupBy(F.col("src").alias("id")).agg(F.sum("gain").alias("score_sum"), F.bool_or(F.col("low") | F.col("hint")).alias("possible"), best["parent"].alias("parent"))
        frontier = cut_lineage(new.join(reached.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "score_sum", "possible", "parent"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached, unknowns.distinct()


def impact_items(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """`node`, `kind`, `score`, `depth`, `certainty` of the reached nodes."""
    far = reached.where("depth > 0").join(nodes, "id")
    score = F.round(F.least(F.lit(1.0), F.col("score_sum") * F.pow(F.lit(DECAY), F.col("depth") - 1)), 4)
    return far.select("id", F.col("qn").alias("node"), kind_of(F.col("file_path"), F.col("node_type")).alias("kind"), score.alias("score"), "depth", F.when(F.col("possible"), "possible").otherwise("likely").alias("certainty"), "parent")


def written_tables(nodes: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """What reached code writes: the same columns, of kind table."""
    e = usable_edges(edges, nodes).where("admitted and edge_kind = 'writes_table'")
    hit = reached.join(e, F.col("id") == F.col("src")).join(reached.select(F.col("id").alias("dst")), "dst", "left_anti")
    score = F.round(F.least(F.lit(1.0), F.col("score_sum") * F.col("conf") * F.pow(F.lit(DECAY), F.col("depth"))), 4)
    named = hit.join(nodes.select(F.col("id").alias("dst"), F.col("qn").alias("node")), "dst")
    return named.select(F.col("dst").alias("id"), "node", F.lit("table").alias("kind"), score.alias("score"), (F.col("depth") + 1).alias("depth"), F.when(F.col("conf") >= O.FLOW_FLOOR, "likely").otherwise("possible").alias("certainty"), F.col("src").alias("parent"))


def cap(items: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first `limit` items by `order`, with `rank`, `total` and `omitted`.
    The total comes from a count, the ranks from a top-k, so nothing is sorted whole."""
    total = items.agg(F.count("*").alias("total"))
    top = items.orderBy(*order).limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return ranked.join(F.broadcast(total)).withColumn("omitted", F.greatest(F.lit(0), F.col("total") - limit))


def trusted(edges: DataFrame) -> DataFrame:
    """Edges that flows may walk; overlays such as co-change are no calls."""
    return edges.where(~F.col("evidence_kind").isin(O.OVERLAYS) & O.followable(F.col("origin"), F.col("confidence")) & F.col("src").isNotNull() & F.col("dst").isNotNull())


def shortest_paths(edges: DataFrame, start: DataFrame, goal: DataFrame, max_depth: int = 4, limit: int = PATHS) -> DataFrame:
    """`path` (array of ids): all shortest paths from a start to a goal over the
    given edges, the first `limit` in order of their ids. Breadth first search
    meets every node at its least distance; paths are then read back from the
    goal through the distances, so no longer path is ever built."""
    e = cut_lineage(edges.select("src", "dst").distinct())
    reached = cut_lineage(start.select("id", F.lit(0).alias("d")))
    frontier, found = reached, None
    for d in range(1, max_depth + 1):
        nxt = frontier.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(reached.select("id"), "id", "left_anti").withColumn("d", F.lit(d))
        frontier = cut_lineage(nxt)
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if not frontier.join(goal.select("id"), "id", "left_semi").isEmpty():
            found = d
            break
    if found is None:
        return start.sparkSession.createDataFrame([], "path array<long>")
    paths = goal.select("id").join(reached.where(F.col("d") == found), "id").select(F.array("id").alias("path"))
    for d in range(found - 1, -1, -1):
        back = reached.where(F.col("d") == d).select(F.col("id").alias("p"))
        paths = paths.join(e, F.element_at("path", 1) == F.col("dst")).join(back, F.col("src") == F.col("p")).select(F.concat(F.array("src"), "path").alias("path"))
    return paths.orderBy("path").limit(limit)


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """`id`, `distance` of the nodes within `depth` steps in either direction."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a is not null and b is not null")
    out = start.select("id", F.lit(0).alias("distance"))
    last = out
    for d in range(1, depth + 1):
        last = last.join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct().join(out.select("id"), "id", "left_anti").withColumn("distance", F.lit(d))
        out = out.unionByName(last)
    return out


def slices(nodes: DataFrame, edges: DataFrame, entries: DataFrame, depth: int = O.FLOW_DEPTH) -> DataFrame:
    """`entry`, `id`, `depth`, `stop` of what each entry point runs, breadth
    first over followable edges: one traversal for all entries at once. `stop`
    tells why a branch ends there; null where it goes on."""
    e = cut_lineage(trusted(edges).join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct())
    reached = cut_lineage(entries.select(F.col("id").alias("entry"), "id", F.lit(0).alias("depth")))
    frontier = reached
    for d in range(1, depth + 1):
        nxt = frontier.join(e, F.col("id") == F.col("src")).select("entry", F.col("dst").alias("id")).distinct()
        frontier = cut_lineage(nxt.join(reached.select("entry", "id"), ["entry", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    onward = reached.join(e, F.col("id") == F.col("src")).select("entry", F.col("src").alias("id"), F.col("dst").alias("to"), F.col("depth").alias("from_depth"))
    child = onward.join(reached.select("entry", F.col("id").alias("to"), F.col("depth").alias("to_depth")), ["entry", "to"], "left").groupBy("entry", "id").agg(F.bool_or(F.col("to_depth") == F.col("from_depth") + 1).alias("has_child"))
    full = reached.join(out, "id", "left").join(child, ["entry", "id"], "left").join(nodes.select("id", "node_type"), "id", "left")
    stop = (
        F.when(F.col("has_child"), None).when(F.col("node_type") == "external_system", "external_boundary").when(F.col("node_type") == "db_model", "db_boundary")
        .when(F.col("n_out").isNull(), "leaf_no_callees").when(F.col("depth") >= depth, "depth_cap").otherwise("cycle")
    )
    return full.select("entry", "id", "depth", stop.alias("stop"))


def leaf_reasons(slices: DataFrame, unresolved: DataFrame) -> DataFrame:
    """The rows of slices() where `stop` of a leaf with calls that were not
    resolved (`caller_id`, `reason`) says so: dynamic ones first, then calls to
    systems outside, then others."""
    rank = F.min(F.when(F.col("reason") == "dynamic", 0).when(F.col("reason") == "external", 1).otherwise(2))
    u = unresolved.where("caller_id is not null").groupBy(F.col("caller_id").alias("id")).agg(rank.alias("_r"))
    leaf = F.when(F.col("_r") == 0, "dynamic_dispatch").when(F.col("_r") == 1, "external_boundary").when(F.col("_r") == 2, "unresolved_call").otherwise(F.col("stop"))
    return slices.join(u, "id", "left").select("entry", "id", "depth", F.when(F.col("stop") == "leaf_no_callees", leaf).otherwise(F.col("stop")).alias("stop"))


def unresolved_unknowns(nodes: DataFrame, unresolved: DataFrame, reached: DataFrame) -> DataFrame:
    """`caller_id`, `callee_name`, `reason`: calls by the name of something reached
    that were not resolved, so they may reach it too. Builtins and systems
    outside are none; callers that are reached anyway add nothing."""
    names = reached.select("id").join(nodes.select("id", "name"), "id").select(F.col("name").alias("_n")).distinct()
    u = unresolved.where(~F.col("reason").isin("builtin", "external")).withColumn("_n", F.regexp_extract("callee_name", r"([^.]+)$", 1))
    hit = u.join(names, "_n", "left_semi")
    return hit.join(reached.select(F.col("id").alias("caller_id")), "caller_id", "left_anti").select("caller_id", "callee_name", "reason").distinct()


def entry_links(edges: DataFrame, starts: DataFrame, entries: DataFrame, depth: int = HOPS) -> DataFrame:
    """`start`, `entry`, `hops`, `confidence`: the entry points from which a
    start is reached backwards, with the fewest hops and, over these, the
    greatest of the least confidences on the way. An entry ends its branch."""
    e = cut_lineage(trusted(edges).select("src", "dst", O.confidence(F.col("origin"), F.col("confidence")).alias("conf")).groupBy("src", "dst").agg(F.max("conf").alias("conf")))
    goal = entries.select(F.col("id").alias("id")).distinct().withColumn("is_entry", F.lit(True))
    reached = cut_lineage(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"), F.lit(1.0).alias("confidence")).join(goal, "id", "left").withColumn("is_entry", F.coalesce("is_entry", F.lit(False))))
    frontier = reached
    for d in range(1, depth + 1):
        step = frontier.where(~F.col("is_entry") | (F.col("hops") == 0)).join(e, F.col("id") == F.col("dst"))
        nxt = step.groupBy("start", F.col("src").alias("id")).agg(F.max(F.least("confidence", "conf")).alias("confidence"))
        nxt = nxt.join(reached.select("start", "id"), ["start", "id"], "left_anti").withColumn("hops", F.lit(d)).join(goal, "id", "left").withColumn("is_entry", F.coalesce("is_entry", F.lit(False)))
        frontier = cut_lineage(nxt.select(reached.columns))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.where("is_entry").select("start", F.col("id").alias("entry"), "hops", "confidence")


def dominant_walk(edges: DataFrame, start: DataFrame, signal: Column, longest: int = WALK) -> DataFrame:
    """`start`, `pos`, `id`: from each start always on to the successor with the
    greatest (signal, confidence, -edge id), until none is left or one repeats."""
    e = trusted(edges).withColumn("signal", signal).groupBy("src").agg(F.max(F.struct("signal", O.confidence(F.col("origin"), F.col("confidence")).alias("c"), (-F.col("edge_id")).alias("k"), "dst"))["dst"].alias("next"))
    e = cut_lineage(e)
    walk = start.select(F.col("id").alias("start"), F.array("id").alias("path"))
    for _ in range(longest - 1):
        on = walk.join(e, F.element_at("path", -1) == F.col("src"), "left")
        walk = on.select("start", F.when(F.col("next").isNotNull() & ~F.array_contains("path", F.col("next")), F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"))
    return walk.select("start", F.posexplode("path").alias("pos", "id"))


def propagate_up(parents: DataFrame, marked: DataFrame, steps: int = 64) -> DataFrame:
    """`id`, `reason`, `distance`: marked ids, and all their ancestors by (`id`,
    `parent`) with the reason of the nearest, then least, mark below."""
    reached = cut_lineage(marked.groupBy("id").agg(F.min("reason").alias("reason")).withColumn("distance", F.lit(0)))
    frontier = reached
    for d in range(1, steps + 1):
        up = frontier.join(parents, "id").where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.min("reason").alias("reason"))
        frontier = cut_lineage(up.join(reached.select("id"), "id", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def resolve_aliases(aliases: DataFrame, most: int = 32) -> DataFrame:
    """`id`, `target`, `hops` of every alias, followed to its end; `target` is
    null where the chain is a cycle or longer than `most`. Pointers double in
    length every round, so `most` hops take its logarithm in joins."""
    step = aliases.groupBy("id").agg(F.min("target").alias("target")).withColumn("hops", F.lit(1))
    reach, n = step, 1
    while n < most:
        b = reach.select(F.col("id").alias("target"), F.col("target").alias("t2"), F.col("hops").alias("h2"))
        reach = cut_lineage(reach.join(b, "target", "left").select("id", F.coalesce("t2", "target").alias("target"), (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops")))
        n *= 2
    again = step.select(F.col("id").alias("target"), F.lit(True).alias("goes_on"))
    done = reach.join(again, "target", "left")
    ok = F.col("goes_on").isNull() & (F.col("hops") <= most)
    return done.select("id", F.when(ok, F.col("target")).alias("target"), F.when(ok, F.col("hops")).alias("hops"))


def components(links: DataFrame, vertices: DataFrame) -> DataFrame:
    """`id`, `component` (the least id in it) of all vertices, by alternating
    large-star and small-star steps. Every step sends a vertex's links to the
    least neighbour, so no list of a component is ever gathered, and steps grow
    with the logarithm of a component's size."""
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        small = cut_lineage(small)
        same = e.exceptAll(small).isEmpty() and small.exceptAll(e).isEmpty()
        e = small
        if same:
            break
    return vertices.select("id").distinct().join(e.select(F.col("u").alias("id"), "v"), "id", "left").groupBy("id").agg(F.coalesce(F.min("v"), F.col("id")).alias("component"))
