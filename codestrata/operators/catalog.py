"""What a scan knows of systems, flows, entities and its own precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata import origins as O
from codestrata.operators.graph import resolve_aliases
from codestrata.runtime import cut_lineage


def dependencies(externals: DataFrame, endpoints: DataFrame, keys: DataFrame) -> DataFrame:
    """`section`, `kind`, `n`: external systems by kind, endpoints by source,
    and foreign keys by table."""
    count = lambda df, section, kind: df.groupBy(F.coalesce(kind, F.lit("(none)")).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "kind", "n")
    return count(externals.select("name", "kind").distinct(), "external", F.col("kind")).unionByName(count(endpoints, "endpoint", F.col("source"))).unionByName(count(keys, "foreign_key", F.col("from_table")))


def integration_map(links: DataFrame) -> DataFrame:
    """`line` of a diagram of services that call each other, with how many routes."""
    n = links.groupBy("consumer", "provider").agg(F.count_distinct("route").alias("n"))
    return n.select(F.format_string("  %s -->|%d| %s", "consumer", "n", "provider").alias("line"))


def touches(slices: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`entry`, `reads`, `writes`, `calls_proc`, `external`: sorted names of the
    tables, procedures and systems that a flow's code touches; what is written
    isn't listed as read."""
    kind = F.when(F.col("edge_kind") == "writes_table", "writes").when(F.col("edge_kind") == "reads_table", "reads").when(F.col("edge_kind") == "calls_proc", "calls_proc").when(F.col("edge_kind") == "calls_external", "external")
    of = edges.where("dst is not null").select("src", "dst", kind.alias("_k")).join(nodes.select(F.col("id").alias("dst"), "qn", "node_type"), "dst")
    of = of.select(F.col("src").alias("id"), F.coalesce("_k", F.when(F.col("node_type") == "db_model", "reads"), F.when(F.col("node_type") == "external_system", "external")).alias("kind"), "qn").where("kind is not null").distinct()
    t = slices.select("entry", "id").join(of, "id").select("entry", "kind", "qn").distinct()
    sets = t.groupBy("entry").agg(*[F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("qn")))).alias(k) for k in ("reads", "writes", "calls_proc", "external")])
    return sets.withColumn("reads", F.array_except("reads", "writes"))


def flows_through(slices: DataFrame) -> DataFrame:
    """`id`, `n_flows`, `first`: how many flows run through a symbol, and the
    least of their entries."""
    return slices.select("entry", "id").distinct().groupBy("id").agg(F.count("*").alias("n_flows"), F.min("entry").alias("first"))


def event_log(walks: DataFrame, nodes: DataFrame) -> DataFrame:
    """`case_id`, `order`, `event_name`, `event_type` of walks (`start`, `pos`,
    `id`), as process mining takes them."""
    kind = F.when(F.col("node_type").isin(O.ENTRY_KINDS), "entry").when(F.col("node_type") == "db_model", "data").when(F.col("node_type") == "external_system", "external").otherwise("step")
    return walks.join(nodes.select("id", "name", "node_type"), "id").select(F.col("start").alias("case_id"), F.col("pos").alias("order"), F.col("name").alias("event_name"), kind.alias("event_type"))


def placeholder_machines(tables: DataFrame, states: DataFrame) -> DataFrame:
    """A machine without moves for every table that has none: `entity`, `states`, `confidence`."""
    return tables.select("entity").distinct().join(states.select("entity"), "entity", "left_anti").select("entity", F.array().cast("array<string>").alias("states"), F.lit(0.5).alias("confidence"))


def display_names(machines: DataFrame) -> DataFrame:
    """`entity`, `display`: the name, with the entity's folder or class where several have it."""
    several = F.count("*").over(W.partitionBy("name")) > 1
    owner = F.regexp_extract("entity", r"^(.*)[./][^./]+$", 1)
    return machines.select("entity", F.when(several & (owner != ""), F.concat("name", F.lit(" ("), owner, F.lit(")"))).otherwise(F.col("name")).alias("display"))


def canonical(machines: DataFrame, group: str, priority: Column) -> DataFrame:
    """`group`, `entity`, `name`: of the machines of a group the one with the
    least priority, then the shortest name, then the first."""
    return machines.groupBy(group).agg(F.min(F.struct(priority.alias("p"), F.length("name").alias("l"), F.col("name").alias("name"), F.col("entity").alias("entity"))).alias("b")).select(group, "b.entity", "b.name")


def contained_in(small: DataFrame, large: DataFrame, block: list[str]) -> DataFrame:
    """`a`, `b`, `n_a`, `n_b`: sets of machines without a class (`a`, `states`)
    all of whose states belong to a machine with one (`b`, `states`) of the same
    block. Equal sets of a side stand as one, by their least key, with how many
    they are. A set is looked for by its rarest state only, so pairs without a
    state in common are never made; empty sets are in nothing."""
    classes = lambda df, k, n: df.select(*block, k, F.sort_array(F.array_distinct("states")).alias("_s")).where(F.size("_s") > 0).groupBy(*block, "_s").agg(F.min(k).alias(k), F.count("*").alias(n))
    x = cut_lineage(classes(small, "a", "n_a").withColumnRenamed("_s", "_x"))
    y = cut_lineage(classes(large, "b", "n_b").withColumnRenamed("_s", "_y"))
    each = y.select(*block, "b", F.explode("_y").alias("_z"))
    rare = each.groupBy(*block, "_z").agg(F.count("*").alias("_n"))
    pick = x.select(*block, "a", F.explode("_x").alias("_z")).join(rare, [*block, "_z"], "left").groupBy(*block, "a").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_z").alias("z"))).alias("_p"))
    cand = pick.where("_p.n > 0").select(*block, "a", F.col("_p.z").alias("_z")).join(each, [*block, "_z"]).select(*block, "a", "b")
    return cand.join(x, [*block, "a"]).join(y, [*block, "b"]).where(F.size(F.array_except("_x", "_y")) == 0).select("a", "b", "n_a", "n_b")


def precision_check(graded: DataFrame, emitted: DataFrame, recorded: DataFrame | None = None, drift: float = 0.2) -> DataFrame:
    """`stratum`, `n`, `matched`, `correct`, `precision`, `drifted`: graded edges
    (`src`, `name`, `stratum`, `dst`, `ok`) against those emitted now (`src`,
    `name`, `dst`). An edge that isn't emitted any more can't be judged; more
    than `drift` of them, or less precision than `recorded` (`stratum`,
    `lower`), marks the stratum."""
    now = emitted.select("src", "name", "dst").distinct().withColumn("_there", F.lit(True))
    j = graded.join(now, ["src", "name", "dst"], "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    g = j.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("_there").alias("matched"), F.count_if(F.col("_there") & F.col("ok")).alias("correct"))
    g = g.withColumn("precision", F.round(F.try_divide("correct", "matched"), 6))
    lost = F.col("n") - F.col("matched") > drift * F.col("n")
    if recorded is not None:
        g = g.join(recorded.select("stratum", "lower"), "stratum", "left")
        lost = lost | F.coalesce(F.col("precision") < F.col("lower"), F.lit(False))
    return g.select("stratum", "n", "matched", "correct", "precision", lost.alias("drifted"))


def missing_and_extra(found: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """`key`, `side`: what is wanted and not found (missing), or the contrary (extra)."""
    f, w = found.select(*key).distinct(), wanted.select(*key).distinct()
    return w.exceptAll(f).withColumn("side", F.lit("missing")).unionByName(f.exceptAll(w).withColumn("side", F.lit("extra")))


def forbidden_edges(edges: DataFrame, forbidden: DataFrame) -> DataFrame:
    """`n`, `n_absent`, `score` of edges that must not be there (`caller_suffix`,
    `callee_suffix`): names agree from a dot on. Without any the score is 1."""
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda k: F.array_join(F.slice(F.split(c, r"\."), k, F.size(F.split(c, r"\."))), "."))
    e = edges.select(F.explode(tails(F.col("caller"))).alias("caller_suffix"), "callee").select("caller_suffix", F.explode(tails(F.col("callee"))).alias("callee_suffix"))
    hit = e.join(F.broadcast(forbidden.select("caller_suffix", "callee_suffix").distinct()), ["caller_suffix", "callee_suffix"]).distinct().withColumn("_hit", F.lit(True))
    j = forbidden.join(hit, ["caller_suffix", "callee_suffix"], "left")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("_hit").isNull()).alias("n_absent")).withColumn("score", F.coalesce(F.try_divide("n_absent", "n"), F.lit(1.0)))


def file_scores(changed: DataFrame, gold: DataFrame) -> DataFrame:
    """`task`, `n_changed`, `n_gold`, `n_both`, `precision`, `recall` of the files of a task."""
    c, g = changed.select("task", "file").distinct().withColumn("_c", F.lit(1)), gold.select("task", "file").distinct().withColumn("_g", F.lit(1))
    j = c.join(g, ["task", "file"], "full_outer").groupBy("task").agg(F.count("_c").alias("n_changed"), F.count("_g").alias("n_gold"), F.count_if(F.col("_c").isNotNull() & F.col("_g").isNotNull()).alias("n_both"))
    ratio = lambda d: F.round(F.coalesce(F.try_divide(F.col("n_both"), F.col(d)), F.lit(0.0)), 6)
    return j.select("*", ratio("n_changed").alias("precision"), ratio("n_gold").alias("recall"))


def interfaces(nodes: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a repository offers (`slug`, `method`, `route`, `handler`) and what it
    calls (`slug`, `method`, `route`, `caller`). nodes have `slug` and `route`,
    sites `slug`, `caller`, `name` (a client's method) and `target` (an address)."""
    from codestrata.operators.text import normal_url

    verb = lambda c: F.upper(F.regexp_extract(F.lower(c), r"(get|post|put|delete|patch|head)", 1))
    offered = nodes.where("route is not null and route <> ''").select("slug", F.coalesce(F.nullif(verb(F.col("name")), F.lit("")), F.lit("GET")).alias("method"), normal_url(F.col("route")).alias("route"), F.col("qn").alias("handler"))
    called = sites.where(F.col("target").rlike(r"^(?:https?:/)?/")).select("slug", F.coalesce(F.nullif(verb(F.col("name")), F.lit("")), F.lit("GET")).alias("method"), normal_url(F.col("target")).alias("route"), "caller")
    return offered.distinct(), called.distinct()


def entity_services(entities: DataFrame, uses: DataFrame) -> DataFrame:
    """`entity`, `repositories`, `services`: who stores an entity, and who uses
    those. entities: `entity`, `repository`; uses: `user`, `used`."""
    s = uses.select(F.col("used").alias("repository"), F.col("user").alias("service"))
    j = entities.join(s, "repository", "left")
    return j.groupBy("entity").agg(F.sort_array(F.collect_set("repository")).alias("repositories"), F.sort_array(F.collect_set("service")).alias("services"))


def anchored(notes: DataFrame, aliases: DataFrame, anchors: DataFrame) -> DataFrame:
    """Notes of the asked `anchors` (`anchor`), also those written to a name the
    anchor had before: notes with `anchor`, where they are read now."""
    now = resolve_aliases(aliases).where("target is not null").select(F.col("id").alias("_was"), F.col("target").alias("_now"))
    j = notes.withColumnRenamed("anchor", "_was").join(now, "_was", "left").withColumn("anchor", F.coalesce("_now", "_was"))
    return j.join(anchors.select("anchor").distinct(), "anchor", "left_semi").select("anchor", *[c for c in notes.columns if c != "anchor"])


def successors(edges: DataFrame, signal: Column) -> DataFrame:
    """`src`, `dst`: where a flow mainly goes on: the strongest signal, then the surest edge, then the first."""
    e = edges.where("src is not null and dst is not null").withColumn("_s", signal)
    return e.groupBy("src").agg(F.max(F.struct("_s", O.confidence(F.col("origin"), F.col("confidence")).alias("c"), (-F.col("edge_id")).alias("k"), "dst"))["dst"].alias("dst"))
