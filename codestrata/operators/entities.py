"""Entry points, entity kinds, registries, guards and screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata import origins as O
from codestrata.operators.rollups import jaccard
from codestrata.runtime import cut_lineage

# Weights of entry-point signals and the score from which one counts.
STRONG, UNCALLED, NAMED, PUBLIC, FANS_OUT, THRESHOLD = 0.8, 0.2, 0.2, 0.1, 0.1, 0.5
ENTRY_NAMES = r"(?i)^(?:main|run|start|execute|handle\w*|on[A-Z]\w*|process\w*|consume\w*|listen\w*|serve\w*)$"


def is_public(language: Column, name: Column) -> Column:
    """By the language's own custom: a capital in Go, no leading underscore elsewhere."""
    return F.when(F.lower(language) == "go", name.rlike("^[A-Z]")).otherwise(~name.rlike("^_"))


def entry_points(nodes: DataFrame, signals: DataFrame) -> DataFrame:
    """`id`, `score`, `evidence` of likely entry points. signals: `id`, `prod_in`, `fan_out`. Tests, models and external systems are none."""
    n = nodes.where(~F.coalesce(F.col("file_path").rlike(O.TEST_PATH), F.lit(False)) & ~F.col("node_type").isin("db_model", "external_system", "config", "module")).join(signals, "id")
    strong = F.when(F.col("node_type").isin(O.ENTRY_KINDS), F.col("node_type")).when(F.coalesce(F.col("annotations"), F.lit("")).rlike(r"(?i)route|mapping|scheduled|listener|consumer"), "annotation")
    parts = [(strong.isNotNull(), STRONG), (F.col("prod_in") == 0, UNCALLED), (F.col("name").rlike(ENTRY_NAMES), NAMED), (is_public(F.col("language"), F.col("name")), PUBLIC), (F.col("fan_out") >= 2, FANS_OUT)]
    score = F.least(F.lit(1.0), sum((F.when(c, w).otherwise(0.0) for c, w in parts), F.lit(0.0)))
    return n.select("id", "qn", F.round(score, 4).alias("score"), F.coalesce(strong, F.lit("signals")).alias("evidence")).where(F.col("score") >= THRESHOLD)


# Kinds of entities in the order they are tried, with confidence.
def entity_kind(name: Column, states: Column, n_fields: Column) -> Column:
    """struct<kind, confidence> of an entity by its name, its states and its fields."""
    n = F.size(states)
    pick = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"))
    return (
        F.when(name.rlike(r"(?i)(?:view|projection|read_?model)$"), pick("projection", 0.9))
        .when(name.rlike(r"(?i)(?:dto|request|response|payload|form)$"), pick("transfer", 0.9))
        .when(name.rlike(r"(?i)(?:log|audit|history|event)$"), pick("log", 0.85))
        .when(name.rlike(r"(?i)(?:config|settings?|option)s?$"), pick("configuration", 0.85))
        .when((n >= 3) & F.exists(states, lambda s: F.lower(s).rlike("cancel|reject|fail|clos|done|complete")), pick("workflow", 0.9))
        .when(n >= 2, pick("stateful", 0.8)).when(name.rlike(r"(?i)(?:_|^)(?:map|link|rel)(?:_|$)|[a-z](?:Map|Link)$"), pick("association", 0.7))
        .when(n_fields >= 2, pick("record", 0.6)).otherwise(pick("unknown", 0.3))
    )


def edge_mode(callee: Column, edge_kind: Column) -> Column:
    """sync or async, by what is called."""
    return F.when(edge_kind.isin("event_emit") | F.lower(callee).rlike(r"async|publish|emit|enqueue|dispatch|schedule|notify|queue|kafka|rabbit"), "async").otherwise("sync")


def step_score(depth: Column, transition: Column, data: Column, external: Column, reads_back: Column) -> Column:
    """How telling a step of a slice is."""
    return F.greatest(F.lit(0), 5 - depth) + F.when(transition, 4).otherwise(0) + F.when(data, 3).otherwise(0) + F.when(external, 2).otherwise(0) + F.when(reads_back, 3).otherwise(0)


# Client libraries and the system behind them.
CLIENTS = {"axios": "http", "fetch": "http", "requests": "http", "httpclient": "http", "resttemplate": "http", "webclient": "http", "kafka": "queue", "rabbit": "queue", "amqp": "queue", "redis": "cache", "memcache": "cache", "s3": "storage", "boto3": "cloud", "stripe": "payment", "smtp": "mail", "mailer": "mail", "elastic": "search", "mongo": "database"}


def external_systems(sites: DataFrame) -> DataFrame:
    """`site`, `client`, `kind` of the calls whose receiver names a client library."""
    d = sites.sparkSession.createDataFrame(list(CLIENTS.items()), "client string, kind string")
    seg = sites.select("site", F.explode(F.split(F.lower("receiver"), r"[._]")).alias("client")).distinct()
    return seg.join(F.broadcast(d), "client").select("site", "client", "kind")


def precise_lookup(sites: DataFrame, index: DataFrame) -> DataFrame:
    """`site`, `callee` by a precise symbol index (`caller`, `call`, `receiver`, `callee`, `pos`): the entry with the site's receiver, else the first."""
    j = sites.select("site", F.col("caller_qn").alias("caller"), F.col("name").alias("call"), F.col("receiver").alias("want")).join(index, ["caller", "call"])
    k = F.row_number().over(W.partitionBy("site").orderBy(F.when(F.col("receiver").eqNullSafe(F.col("want")), 0).when(F.col("receiver").isNull(), 1).otherwise(2), "pos"))
    return j.withColumn("_k", k).where("_k = 1").select("site", "callee")


def statement_edges(statements: DataFrame, methods: DataFrame) -> DataFrame:
    """Mapper methods to the statements of the same qualified name: `src`, `dst`."""
    return methods.select(F.col("id").alias("src"), "qn").join(statements.select(F.col("id").alias("dst"), F.regexp_replace("qn", "^mybatis::", "").alias("qn")), "qn").select("src", "dst")


def procedure_edges(calls: DataFrame, procedures: DataFrame) -> DataFrame:
    """`src`, `proc`, `defined` of calls to stored procedures by name; those nobody defines stay, marked."""
    key = lambda c: F.lower(F.regexp_replace(F.substring_index(c, ".", -1), r"[^A-Za-z0-9_]", ""))
    p = procedures.select(key(F.col("name")).alias("proc")).distinct().withColumn("_d", F.lit(True))
    return calls.select("src", key(F.col("name")).alias("proc")).distinct().join(p, "proc", "left").select("src", "proc", F.coalesce("_d", F.lit(False)).alias("defined"))


def table_access(facts: DataFrame) -> DataFrame:
    """`caller`, `table`, `access` of statements (`caller`, `reads`, `writes`), each once."""
    r = facts.select("caller", F.explode("reads").alias("table"), F.lit("reads_table").alias("access"))
    return r.unionByName(facts.select("caller", F.explode("writes").alias("table"), F.lit("writes_table").alias("access"))).distinct()


def sql_tables(facts: DataFrame) -> DataFrame:
    """`table` with columns, operations, first file, and whether it is a view (a view wins)."""
    return facts.groupBy("table").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("columns")))).alias("columns"), F.sort_array(F.collect_set("op")).alias("ops"), F.min("file").alias("file"), F.bool_or("is_view").alias("is_view"))


def foreign_keys(ddl: DataFrame) -> DataFrame:
    """`from_table`, `column`, `to_table`, `to_column` of keys given as lists, by position."""
    z = ddl.select("from_table", "to_table", F.explode(F.arrays_zip("columns", "to_columns")).alias("z"))
    return z.select("from_table", F.col("z.columns").alias("column"), "to_table", F.col("z.to_columns").alias("to_column")).distinct()


def guards(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """`id`, `entity`, `field`, `op`, `value`: what conditions say about other entities (`lhs.field op value`), by entity name."""
    p = r"\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*(==|!=|>=|<=|>|<|=)\s*['\"]?([\w.]+)"
    parts = [F.regexp_extract_all("guard", F.lit(p), F.lit(g)) for g in (1, 2, 3, 4)]
    x = rows.select("id", F.explode(F.arrays_zip(*[c.alias(n) for c, n in zip(parts, ("lhs", "field", "op", "value"))])).alias("z")).select("id", "z.*")
    return x.join(entities.select(F.lower("name").alias("_n"), F.col("entity")), F.lower("lhs") == F.col("_n")).select("id", "entity", "field", "op", "value")


def screen_uses(screens: DataFrame, nodes: DataFrame) -> DataFrame:
    """`screen`, `id`, `confidence`: screens that use a symbol, by class, by class
    and method, or by route: three equi-joins, the best of which counts.
    screens: `screen`, `class_name`, `method`, `route`, `confidence`."""
    owner = F.regexp_extract("qn", r"^(.*)\.[^.]+$", 1)
    n = nodes.select("id", "qn", "name", owner.alias("owner"), F.regexp_extract(owner, r"([^.]+)$", 1).alias("short"), F.col("route").alias("_route") if "route" in nodes.columns else F.lit(None).cast("string").alias("_route"))
    s = screens.withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
    hits = [s.join(n, s["class_name"] == n["qn"]), s.join(n, s["class_name"] == n["name"]), s.join(n, s["class_name"] == n["owner"]).where("method is null or method = name"), s.join(n, s["class_name"] == n["short"]).where("method is null or method = name"), s.join(n, s["route"] == n["_route"])]
    out = None
    for h in hits:
        h = h.select("screen", "id", "confidence")
        out = h if out is None else out.unionByName(h)
    return out.groupBy("screen", "id").agg(F.max("confidence").alias("confidence"))


def screen_chain(screens: DataFrame, apis: DataFrame, controllers: DataFrame, services: DataFrame, tables: DataFrame) -> DataFrame:
    """`screen` with what lies behind it: apis, controllers, services and tables, each as a sorted list."""
    j = screens.join(apis, "component", "left").join(controllers, "api", "left").join(services, "controller", "left").join(tables, "service", "left")
    return j.groupBy("screen").agg(*[F.sort_array(F.collect_set(c)).alias(c + "s") for c in ("api", "controller", "service", "table")])


def federated(machines: DataFrame, threshold: float = 0.7) -> DataFrame:
    """`stem`, `repo`, `entity`, `group`: machines of several repositories with
    the same stem whose states overlap. Taken in order of repository and name,
    each joins the first group whose first member is like enough.

    One round finds the next first member of every stem and all that join it,
    which gives the same groups as going through a stem one by one, and no stem
    is gathered. Two machines without states are alike.
    """
    rest = cut_lineage(machines.select("stem", "repo", "entity", "states").distinct())
    out, number = None, 0
    while not rest.isEmpty():
        first = rest.groupBy("stem").agg(F.min_by("states", F.struct("repo", "entity")).alias("_lead"), F.min(F.struct("repo", "entity")).alias("_who"))
        j = rest.join(first, "stem").withColumn("_in", (jaccard(F.col("states"), F.col("_lead"), 1.0) >= threshold) | (F.struct("repo", "entity") == F.col("_who")))
        j = cut_lineage(j)
        got = j.where("_in").select("stem", "repo", "entity", F.lit(number).alias("group"))
        out = got if out is None else out.unionByName(got)
        rest = j.where("not _in").select("stem", "repo", "entity", "states")
        number += 1
    return out if out is not None else machines.select("stem", "repo", "entity", F.lit(0).alias("group")).limit(0)


def merge_federated(machines: DataFrame, groups: DataFrame) -> DataFrame:
    """`stem`, `group`, `states`, `confidence`, `origins`: each group of
    federated() as one machine with all states, the least confidence, and a map
    of repository to entity. Of several entities of a repository the first counts."""
    j = groups.join(machines, ["stem", "repo", "entity"])
    states = j.select("stem", "group", F.explode_outer("states").alias("s")).distinct().groupBy("stem", "group").agg(F.sort_array(F.collect_list("s")).alias("states"))
    one = j.groupBy("stem", "group", "repo").agg(F.min("entity").alias("entity"), F.min("confidence").alias("c"))
    who = one.groupBy("stem", "group").agg(F.min("c").alias("confidence"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("repo", "entity")))).alias("origins"))
    return states.join(who, ["stem", "group"])


def merge_links(links: DataFrame, key: list[str]) -> DataFrame:
    """Of mined links found in several repositories the one with the most support; the first of equals."""
    k = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("support"), "repo"))
    return links.withColumn("_k", k).where("_k = 1").drop("_k")


def field_matches(found: DataFrame, wanted: DataFrame, least: float = 0.5) -> DataFrame:
    """`entity`, `f1`: entities of which the fields found and wanted agree well enough."""
    j = wanted.select("entity", F.col("fields").alias("w")).join(found.select("entity", F.col("fields").alias("f")), "entity", "left")
    hit = F.size(F.array_intersect("w", F.coalesce("f", F.array().cast("array<string>"))))
    f1 = F.coalesce(F.try_divide(2 * hit, F.size("w") + F.size("f")), F.lit(0.0))
    return j.select("entity", F.round(f1, 6).alias("f1")).where(F.col("f1") >= least)


def key_edge_recall(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """`n`, `n_found`, `recall` of wanted edges (`callee_suffix`, `min_confidence`) among edges (`callee`, `confidence`); without any, recall is 1."""
    tail = edges.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("callee", r"\."))), lambda k: F.array_join(F.slice(F.split("callee", r"\."), k, F.size(F.split("callee", r"\."))), "."))).alias("callee_suffix"), "confidence")
    best = tail.groupBy("callee_suffix").agg(F.max("confidence").alias("c"))
    j = wanted.join(best, "callee_suffix", "left")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("c") >= F.coalesce("min_confidence", F.lit(0.0))).alias("n_found")).withColumn("recall", F.coalesce(F.try_divide("n_found", "n"), F.lit(1.0)))


def cells(runs: DataFrame) -> DataFrame:
    """`task`, `arm` with the mean of their runs."""
    return runs.groupBy("task", "arm").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def token_overlap(a: Column, b: Column) -> Column:
    return jaccard(a, b, 1.0)
