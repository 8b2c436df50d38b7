"""Calls on receivers whose type is known: declared, returned by a call, or registered.

Sites are those of resolve.py. `variables` has `scan_id`, `scope` (qualified
name of a callable or class), `variable`, `type_name`; `symbols` has `id`,
`scan_id`, `qn`, `name`, `node_type`, `language`, `file_path`, `return_type`
and `extends_type` (null unless it extends a type); `bases` has `scan_id`,
`class_qn`, `base` (short name). Every step is an equi-join and a count of
candidates: one settles a site, several never do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata import origins as O
from codestrata.operators.resolve import owner
from codestrata.runtime import cut_lineage

INHERITED, CHAIN, REEXPORTS = 4, 3, 8
TYPE_KINDS = ("class", "interface", "db_model")


def short(name: Column) -> Column:
    """The last part of a type's name, without generics, arrays and marks of null."""
    return F.regexp_extract(F.regexp_replace(name, r"<.*$|\[.*$|[?*&\s]", ""), r"([^.:\\]+)$", 1)


def alone(found: DataFrame, key: list[str], value: str) -> DataFrame:
    """`key`, `n`, `value`: how many different values a key has, and the least."""
    return found.groupBy(*key).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value))


def classes_of(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("node_type").isin(*TYPE_KINDS)).select("scan_id", F.col("id").alias("class_id"), F.col("qn").alias("class_qn"), F.col("name").alias("type_short"), F.col("file_path").alias("class_file"), F.col("node_type").alias("class_kind"))


def receiver_types(sites: DataFrame, variables: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sites with `type_name` and `declared`: the type of their receiver's first
    part. What the callable declares shadows its class; a receiver that is a
    type's name is that type. Sites without a type keep a null."""
    head = F.regexp_replace("receiver", r"^(?:this|self)\.", "")
    s = sites.withColumns({"_head": head, "_class": owner(F.col("caller_qn"))})
    v = variables.groupBy("scan_id", "scope", "variable").agg(F.min("type_name").alias("t"))
    local = v.select("scan_id", F.col("scope").alias("caller_qn"), F.col("variable").alias("_head"), F.col("t").alias("_local"))
    field = v.select("scan_id", F.col("scope").alias("_class"), F.col("variable").alias("_head"), F.col("t").alias("_field"))
    known = classes_of(symbols).select("scan_id", F.col("type_short").alias("_head"), F.lit(True).alias("_is_type")).distinct()
    j = s.join(local, ["scan_id", "caller_qn", "_head"], "left").join(field, ["scan_id", "_class", "_head"], "left").join(known, ["scan_id", "_head"], "left")
    said = F.coalesce("_local", "_field")
    return j.select(*sites.columns, F.coalesce(said, F.when(F.col("_is_type"), F.col("_head"))).alias("type_name"), said.isNotNull().alias("declared"))


def chained_types(sites: DataFrame, variables: DataFrame, symbols: DataFrame, depth: int = CHAIN) -> DataFrame:
    """`site`, `type_name` of receivers that are calls, `a.find(x).first()`: the
    type of the head, then the return type of the one method of each link, up
    to `depth` links. What a link doesn't tell, or several methods tell, ends it."""
    calls = F.regexp_replace("receiver", r"\([^()]*\)", "()")
    s = sites.where(F.col("receiver").endswith(")")).withColumn("_links", F.split(calls, r"\."))
    s = s.where((F.size("_links") >= 2) & (F.size("_links") <= depth + 1))
    heads = receiver_types(s.withColumn("receiver", F.col("_links")[0]), variables, symbols)
    m = symbols.where("return_type is not null").select("scan_id", F.regexp_extract(owner(F.col("qn")), r"([^.]+)$", 1).alias("_short"), F.regexp_extract("qn", r"([^.]+)$", 1).alias("_method"), "return_type")
    m = alone(m, ["scan_id", "_short", "_method"], "return_type").where("n = 1").drop("n")
    at = heads.where("type_name is not null").select("site", "scan_id", "_links", short(F.col("type_name")).alias("_short"))
    done = None
    for k in range(1, depth + 1):
        link = F.regexp_replace(F.try_element_at("_links", F.lit(k + 1)), r"\(\)$", "")
        at = at.where(F.size("_links") > k).withColumn("_method", link).join(m, ["scan_id", "_short", "_method"]).select("site", "scan_id", "_links", short(F.col("return_type")).alias("_short"))
        end = at.where(F.size("_links") == k + 1).select("site", F.col("_short").alias("type_name"))
        done = end if done is None else done.unionByName(end)
    return done


def picked_types(typed: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """`site`, `class_id`, `class_qn`, `origin`, `n`: the type a site's type name
    means: the one of its own file, folder or imports, else the only one."""
    c = classes_of(symbols)
    folder = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    j = typed.where("type_name is not null").withColumn("type_short", short(F.col("type_name"))).join(c, ["scan_id", "type_short"])
    near = (F.col("file_path") == F.col("class_file")) | (folder(F.col("file_path")) == folder(F.col("class_file")))
    if imports is not None:
        i = imports.select("scan_id", "file_path", F.col("target_qn").alias("class_qn"), F.lit(True).alias("_imported")).distinct()
        j = j.join(i, ["scan_id", "file_path", "class_qn"], "left")
        near = near | F.coalesce("_imported", F.lit(False))
    n = j.groupBy("site").agg(F.count_distinct(F.when(near, F.col("class_id"))).alias("n_near"), F.count_distinct("class_id").alias("n"), F.min(F.when(near, F.struct("class_id", "class_qn"))).alias("_near"), F.min(F.struct("class_id", "class_qn")).alias("_any"))
    pick = F.when(F.col("n_near") == 1, F.col("_near")).when(F.col("n") == 1, F.col("_any"))
    return n.select("site", pick["class_id"].alias("class_id"), pick["class_qn"].alias("class_qn"), F.when(F.col("n_near") == 1, "receiver_typed").when(F.col("n") == 1, "receiver_global").alias("origin"), "n")


def type_references(sites: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Plain calls of a type's name, constructors mostly: `site`, `id`, `origin`
    of the settled ones, and `site`, `reason`, `n_candidates` of the others."""
    plain = sites.where("receiver is null").withColumn("type_name", F.col("name"))
    p = picked_types(plain, symbols, imports)
    good = p.where("class_id is not null").select("site", F.col("class_id").alias("id"), "origin")
    return good, p.where("class_id is null").select("site", F.lit("ambiguous").alias("reason"), F.col("n").alias("n_candidates"))


def ancestors(bases: DataFrame, symbols: DataFrame, most: int = INHERITED) -> DataFrame:
    """`scan_id`, `class_qn`, `base_qn`, `level`: the types of the store a type
    inherits from, over at most `most` steps, each at its nearest level. Cycles end."""
    c = classes_of(symbols).select("scan_id", F.col("type_short").alias("base"), F.col("class_qn").alias("base_qn"))
    one = cut_lineage(bases.select("scan_id", "class_qn", short(F.col("base")).alias("base")).distinct().join(c, ["scan_id", "base"]).where("class_qn <> base_qn").select("scan_id", "class_qn", "base_qn").distinct())
    out = level = one.withColumn("level", F.lit(1))
    step = one.select("scan_id", F.col("class_qn").alias("base_qn"), F.col("base_qn").alias("_next"))
    for k in range(2, most + 1):
        nxt = level.join(step, ["scan_id", "base_qn"]).where("class_qn <> _next").select("scan_id", "class_qn", F.col("_next").alias("base_qn")).distinct()
        level = cut_lineage(nxt.join(out.select("scan_id", "class_qn", "base_qn"), ["scan_id", "class_qn", "base_qn"], "left_anti").withColumn("level", F.lit(k)))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def on_ancestors(wanted: DataFrame, up: DataFrame, symbols: DataFrame) -> DataFrame:
    """`site`, `id`: of (`site`, `scan_id`, `class_qn`, `name`) the member of the
    nearest ancestor that has it, if that level has one only."""
    m = symbols.select("scan_id", "id", owner(F.col("qn")).alias("base_qn"), F.regexp_extract("qn", r"([^.]+)$", 1).alias("name"))
    hit = wanted.join(up, ["scan_id", "class_qn"]).join(m, ["scan_id", "base_qn", "name"])
    per = alone(hit, ["site", "level"], "id")
    return per.groupBy("site").agg(F.min(F.struct("level", "n", "id")).alias("b")).where("b.n = 1").select("site", "b.id")


def injected(candidates: DataFrame, registered: DataFrame, primary: DataFrame | None = None) -> DataFrame:
    """Of (`site`, `scan_id`, `interface`, `impl`, `project`, `id`) those the
    container would inject. registered: `scan_id`, `interface` (null: any),
    `impl`, `project`. A registration in the site's own project goes before
    one elsewhere; then a primary one; nothing registered keeps all."""
    r = registered.select("scan_id", F.col("interface").alias("_i"), "impl", F.col("project").alias("_p")).distinct()
    j = candidates.join(r, ["scan_id", "impl"], "left").where(F.col("_i").isNull() | (F.col("_i") == F.col("interface")))
    rank = F.when(F.col("_p").isNull(), 2).when(F.col("_p").eqNullSafe(F.col("project")), 0).otherwise(1)
    j = j.withColumn("_r", rank).groupBy(*candidates.columns).agg(F.min("_r").alias("_r"))
    if primary is not None:
        first = primary.select("scan_id", "impl", F.lit(-1).alias("_first")).distinct()
        j = j.join(first, ["scan_id", "impl"], "left").withColumn("_r", F.coalesce("_first", "_r")).drop("_first")
    best = F.min("_r").over(W.partitionBy("site"))
    return j.withColumn("_b", best).where("_r = _b").select(*candidates.columns)


def implementing(typed: DataFrame, bases: DataFrame, symbols: DataFrame, registered: DataFrame | None = None, cap: int = O.DISPATCH_CAP) -> tuple[DataFrame, DataFrame]:
    """Calls on an interface (`site`, `scan_id`, `type_name`, `name`, `file_path`)
    to the methods of types that name it as a base: one, by itself or by what
    is registered, is a framework binding; up to `cap` are dispatches. Methods
    are counted per interface and name first: beyond the cap sites meet those
    of registered types only."""
    m = symbols.select("scan_id", "id", owner(F.col("qn")).alias("class_qn"), F.regexp_extract("qn", r"([^.]+)$", 1).alias("name"))
    b = bases.select("scan_id", "class_qn", short(F.col("base")).alias("interface")).distinct()
    methods = b.join(m, ["scan_id", "class_qn"]).select("scan_id", "interface", "name", F.regexp_extract("class_qn", r"([^.]+)$", 1).alias("impl"), "id").distinct()
    methods = cut_lineage(methods)
    key = ["scan_id", "interface", "name"]
    n_all = methods.groupBy(*key).agg(F.count_distinct("id").alias("n_all"))
    project = F.split_part("file_path", F.lit("/"), F.lit(1))
    t = typed.where("type_name is not null").select("site", "scan_id", short(F.col("type_name")).alias("interface"), "name", project.alias("project")).join(n_all, key)
    columns = ["site", "scan_id", "interface", "impl", "project", "id"]
    hit = t.where(F.col("n_all") <= cap).join(methods, key).select(*columns)
    if registered is not None:
        known = methods.join(registered.select("scan_id", "impl").distinct(), ["scan_id", "impl"], "left_semi")
        hit = injected(hit.unionByName(t.where(F.col("n_all") > cap).join(known, key).select(*columns)), registered)
    n = hit.groupBy("site").agg(F.count_distinct("id").alias("n"))
    k = t.select("site", "n_all").join(n, "site", "left")
    chosen = F.col("n") < F.col("n_all")  # by registration
    told = k.where((F.col("n") == 1) | (F.col("n") == F.col("n_all")) & (F.col("n") <= cap))
    edges = told.join(hit.select("site", "id"), "site").select("site", "id", F.when(F.col("n") == 1, "framework").otherwise("dispatch").alias("origin"))
    rest = k.where(F.col("n").isNull() | (F.col("n") > 1) & (chosen | (F.col("n") > cap)))
    return edges, rest.select("site", F.when(F.coalesce(chosen, F.lit(False)), "di_ambiguous").otherwise("dispatch_cap").alias("reason"), F.coalesce("n", "n_all").alias("n_candidates")).distinct()


def extensions(typed: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls on a type outside the store to the one function of the language that extends it."""
    x = symbols.where("extends_type is not null").select("scan_id", "id", F.regexp_extract("qn", r"([^.]+)$", 1).alias("name"), F.lower("language").alias("language"), short(F.col("extends_type")).alias("type_short"))
    j = typed.where("declared").select("site", "scan_id", "name", F.lower("language").alias("language"), short(F.col("type_name")).alias("type_short")).join(x, ["scan_id", "name", "language", "type_short"])
    per = alone(j, ["site"], "id")
    return per.where("n = 1").select("site", "id", F.lit("receiver_typed").alias("origin")), per.where("n > 1").select("site", F.lit("ambiguous").alias("reason"), F.col("n").alias("n_candidates"))


def resolve_typed(sites: DataFrame, variables: DataFrame, symbols: DataFrame, bases: DataFrame, registered: DataFrame | None = None, imports: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All tiers for calls with a receiver. Settled: `site`, `id`, `origin`,
    `confidence`; others: `site`, `reason`, `n_candidates`.

    In order: the type's own member; the nearest ancestor's; an extension; the
    implementations. A type that several in the store may be is di_ambiguous;
    a declared type that isn't in the store and has no implementation there,
    or inherits from outside, is external; the rest is not_found. Sites whose
    receiver has no type are in neither result: later tiers may settle them.
    """
    direct = receiver_types(sites.where("receiver is not null"), variables, symbols)
    chain = chained_types(sites, variables, symbols).withColumnRenamed("type_name", "_chained")
    typed = direct.join(chain, "site", "left").withColumns({"declared": F.col("declared") | F.col("_chained").isNotNull(), "type_name": F.coalesce("type_name", "_chained")}).drop("_chained").where("type_name is not null")
    typed = cut_lineage(typed)
    pick = cut_lineage(picked_types(typed, symbols, imports))
    at = typed.join(pick.where("class_qn is not null"), "site")
    m = symbols.select("scan_id", "id", F.col("qn").alias("_target"))
    own = at.withColumn("_target", F.concat("class_qn", F.lit("."), "name")).join(m, ["scan_id", "_target"]).select("site", "id", "origin")
    up = cut_lineage(ancestors(bases, symbols))
    inherited = on_ancestors(at.select("site", "scan_id", "class_qn", "name"), up, symbols).withColumn("origin", F.lit("inherited"))
    ext, ext_rest = extensions(typed.join(pick.select("site"), "site", "left_anti"), symbols)
    impl, impl_rest = implementing(typed.join(pick.where("class_qn is null").select("site"), "site", "left_anti"), bases, symbols, registered)
    tiers = [own, inherited, ext, impl]
    ranked = reduce(DataFrame.unionByName, [d.withColumn("tier", F.lit(k)) for k, d in enumerate(tiers)])
    best = ranked.groupBy("site").agg(F.min("tier").alias("tier"))
    good = ranked.join(best, ["site", "tier"]).select("site", "id", "origin", O.confidence(F.col("origin"), F.lit(None).cast("double")).alias("confidence")).distinct()
    left = typed.join(best.select("site"), "site", "left_anti")
    said = ext_rest.unionByName(impl_rest).groupBy("site").agg(F.min(F.struct("reason", "n_candidates")).alias("_s"))
    own_bases = bases.select("scan_id", "class_qn", short(F.col("base")).alias("type_short")).distinct()
    foreign = own_bases.join(classes_of(symbols).select("scan_id", "type_short").distinct(), ["scan_id", "type_short"], "left_anti").select("scan_id", "class_qn", F.lit(True).alias("_foreign")).distinct()
    z = left.join(pick, "site", "left").join(said, "site", "left").join(foreign, ["scan_id", "class_qn"], "left")
    outside = F.col("n").isNull() & F.col("declared") | F.coalesce("_foreign", F.lit(False))
    reason = F.when(F.col("_s").isNotNull(), F.col("_s.reason")).when((F.col("n") > 1) & F.col("class_qn").isNull(), "di_ambiguous").when(outside, "external").otherwise("not_found")
    return good, z.select("site", reason.alias("reason"), F.coalesce(F.col("_s.n_candidates"), F.when(F.col("class_qn").isNull(), F.col("n")), F.lit(0).cast("long")).alias("n_candidates"))


def override_edges(bases: DataFrame, symbols: DataFrame, cap: int = O.DISPATCH_CAP) -> DataFrame:
    """`src`, `dst`: base methods to the methods of direct subtypes that override
    them, unless there are more than `cap`."""
    c = classes_of(symbols).select("scan_id", F.col("type_short").alias("base"), F.col("class_qn").alias("base_qn"))
    one = bases.select("scan_id", "class_qn", short(F.col("base")).alias("base")).distinct().join(c, ["scan_id", "base"]).where("class_qn <> base_qn")
    m = symbols.where(~F.col("node_type").isin(*TYPE_KINDS)).select("scan_id", "id", owner(F.col("qn")).alias("o"), F.regexp_extract("qn", r"([^.]+)$", 1).alias("name"))
    below = m.select("scan_id", F.col("id").alias("dst"), F.col("o").alias("class_qn"), "name")
    above = m.select("scan_id", F.col("id").alias("src"), F.col("o").alias("base_qn"), "name")
    pairs = one.join(below, ["scan_id", "class_qn"]).join(above, ["scan_id", "base_qn", "name"]).select("src", "dst").distinct()
    n = pairs.groupBy("src").agg(F.count("*").alias("n"))
    return pairs.join(n.where(F.col("n") <= cap), "src").select("src", "dst")


def relative_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """`importer`, `module`, `file`: relative modules (`./a`, `../b`) of a script
    to the first file that is there: the path itself, with an ending, or a
    folder's index."""
    parts = F.split(F.concat_ws("/", F.regexp_extract("importer", r"^(.*)/[^/]*$", 1), "module"), "/")
    # Going up drops the folder before; what is left of more than there are is no path.
    path = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "") | (p == "."), a).when((p == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.array_append(a, p)))
    base = F.array_join(path, "/")
    ends = ["", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".vue", "/index.js", "/index.ts", "/index.jsx", "/index.tsx"]
    want = imports.where(F.col("module").startswith(".")).select("importer", "module", F.posexplode(F.array(*[F.concat(base, F.lit(e)) for e in ends])).alias("k", "file"))
    return want.join(files.select("file").distinct(), "file").groupBy("importer", "module").agg(F.min_by("file", "k").alias("file"))


def reexported(exports: DataFrame, declared: DataFrame, depth: int = REEXPORTS) -> DataFrame:
    """`file`, `name`, `id`: what a file hands on, to where it is declared.
    exports: `file`, `name` (* for all), `source_name`, `source` (a file);
    declared: `file`, `name`, `id`. Followed up to `depth` files; a name that
    leads to several symbols is none, and cycles end."""
    named = exports.where("name <> '*'").select(F.col("file").alias("at"), F.col("name").alias("as"), F.col("source_name").alias("to"), F.col("source").alias("next"))
    star = exports.where("name = '*'").select(F.col("file").alias("at"), F.col("source").alias("next")).distinct()
    d = declared.select(F.col("file").alias("at"), F.col("name").alias("as"), "id")
    # Backwards from the declarations: who hands on what is known so far.
    known = cut_lineage(d.distinct())
    new = known
    for _ in range(depth):
        by_name = new.select(F.col("at").alias("next"), F.col("as").alias("to"), "id").join(named, ["next", "to"]).select("at", "as", "id")
        by_star = new.select(F.col("at").alias("next"), "as", "id").join(star, "next").select("at", "as", "id")
        new = cut_lineage(by_name.unionByName(by_star).distinct().join(known, ["at", "as", "id"], "left_anti"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return alone(known, ["at", "as"], "id").where("n = 1").select(F.col("at").alias("file"), F.col("as").alias("name"), "id")
