"""Which symbol a call site means: ordered tiers, unique or unresolved.

Sites have `site`, `scan_id`, `caller_qn`, `file_path`, `name`, `receiver`
(null for a plain call) and `language`; symbols `id`, `scan_id`, `qn`, `name`,
`file_path`, `language`, `node_type`. A tier that finds one symbol settles the
site; one that finds several makes it ambiguous, and no later tier guesses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata import origins as O

# Names every language brings along.
BUILTINS = ["print", "len", "range", "append", "add", "get", "set", "put", "push", "map", "filter", "toString", "equals", "hashCode", "close", "printf", "Println", "Errorf"]


def owner(qn):
    return F.regexp_extract(qn, r"^(.*)\.[^.]+$", 1)


def tiers(sites: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, bases: DataFrame | None = None) -> DataFrame:
    """`site`, `tier`, `origin`, `id`, `n`: how many symbols each tier finds for a
    site, and the least. Symbols are counted per key before they meet sites, so
    a name that very many symbols have costs a site one row.

    imports: `scan_id`, `file_path`, `name`, `target_qn`, `exact`;
    bases: `scan_id`, `class_qn`, `base_qn`, followed up to four times.
    """
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    s = symbols.select("scan_id", "id", "qn", "name", "file_path", owner(F.col("qn")).alias("own"), folder("file_path").alias("dir"), F.lower("language").alias("lang"))
    s = s.withColumn("short", F.regexp_extract("own", r"([^.]+)$", 1))
    per = lambda *key: s.groupBy("scan_id", *key).agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    site = sites.withColumns({"own": owner(F.col("caller_qn")), "dir": folder("file_path"), "lang": F.lower("language")})
    out = []

    def add(df: DataFrame, tier: int, origin) -> None:
        out.append(df.select("site", F.lit(tier).alias("tier"), origin.alias("origin"), "id", "n"))

    me, plain = site.where(F.col("receiver").isNull() | F.col("receiver").isin("self", "this")), site.where(F.col("receiver").isNull())
    add(me.join(per("own", "name"), ["scan_id", "own", "name"]), 1, F.lit("self_scope"))
    if imports is not None:
        i = imports.select("scan_id", "file_path", "name", F.col("target_qn").alias("qn"), "exact").groupBy("scan_id", "file_path", "name", "qn").agg(F.bool_or("exact").alias("exact"))
        add(site.join(i, ["scan_id", "file_path", "name"]).join(per("qn"), ["scan_id", "qn"]), 2, F.when(F.col("exact"), "import_exact").otherwise("import_module"))
    add(site.where("receiver is not null").join(per("short", "name").withColumnRenamed("short", "receiver"), ["scan_id", "receiver", "name"]), 3, F.lit("receiver_typed"))
    if bases is not None:
        one = bases.select("scan_id", "class_qn", "base_qn").distinct()
        up = level = one.withColumn("level", F.lit(1))
        for k in range(2, 5):
            level = level.join(one.select("scan_id", F.col("class_qn").alias("base_qn"), F.col("base_qn").alias("next")), ["scan_id", "base_qn"]).select("scan_id", "class_qn", F.col("next").alias("base_qn"), F.lit(k).alias("level")).distinct()
            up = up.unionByName(level)
        up = up.groupBy("scan_id", F.col("class_qn").alias("own"), "base_qn").agg(F.min("level").alias("level"))
        members = per("own", "name").withColumnRenamed("own", "base_qn")
        found = me.join(up, ["scan_id", "own"]).join(members, ["scan_id", "base_qn", "name"])
        near = found.groupBy("site").agg(F.min("level").alias("level"))
        add(found.join(near, ["site", "level"]), 4, F.lit("inherited"))
    add(plain.join(per("file_path", "name"), ["scan_id", "file_path", "name"]), 5, F.lit("same_file"))
    add(plain.join(per("dir", "name"), ["scan_id", "dir", "name"]), 6, F.lit("same_package"))
    g = per("name", "lang").withColumnsRenamed({"scan_id": "_s", "name": "_n", "lang": "_l"})
    same = (F.col("scan_id") == F.col("_s")) & (F.col("name") == F.col("_n")) & F.col("lang").eqNullSafe(F.col("_l"))
    add(site.join(g, same), 7, F.when(F.col("receiver").isNull(), "global_unique").otherwise("receiver_global"))
    return reduce(DataFrame.unionByName, out)


def resolve(sites: DataFrame, symbols: DataFrame, imports: DataFrame | None = None, bases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Resolved: `site`, `id`, `origin`, `confidence`. Unresolved: `site`,
    `reason`, `n_candidates`, with one reason of the closed list."""
    per = tiers(sites, symbols, imports, bases).groupBy("site", "tier").agg(F.sum("n").alias("n"), F.min("id").alias("id"), F.min("origin").alias("origin"))
    first = per.groupBy("site").agg(F.min(F.struct("tier", "n", "id", "origin")).alias("b")).select("site", "b.*")
    good = first.where("n = 1").select("site", "id", "origin", O.confidence(F.col("origin"), F.lit(None).cast("double")).alias("confidence"))
    rest = sites.join(good.select("site"), "site", "left_anti").join(first.select("site", F.col("n")), "site", "left")
    reason = F.when(F.col("n") > 1, "ambiguous").when(F.col("name").isin(BUILTINS) | F.col("name").rlike("^__.*__$"), "builtin").when(F.col("receiver").rlike(r"[(\[]"), "dynamic").otherwise("not_found")
    return good, rest.select("site", reason.alias("reason"), F.coalesce("n", F.lit(0)).alias("n_candidates"))


def implementations(calls: DataFrame, methods: DataFrame, cap: int = O.DISPATCH_CAP) -> tuple[DataFrame, DataFrame]:
    """Calls (`site`, `interface`, `name`) to the implementing methods
    (`interface`, `name`, `id`): one is a framework binding, up to `cap` are
    dispatches, more are refused with reason dispatch_cap."""
    n = methods.groupBy("interface", "name").agg(F.count("*").alias("n"))
    known = calls.join(n, ["interface", "name"])
    edges = known.where(F.col("n") <= cap).join(methods, ["interface", "name"]).select("site", "id", F.when(F.col("n") == 1, "framework").otherwise("dispatch").alias("origin"))
    return edges, known.where(F.col("n") > cap).select("site", F.lit("dispatch_cap").alias("reason"), F.col("n").alias("n_candidates"))
