"""Joins on more than equality: overlaps, nearest ancestors, times, routes and name endings.

All of them are equi-joins with a residual condition, or on exploded keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlapping(spans: DataFrame, symbols: DataFrame, on: list[str]) -> DataFrame:
    """Symbols (`line_start`, `line_end`) that share a line with a span (`lo`,
    `hi`) of the same file. Spans or symbols without lines match nothing."""
    return spans.join(symbols, on).where((F.col("line_start") <= F.col("hi")) & (F.coalesce("line_end", "line_start") >= F.col("lo")))


def innermost(hits: DataFrame, span_key: list[str], symbol: str) -> DataFrame:
    """Of overlapping symbols those that hold no other one hit by the same span."""
    end = F.coalesce("line_end", "line_start")
    inner = hits.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(span_key)], F.col("line_start").alias("_s"), end.alias("_e"))
    same = F.lit(True)
    for i, k in enumerate(span_key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    holds = (F.col("line_start") <= F.col("_s")) & (end >= F.col("_e")) & ((F.col("line_start") < F.col("_s")) | (end > F.col("_e")))
    return hits.join(inner, same & holds, "left_anti")


def path_prefixes(path: Column, separator: str = "/") -> Column:
    """array<struct<prefix, depth>> of a path and its ancestors, the longest first."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), separator).alias("prefix"), k.alias("depth")))


def nearest_ancestor(items: DataFrame, path: str, roots: DataFrame, root: str, scope: list[str] | None = None, separator: str = "/") -> DataFrame:
    """`path` with `nearest`: the longest of the roots that is the path or an
    ancestor of it, within the same `scope`; null without any."""
    scope = scope or []
    p = items.select(*scope, path).distinct()
    up = p.select(*scope, path, F.inline(path_prefixes(F.col(path), separator)))
    r = roots.select(*scope, F.col(root).alias("prefix")).distinct()
    best = up.join(r, [*scope, "prefix"]).groupBy(*scope, path).agg(F.max_by("prefix", "depth").alias("nearest"))
    return p.join(best, [*scope, path], "left")


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, tie: str) -> DataFrame:
    """Rows of `left` with `value` of the last row of `right` before them, by
    (`time`, `tie`). Both sides are one sorted stream per key; nothing is paired."""
    r = right.select(*by, time, tie, F.struct(F.col(value).alias("v")).alias("_v"), F.lit(0).alias("_side"))
    cols = [c for c in left.columns if c not in (*by, time, tie)]
    x = left.select(*by, time, tie, F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side"), F.struct(*cols).alias("_row") if cols else F.lit(1).alias("_row"))
    both = r.withColumn("_row", F.lit(None).cast(x.schema["_row"].dataType)).unionByName(x)
    seen = F.last("_v", ignorenulls=True).over(W.partitionBy(*by).orderBy(time, tie, "_side").rowsBetween(W.unboundedPreceding, -1))
    out = both.withColumn("_seen", seen).where("_side = 1")
    return out.select(*by, time, tie, *[F.col("_row")[c].alias(c) for c in cols], F.col("_seen")["v"].alias(f"last_{value}"))


def providers_and_consumers(inbound: DataFrame, outbound: DataFrame) -> DataFrame:
    """`provider`, `consumer`, `route`: services that call a route another service offers."""
    a = inbound.select(F.col("slug").alias("provider"), "method", "route").distinct()
    b = outbound.select(F.col("slug").alias("consumer"), "method", "route").distinct()
    return a.join(b, ["method", "route"]).where("provider <> consumer").select("provider", "consumer", "route").distinct()


def module_tails(module: Column, separator: str = r"\.") -> Column:
    """Endings of a module name as paths, the longest first: a.b.c gives a/b/c, b/c, c."""
    parts = F.split(module, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def modules_to_files(modules: DataFrame, files: DataFrame) -> DataFrame:
    """`module`, `file`: the file whose path without extension is the module's
    name or ends with it; among several the longest common ending, then none if two are left."""
    stem = F.regexp_replace("file", r"\.[A-Za-z0-9]+$", "")
    ends = files.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(stem, "/"))), lambda k: F.array_join(F.slice(F.split(stem, "/"), k, F.size(F.split(stem, "/"))), "/"))).alias("tail"))
    m = modules.select("module", F.posexplode(module_tails(F.col("module"))).alias("k", "tail"))
    hit = m.join(ends, "tail").groupBy("module", "k").agg(F.min("file").alias("file"), F.count_distinct("file").alias("n"))
    return hit.groupBy("module").agg(F.min(F.struct("k", "n", "file")).alias("b")).where("b.n = 1").select("module", "b.file")


def convention_tests(files: DataFrame, all_files: DataFrame) -> DataFrame:
    """`file`, `test`: the shortest path with a name by which tests of a file go."""
    base = F.regexp_extract("file", r"([^/]+)\.[^.]+$", 1)
    ext = F.regexp_extract("file", r"\.([^./]+)$", 1)
    names = F.array(*[F.concat(F.lit(a), base, F.lit(b), ext) for a, b in (("test_", "."), ("", "_test."), ("", "Test."), ("", "Tests."), ("", ".test."), ("", ".spec."), ("", "Spec."), ("", "_spec."))])
    want = files.select("file", F.explode(names).alias("name"))
    have = all_files.select(F.col("file").alias("test"), F.regexp_extract("file", r"([^/]+)$", 1).alias("name"))
    return want.join(have, "name").groupBy("file").agg(F.min_by("test", F.struct(F.length("test"), "test")).alias("test"))


def merge_sources(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key, the second filling what the first leaves null."""
    cols = [c for c in first.columns if c not in key]
    b = second.select(*key, *[F.col(c).alias(f"_{c}") for c in cols])
    return first.join(b, key, "full_outer").select(*key, *[F.coalesce(c, f"_{c}").alias(c) for c in cols])


def longest_prefix_field(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """`field`, `entity`, `rest`: a snake_case field that begins with another
    entity's stem, the longest, and ends with one of its fields."""
    parts = F.split("field", "_")
    cut = fields.select("field", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"), parts.alias("p")).where("size(p) > 1")
    cand = cut.select("field", F.array_join(F.slice("p", F.lit(1), F.col("k")), "_").alias("stem"), F.array_join(F.slice("p", F.col("k") + 1, F.size("p")), "_").alias("rest"))
    hit = cand.join(entities.select("stem", "entity", "entity_fields"), "stem").where(F.array_contains("entity_fields", F.col("rest")))
    return hit.groupBy("field").agg(F.max_by(F.struct("entity", "rest"), F.length("stem")).alias("b")).select("field", "b.entity", "b.rest")
