"""Aggregations, ranks and set comparisons over the code graph and its logs.

Counts are grouped with partial aggregation before any exchange. Null group
keys form a group of their own. Every function is lazy unless it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata import origins as O


def overview(nodes: DataFrame) -> DataFrame:
    """`section`, `key`, `n`: symbols and files in all, symbols per node type, files per language."""
    files = nodes.select("scan_id", "file_path", F.lower("language").alias("language")).distinct()
    parts = [
        nodes.agg(F.count("*").alias("n")).select(F.lit("symbols").alias("section"), F.lit("all").alias("key"), "n"),
        files.select("scan_id", "file_path").distinct().agg(F.count("*").alias("n")).select(F.lit("files").alias("section"), F.lit("all").alias("key"), "n"),
        nodes.groupBy("node_type").agg(F.count("*").alias("n")).select(F.lit("type").alias("section"), F.col("node_type").alias("key"), "n"),
        files.groupBy("language").agg(F.count("*").alias("n")).select(F.lit("language").alias("section"), F.coalesce("language", F.lit("(none)")).alias("key"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unresolved_ratio(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """`language`, `n_resolved`, `n_unresolved`, `ratio` by the caller's language;
    calls of unknown callers count under '(none)'."""
    lang = nodes.select(F.col("id").alias("caller"), F.lower("language").alias("language"))
    count = lambda df, c, name: df.select(F.col(c).alias("caller")).join(lang, "caller", "left").groupBy(F.coalesce("language", F.lit("(none)")).alias("language")).agg(F.count("*").alias(name))
    both = count(edges, "src", "n_resolved").join(count(unresolved, "caller_id", "n_unresolved"), "language", "full_outer")
    r, u = F.coalesce("n_resolved", F.lit(0)), F.coalesce("n_unresolved", F.lit(0))
    return both.select("language", r.alias("n_resolved"), u.alias("n_unresolved"), F.round(u / (u + r), 3).alias("ratio"))


def out_degrees(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """`id`, `n_out` of the nodes of the given types, 0 where nothing is called."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    return nodes.where(F.col("node_type").isin(kinds)).select("id").join(out, "id", "left").select("id", F.coalesce("n_out", F.lit(0)).alias("n_out"))


def caller_signals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`id`, `prod_in`, `fan_out`: distinct callers outside tests, and distinct followed callees."""
    test = nodes.select(F.col("id").alias("src"), F.col("file_path").rlike(O.TEST_PATH).alias("test"))
    e = edges.where(O.followable(F.col("origin"), F.col("confidence")) & F.col("dst").isNotNull()).select("src", "dst").distinct()
    prod = e.join(test, "src").groupBy(F.col("dst").alias("id")).agg(F.count_if(~F.col("test")).alias("prod_in"))
    fan = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    return nodes.select("id").join(prod, "id", "left").join(fan, "id", "left").select("id", F.coalesce("prod_in", F.lit(0)).alias("prod_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def domains(nodes: DataFrame) -> DataFrame:
    """`domain`, sizes, entry points, models and the languages used."""
    return nodes.groupBy(F.coalesce("domain", F.lit("(none)")).alias("domain")).agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("node_type").isin("endpoint", "batch_job")).alias("n_entries"),
        F.count_if(F.col("node_type") == "db_model").alias("n_models"), F.concat_ws(",", F.sort_array(F.collect_set(F.lower("language")))).alias("languages"))


def domain_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`domain`, `n_internal`, `n_outgoing` by the caller's domain, among nodes with a domain."""
    d = nodes.where("domain is not null")
    pairs = edges.join(d.select(F.col("id").alias("src"), F.col("domain").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("domain").alias("b")), "dst")
    return pairs.groupBy(F.col("a").alias("domain")).agg(F.count_if(F.col("a") == F.col("b")).alias("n_internal"), F.count_if(F.col("a") != F.col("b")).alias("n_outgoing"))


def domain_adjacency(nodes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """`from_domain`, `to_domain`, `n` of the different domains with at least `least` edges."""
    d = nodes.where("domain is not null")
    pairs = edges.join(d.select(F.col("id").alias("src"), F.col("domain").alias("from_domain")), "src").join(d.select(F.col("id").alias("dst"), F.col("domain").alias("to_domain")), "dst")
    return pairs.where("from_domain <> to_domain").groupBy("from_domain", "to_domain").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def shared_bases(class_bases: DataFrame, least: int = 2) -> DataFrame:
    """`base`, `n`: bases that several classes name (mixins)."""
    return class_bases.groupBy("base").agg(F.count_distinct("class").alias("n")).where(F.col("n") >= least)


def file_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`file_a`, `file_b`, `weight`: undirected links of files by summed confidence."""
    f = nodes.select("id", F.concat_ws("/", F.col("scan_id").cast("string"), "file_path").alias("file"))
    pairs = edges.join(f.select(F.col("id").alias("src"), F.col("file").alias("x")), "src").join(f.select(F.col("id").alias("dst"), F.col("file").alias("y")), "dst").where("x <> y")
    return pairs.groupBy(F.least("x", "y").alias("file_a"), F.greatest("x", "y").alias("file_b")).agg(F.round(F.sum(F.coalesce("confidence", F.lit(0.0))), 6).alias("weight"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """`key`, `n` with empty and null keys as '(none)'."""
    return df.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("(none)")).alias("key")).agg(F.count("*").alias("n"))


def top_extensions(nodes: DataFrame, k: int = 10) -> DataFrame:
    """The `k` commonest file extensions: `ext`, `n`; the name decides ties."""
    files = nodes.select("scan_id", "file_path").distinct()
    ext = F.coalesce(F.nullif(F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1)), F.lit("")), F.lit("(none)"))
    return files.groupBy(ext.alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(k)


def nearest_rank(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """`group` and one column per share: the value at index int(q * (n - 1) + 0.5)
    in rising order. Ranks come from a window, so no group is gathered."""
    w = W.partitionBy(group)
    ranked = df.where(F.col(value).isNotNull()).select(group, value, (F.row_number().over(w.orderBy(value)) - 1).alias("_r"), F.count("*").over(w).alias("_n"))
    return ranked.groupBy(group).agg(*[F.max(F.when(F.col("_r") == F.floor(F.lit(q) * (F.col("_n") - 1) + 0.5), F.col(value))).alias(name) for name, q in shares.items()])


def ledger_stats(calls: DataFrame) -> DataFrame:
    """`tool` with calls, failures, distinct callers and repeats (calls minus
    distinct arguments) of a log of `tool`, `client`, `status`, `args`."""
    return calls.groupBy("tool").agg(
        F.count("*").alias("n_calls"), F.count_if(F.col("status") != "ok").alias("n_failed"), F.count_distinct("client").alias("n_clients"),
        (F.count("*") - F.count_distinct("args")).alias("n_repeats"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """`table`, `n` of several relations."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def process_edges(log: DataFrame, case: str, order: list[str], activity: str) -> DataFrame:
    """`from_activity`, `to_activity`, `n`, `share` (percent of all): which activity follows which within a case."""
    nxt = log.select(F.col(activity).alias("from_activity"), F.lead(activity).over(W.partitionBy(case).orderBy(*order)).alias("to_activity")).where("to_activity is not null")
    n = nxt.groupBy("from_activity", "to_activity").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 4))


def majority_name(names: DataFrame, key: str, name: str) -> DataFrame:
    """`key`, `name`: the commonest name, the last in order among equals."""
    n = names.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.count("*").alias("_n"))
    return n.groupBy(key).agg(F.max_by(name, F.struct("_n", name)).alias(name))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the score interval of a share; 0 and 1 without cases."""
    p, zz = hits / n, z * z
    mid, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    low, high = (mid - half) / (1 + zz / n), (mid + half) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), low)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), high)).otherwise(1.0)


def precision_strata(graded: DataFrame, strata: list[str], correct: str) -> DataFrame:
    """Strata with cases, correct ones, precision and its 95 % interval; ungraded (null) rows don't count."""
    g = graded.where(F.col(correct).isNotNull()).groupBy(*strata).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("int")).alias("n_correct"))
    low, high = wilson(F.col("n_correct"), F.col("n"))
    return g.select(*strata, "n", "n_correct", F.round(F.col("n_correct") / F.col("n"), 6).alias("precision"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def stratum_regressions(old: DataFrame, new: DataFrame, strata: list[str]) -> DataFrame:
    """Strata whose new precision lies under the old interval's lower bound."""
    o = old.select(*strata, F.col("low").alias("bound"))
    return new.join(o, strata).where(F.col("precision") < F.col("bound")).select(*strata, "precision", "bound")


def drift_share(graded: DataFrame, emitted: DataFrame, key: list[str], strata: list[str]) -> DataFrame:
    """Strata with the share of graded edges that are emitted no more."""
    e = emitted.select(*key).distinct().withColumn("_live", F.lit(True))
    j = graded.join(e, key, "left")
    return j.groupBy(*strata).agg(F.count("*").alias("n"), F.count_if(F.col("_live").isNull()).alias("n_gone")).withColumn("share", F.round(F.col("n_gone") / F.col("n"), 6))


def set_scores(found: DataFrame, wanted: DataFrame, group: list[str], item: str) -> DataFrame:
    """`group`, hits, missing and extra items, precision, recall and F1 (1.0 where nothing is wanted and nothing found)."""
    f = found.select(*group, item).distinct().withColumn("_f", F.lit(1))
    w = wanted.select(*group, item).distinct().withColumn("_w", F.lit(1))
    c = f.join(w, [*group, item], "full_outer").groupBy(*group).agg(
        F.count_if(F.col("_f").isNotNull() & F.col("_w").isNotNull()).alias("n_hit"), F.count_if(F.col("_f").isNull()).alias("n_missing"), F.count_if(F.col("_w").isNull()).alias("n_extra"))
    p = F.when(F.col("n_hit") + F.col("n_extra") == 0, 1.0).otherwise(F.col("n_hit") / (F.col("n_hit") + F.col("n_extra")))
    r = F.when(F.col("n_hit") + F.col("n_missing") == 0, 1.0).otherwise(F.col("n_hit") / (F.col("n_hit") + F.col("n_missing")))
    out = c.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", F.round(F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0), 6)).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


def verdicts(claims: DataFrame, key: list[str]) -> DataFrame:
    """`key`, counts of claims (`verdict`) that were verified, unverified and
    contradicted, and the share verified of those decided; 1 without any."""
    n = claims.groupBy(*key).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("verified", "unverified", "contradicted")])
    return n.withColumn("share", F.coalesce(F.try_divide(F.col("verified"), F.col("verified") + F.col("contradicted")), F.lit(1.0)))


def blend_confidence(n_verified: Column, n_claims_ok: Column, n_unsure: Column, n_total: Column) -> Column:
    """Verified rows and claims count 1, unsure claims a half; 0.3 without any."""
    return F.when(n_verified + n_total == 0, 0.3).otherwise((n_verified + n_claims_ok + 0.5 * n_unsure) / (n_verified + n_total))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Cost of a call at prices per million tokens."""
    return (F.coalesce(tokens_in, F.lit(0)) * price_in + F.coalesce(tokens_out, F.lit(0)) * price_out) / 1_000_000


def bootstrap_mean(values: DataFrame, value: str, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """`low`, `high`: 95 % bounds of the mean under resampling, by Poisson
    weights: every row draws its weight in every resample from its own hash, so
    nothing is replicated before the sums."""
    draws = values.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.monotonically_increasing_id().alias("i"))
    # Inverse of Poisson(1) at a uniform draw; heavier weights than 5 are cut to it with probability under 0.001.
    u = lambda k: F.pmod(F.xxhash64(F.col("i"), F.lit(seed), k), F.lit(1_000_003)) / 1_000_003.0
    steps = [0.36788, 0.73576, 0.91970, 0.98101, 0.99634]
    weight = lambda k: sum((u(k) >= s).cast("int") for s in steps)
    r = draws.select("v", "i", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("k")).withColumn("w", weight(F.col("k")))
    means = r.groupBy("k").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m")).where("m is not null")
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def first_per(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key by `order`."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """Of the edges of a caller, callee and type the one with the best confidence; the earlier of equals."""
    return first_per(edges, ["src", "dst", "edge_type"], F.desc_nulls_last("confidence"), F.asc("edge_id"))


def dedupe_unresolved(unresolved: DataFrame, edges: DataFrame) -> DataFrame:
    """The first unresolved call of each caller and name that isn't resolved elsewhere."""
    first = first_per(unresolved.where("caller_id is not null"), ["caller_id", "callee_name"], F.asc("id"))
    known = edges.where("dst is not null").select(F.col("src").alias("caller_id"), "callee_name").distinct()
    return first.join(known, ["caller_id", "callee_name"], "left_anti")


def neighbours(nodes: DataFrame, edges: DataFrame, centre: DataFrame) -> DataFrame:
    """`centre`, `side`, `id`, `confidence` of direct callers and callees, each once: followable ones first, then by confidence and edge."""
    inside = centre.select("id")
    sides = []
    for side, at, other in (("caller", "dst", "src"), ("callee", "src", "dst")):
        e = edges.join(inside.select(F.col("id").alias(at)), at, "left_semi").join(inside.select(F.col("id").alias(other)), other, "left_anti").join(nodes.select(F.col("id").alias(other)), other, "left_semi")
        e = e.select(F.col(at).alias("centre"), F.lit(side).alias("side"), F.col(other).alias("id"), O.confidence(F.col("origin"), F.col("confidence")).alias("confidence"), O.followable(F.col("origin"), F.col("confidence")).alias("ok"), "edge_id")
        sides.append(first_per(e, ["centre", "side", "id"], F.desc("ok"), F.desc("confidence"), F.asc("edge_id")))
    return sides[0].unionByName(sides[1]).select("centre", "side", "id", "confidence")


def unique_names(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """`unique_name`: names that repeat get -2, -3 and so on."""
    k = F.row_number().over(W.partitionBy(name).orderBy(*order))
    return df.withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat_ws("-", name, k.cast("string"))))


def page_keys(nodes: DataFrame) -> DataFrame:
    """`key` of every symbol: its qualified name, with path and line where several have it."""
    several = F.count("*").over(W.partitionBy("scan_id", "qn")) > 1
    return nodes.withColumn("key", F.when(several, F.concat("qn", F.lit("@"), "file_path", F.lit(":"), F.coalesce(F.col("line_start").cast("string"), F.lit("?")))).otherwise(F.col("qn")))


def previous_runs(scans: DataFrame) -> DataFrame:
    """`id`, `previous`: the newest earlier scan of the same commit, else of the same branch, by id."""
    w = W.partitionBy("project_slug", "branch").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    c = W.partitionBy("project_slug", "commit_sha").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    same = F.when(F.col("commit_sha").isNotNull(), F.max("id").over(c))
    return scans.select("id", F.coalesce(same, F.max("id").over(w)).alias("previous"))


def shed_to_budget(ranked: DataFrame, group: list[str], rank: Column, size: Column, budget: int) -> DataFrame:
    """The longest prefix of each group's ranking whose sizes sum to at most `budget`."""
    upto = F.sum(size).over(W.partitionBy(*group).orderBy(rank).rowsBetween(W.unboundedPreceding, 0)) if group else F.sum(size).over(W.orderBy(rank).rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("_u", upto).where(F.col("_u") <= budget).drop("_u")


def symmetric_difference(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """`key`, `change` of keys added, removed or with another value; nulls equal each other."""
    x, y = a.select(*key, F.col(value).alias("_a"), F.lit(1).alias("_x")), b.select(*key, F.col(value).alias("_b"), F.lit(1).alias("_y"))
    j = x.join(y, key, "full_outer")
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.select(*key, change.alias("change")).where("change is not null")


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Shared share of two sets; `both_empty` where neither has an element."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)


def names_like(names: DataFrame, name: str, query: str, k: int = 5) -> DataFrame:
    """Did you mean: names that contain the query, shortest first."""
    hit = names.where(F.instr(F.lower(name), query.lower()) > 0)
    return hit.select(name).distinct().orderBy(F.length(name), name).limit(k)
