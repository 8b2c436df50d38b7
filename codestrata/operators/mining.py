"""State machines, sequences, conditions and batches mined from logs and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators.graph import components
from codestrata.operators.rollups import jaccard
from codestrata.runtime import cut_lineage


def transitions(log: DataFrame, entity: str, order: list[str], state: str) -> DataFrame:
    """`entity`, `from_state`, `to_state`, `pos` of successive rows with another state."""
    w = W.partitionBy(entity).orderBy(*order)
    rows = log.select(F.col(entity).alias("entity"), F.lag(state).over(w).alias("from_state"), F.col(state).alias("to_state"), F.row_number().over(w).alias("pos"))
    return rows.where("from_state is not null and from_state <> to_state")


def state_machines(moves: DataFrame) -> DataFrame:
    """`entity`, its states, how many different moves it makes and how often it moves."""
    return moves.groupBy("entity").agg(
        F.sort_array(F.array_union(F.collect_set("from_state"), F.collect_set("to_state"))).alias("states"), F.count_distinct("from_state", "to_state").alias("n_moves"), F.count("*").alias("n_times"))


def richest(moves: DataFrame, key: list[str], *by: Column) -> DataFrame:
    """Of equal transitions the one with the most evidence."""
    rest = [c for c in moves.columns if c not in key]
    return moves.groupBy(*key).agg(F.max(F.struct(*[b.alias(f"_o{i}") for i, b in enumerate(by)], F.struct(*rest).alias("row"))).alias("_b")).select(*key, "_b.row.*")


def sequences(walks: DataFrame, scenario: str, item: str, pos: str, least: int = 1, direction: float = 0.75) -> DataFrame:
    """`before`, `after`, `support`, `confidence`: items of which one comes first
    in nearly all scenarios that hold both. Only an item's first place counts.
    Scenarios are walks of bounded length (15 steps as graph.dominant_walk makes
    them); pairs grow with the square of a walk, not of a caller's edges."""
    first = walks.groupBy(scenario, item).agg(F.min(pos).alias("p"))
    a, b = first.select(scenario, F.col(item).alias("before"), F.col("p").alias("pa")), first.select(scenario, F.col(item).alias("after"), F.col("p").alias("pb"))
    n = a.join(b, scenario).where("pa < pb").groupBy("before", "after").agg(F.count("*").alias("support"))
    back = n.select(F.col("before").alias("after"), F.col("after").alias("before"), F.col("support").alias("reverse"))
    j = n.join(back, ["before", "after"], "left").withColumn("confidence", F.col("support") / (F.col("support") + F.coalesce("reverse", F.lit(0))))
    return j.where((F.col("support") >= least) & (F.col("confidence") >= direction)).select("before", "after", "support", F.round("confidence", 6).alias("confidence"))


def conditions(walks: DataFrame, scenario: str, item: str, state: str, order: list[str], least: int = 2, consistency: float = 0.75) -> DataFrame:
    """`target`, `context`, `state`, `support`, `consistency`: in which state
    another item nearly always is when the target first moves. The context's
    state is its last one before; a scenario counts once."""
    w = W.partitionBy(scenario).orderBy(*order)
    rows = walks.select(scenario, item, state, F.row_number().over(w).alias("p"))
    first = rows.groupBy(scenario, F.col(item).alias("target")).agg(F.min("p").alias("tp"))
    before = first.join(rows.select(scenario, F.col(item).alias("context"), F.col(state).alias("s"), "p"), scenario).where("p < tp and context <> target")
    seen = before.groupBy(scenario, "target", "context").agg(F.max_by("s", "p").alias("state"))
    base = seen.groupBy("target", "context").agg(F.count("*").alias("base"))
    n = seen.groupBy("target", "context", "state").agg(F.count("*").alias("support"))
    j = n.join(base, ["target", "context"]).withColumn("consistency", F.col("support") / F.col("base"))
    return j.where((F.col("support") >= least) & (F.col("consistency") >= consistency)).select("target", "context", "state", "support", F.round("consistency", 6).alias("consistency"))


def set_classes(sets: DataFrame, key: str, items: str, block: Column) -> DataFrame:
    """`blk`, `i`, `rep`, `n`: equal sets of a block as one, by the least key, with how many they are."""
    s = sets.select(F.col(key).alias("k"), F.sort_array(F.array_distinct(items)).alias("i"), block.alias("blk")).where("blk is not null")
    return s.groupBy("blk", "i").agg(F.min("k").alias("rep"), F.count("*").alias("n"))


def set_members(sets: DataFrame, key: str, items: str, block: Column) -> DataFrame:
    """`k`, `rep`: the class of every key that isn't its class's representative."""
    s = sets.select(F.col(key).alias("k"), F.sort_array(F.array_distinct(items)).alias("i"), block.alias("blk")).where("blk is not null")
    return s.join(set_classes(sets, key, items, block).select("blk", "i", "rep"), ["blk", "i"]).where("k <> rep").select("k", "rep")


def set_pairs(sets: DataFrame, key: str, items: str, block: Column) -> DataFrame:
    """`a`, `b`, `n_a`, `n_b`, `jaccard`, `size_ratio`, `coverage` of the pairs of
    different sets of a block. Equal sets are compared once, as their class's
    representative; set_members() has the rest, so no pair of copies is made."""
    c = cut_lineage(set_classes(sets, key, items, block))
    a, b = c.select("blk", F.col("rep").alias("a"), F.col("i").alias("x"), F.col("n").alias("n_a")), c.select("blk", F.col("rep").alias("b"), F.col("i").alias("y"), F.col("n").alias("n_b"))
    p = a.join(b, "blk").where("a < b")
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    return p.select("a", "b", "n_a", "n_b", F.round(jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(F.try_divide(small, large), 6).alias("size_ratio"), F.round(F.try_divide(F.size(F.array_intersect("x", "y")), small), 6).alias("coverage"))


def pair_decision(j: Column, size: Column, similarity: Column, coverage: Column) -> Column:
    """merge, projection or skip of two machines, by overlap of states, size ratio, similarity of names and coverage."""
    merge = ((j >= 0.9) & (size >= 0.7)) | ((j >= 0.7) & (similarity >= 0.8) & (size >= 0.7))
    return F.when(merge, "merge").when((size < 0.5) & (coverage >= 0.8) & (similarity >= 0.6), "projection").otherwise("skip")


def merge_machines(machines: DataFrame, merges: DataFrame) -> DataFrame:
    """`component`, `name`, `states`, `n_members`: machines linked by merges as
    one, named after the shortest, then first name."""
    c = components(merges.select("a", "b"), machines.select(F.col("entity").alias("id")))
    j = machines.join(c.select(F.col("id").alias("entity"), "component"), "entity")
    states = j.select("component", F.explode("states").alias("s")).distinct().groupBy("component").agg(F.sort_array(F.collect_list("s")).alias("states"))
    head = j.groupBy("component").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("name"), F.count("*").alias("n_members"))
    return head.join(states, "component")


def communities(links: DataFrame, vertices: DataFrame, rounds: int = 8) -> DataFrame:
    """`id`, `community` by weighted label propagation over (`a`, `b`, `weight`):
    everyone takes the label its neighbours weigh heaviest for, the least among
    equals; odd and even rounds move half of the vertices each, so labels settle."""
    both = cut_lineage(links.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight").unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"), "weight")))
    labels = cut_lineage(vertices.select("id", F.col("id").alias("label")))
    for r in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy("u", "label").agg(F.sum("weight").alias("w"))
        top = votes.groupBy("u").agg(F.max(F.round("w", 9)).alias("m"))
        best = votes.join(top, "u").where(F.round("w", 9) == F.col("m")).groupBy("u").agg(F.min("label").alias("new"))
        moves = F.pmod(F.xxhash64("id"), F.lit(2)) == r % 2
        labels = cut_lineage(labels.join(best, F.col("id") == F.col("u"), "left").select("id", F.when(moves & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("label")).alias("label")))
    return labels.select("id", F.col("label").alias("community"))


def pack(items: DataFrame, group: list[str], order: list[str], size: str, most_items: int = 10, most_size: int = 12_000) -> DataFrame:
    """Rows with `bin` (from 0 within the group): consecutive items share a bin
    while it holds at most `most_items` and `most_size`; an item over the size
    stands alone.

    The bin that would begin at each item is found with a window of
    `most_items` rows; which bins do begin follows from the group's first item
    by doubling jumps, so no group is walked by one task item by item.
    """
    w = W.partitionBy(*group).orderBy(*order)
    rows = items.withColumn("_r", F.row_number().over(w))
    ahead = F.collect_list(F.coalesce(F.col(size), F.lit(0)).cast("long")).over(w.rowsBetween(0, most_items - 1))
    fits = F.aggregate(ahead, F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["s"] + x).alias("s"), F.when(a["on"] & (a["s"] + x <= most_size), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & (a["s"] + x <= most_size)).alias("on")))["n"]
    rows = cut_lineage(rows.withColumn("_next", F.col("_r") + F.greatest(fits, F.lit(1))))
    jump = rows.select(*group, F.col("_r").alias("p"), F.col("_next").alias("q"))
    starts = rows.where("_r = 1").select(*group, F.lit(1).alias("p"))
    longest = rows.agg(F.max("_r")).first()[0] or 0
    step = 1
    while step < longest:
        reach = starts.join(jump, [*group, "p"]).select(*group, F.col("q").alias("p"))
        starts = cut_lineage(starts.unionByName(reach).distinct())
        if step * 2 < longest:
            jump = cut_lineage(jump.join(jump.select(*group, F.col("p").alias("q"), F.col("q").alias("q2")), [*group, "q"]).select(*group, "p", F.col("q2").alias("q")))
        step *= 2
    marked = rows.join(starts.select(*group, F.col("p").alias("_r"), F.lit(1).alias("_s")), [*group, "_r"], "left")
    return marked.withColumn("bin", (F.sum(F.coalesce("_s", F.lit(0))).over(W.partitionBy(*group).orderBy("_r")) - 1).cast("int")).drop("_r", "_next", "_s")
