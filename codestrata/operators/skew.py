"""Per-key results where a few keys hold most rows.

Rows are sorted by (key, value) into partitions of equal size, so a heavy key
spans many of them. Counts per key and partition, prefix-summed, give every
partition the offset of its part of a key; the exact row number follows, and
from it equal-sized chunks. Every chunk is reduced on its own; the states of
neighbouring chunks are merged in order, where a value that ends one chunk and
begins the next counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.runtime import cut_lineage

CHUNK_ROWS = 100_000


def numbered(df: DataFrame, key: str, value: str, measure: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """`key`, `value`, `measure`, `pid`, `row` (from 0 within the key, in order
    of value), `chunk` and `fresh` (1 where a value begins) of each row. Rows with a null key are left out; null
    values come first. Rows equal in key and value are numbered in any order.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value"), F.col(measure).cast("double").alias("measure"))
    # The salt lets a pair of key and value that repeats without end be cut as well.
    spread = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = spread.repartitionByRange("key", "value", "salt").sortWithinPartitions("key", "value").drop("salt")
    fixed = cut_lineage(ranged.withColumn("pid", F.spark_partition_id()))
    counts = fixed.groupBy("key", "pid").agg(F.count("*").alias("n"))
    offsets = counts.select("key", "pid", (F.sum("n").over(W.partitionBy("key").orderBy("pid")) - F.col("n")).alias("offset"))
    # A group of this window is one key within one partition: never more than a partition's rows.
    group = W.partitionBy("key", "pid").orderBy("value")
    last = F.lag("value").over(group)
    fresh = F.col("value").isNotNull() & ~F.col("value").eqNullSafe(last)
    placed = fixed.withColumns({"rank": F.row_number().over(group), "fresh": fresh.cast("int")})
    joined = placed.join(offsets, ["key", "pid"])
    row = F.col("offset") + F.col("rank") - 1
    return joined.select("key", "value", "measure", "pid", "fresh", row.alias("row"), F.floor(row / chunk_rows).cast("long").alias("chunk"))


def chunk_states(rows: DataFrame) -> DataFrame:
    """One state per key, chunk and partition: counts, sums and the values at its ends."""
    return rows.groupBy("key", "pid", "chunk").agg(
        F.count("*").alias("n"), F.sum("measure").alias("total"), F.count("measure").alias("n_measure"),
        F.sum("fresh").alias("n_fresh"), F.min("value").alias("first"), F.max("value").alias("last"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """Fold the ordered states of each key. A key has one state per partition
    and chunk it touches, so a key's fold is short whatever its rows."""
    order = W.partitionBy("key").orderBy("pid", "chunk")
    before = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    enters = F.coalesce(F.lag("pid").over(order) != F.col("pid"), F.lit(False))
    merged = states.withColumn("shared", (enters & F.coalesce(before == F.col("first"), F.lit(False))).cast("long"))
    return merged.groupBy("key").agg(
        F.sum("n").alias("n_rows"), (F.sum("n_fresh") - F.sum("shared")).alias("n_values"),
        F.try_divide(F.sum("total"), F.sum("n_measure")).alias("mean"), F.count("*").alias("n_states"),
    )


def per_key(df: DataFrame, key: str, value: str, measure: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """`key`, `n_rows`, `n_values` (distinct non-null values), `mean` (of the
    non-null measures; null if there are none) and `n_states` of every non-null
    key. Every row counts, repeated ones too. An empty table gives no rows.
    Other columns are ignored; none of their names clash. Measures that aren't
    numbers count as null under ANSI-off casts, else they raise."""
    return merge_states(chunk_states(numbered(df, key, value, measure, chunk_rows)))


def heavy_keys(stats: DataFrame, n_total: int, share: float) -> DataFrame:
    """The rows of `stats` whose key holds at least `share` of `n_total` rows."""
    return stats.where(F.col("n_rows") >= F.lit(n_total * share))


def edge_sides(edges: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """`key_side`, `node_id`, edge count, distinct partners and mean confidence
    of every callee and caller, redelivered edges included."""
    sides = []
    for side, key, partner in (("callee", "callee_id", "caller_id"), ("caller", "caller_id", "callee_id")):
        sides.append(per_key(edges, key, partner, "confidence", chunk_rows).select(F.lit(side).alias("key_side"), F.col("key").alias("node_id"), F.col("n_rows").alias("n_edges"), F.col("n_values").alias("n_partners"), F.round("mean", 6).alias("mean_confidence")))
    return sides[0].unionByName(sides[1])
