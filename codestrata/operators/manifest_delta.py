"""Records added or changed between two immutable versions of a table.

A version is described by a manifest: one entry per data file with a content
fingerprint. Comparing two manifests gives added, removed and rewritten files;
for a rewritten file a deletion vector (the records that the older version
held in the same form) leaves the delta. Unchanged files are never opened at
record level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.runtime import unused
from pyspark.sql import Window as W

ADDED, REMOVED, REWRITTEN, SAME = "added", "removed", "rewritten", "same"


def manifest(records: DataFrame, version: str, file: str, record_key: list[str], always: Column | None = None) -> DataFrame:
    """One entry per (version, file) of `records`.

    records: rows with a `version`, a `file`, the columns of `record_key`,
    which tell one record form from another, and any others. Rows that repeat
    a form count once, so redelivered rows leave no trace. `always` marks rows
    that have no comparable form; their files hold `n_open` > 0.
    Null versions or files form entries of their own. An empty table gives an
    empty manifest. The fingerprint is 128 bits wide; it only decides whether
    a file is compared record by record.
    """
    forms = records.select(
        F.col(version).alias("version"), F.col(file).alias("file"),
        F.xxhash64(F.lit(1), *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in record_key]).alias("h1"),
        F.xxhash64(F.lit(2), *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in record_key]).alias("h2"),
        (F.coalesce(always, F.lit(False)) if always is not None else F.lit(False)).alias("open"),
    )
    # Forms are made unique across all tasks, then folded per file with partial sums: a file with very many records doesn't meet one task.
    single = forms.distinct()
    return single.groupBy("version", "file").agg(
        F.count("*").alias("n_forms"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"),
        F.sum(F.col("open").cast("long")).alias("n_open"),
    )


def diff_manifests(entries: DataFrame, parents: DataFrame) -> DataFrame:
    """Compare each version's entries with those of its parent version.

    entries: what manifest() gives. parents: `version`, `parent` (null: none),
    one row per version to be compared. Gives `version`, `parent`, `file`,
    `change` (added, removed, rewritten or same) and `n_open`.
    """
    now = entries.join(parents, "version")
    before = entries.join(parents.where("parent is not null").select(F.col("version").alias("child"), F.col("parent").alias("p")), F.col("version") == F.col("p"))
    before = before.select(F.col("child").alias("v"), F.col("p"), F.col("file").alias("f"), F.col("n_forms").alias("m"), F.col("x1").alias("y1"), F.col("x2").alias("y2"))
    both = now.join(before, (F.col("version") == F.col("v")) & F.col("file").eqNullSafe(F.col("f")), "full_outer")
    return both.select(
        F.coalesce("version", "v").alias("version"), F.coalesce("parent", "p").alias("parent"),
        F.when(F.col("version").isNull(), F.col("f")).otherwise(F.col("file")).alias("file"),
        F.when(F.col("version").isNull(), REMOVED).when(F.col("v").isNull(), ADDED)
        .when((F.col("n_forms") == F.col("m")) & (F.col("x1") == F.col("y1")) & (F.col("x2") == F.col("y2")), SAME)
        .otherwise(REWRITTEN).alias("change"),
        F.coalesce("n_open", F.lit(0)).alias("n_open"),
    )


def record_delta(records: DataFrame, parents: DataFrame, version: str, file: str, record_key: list[str], always: Column | None = None) -> DataFrame:
    """The rows of `records` that are new or changed against the parent version.

    Rows of versions without a parent are all new. Rows where `always` holds
    are new in every version. Repeated rows come out as often as they came in,
    all or none of them. Other columns pass through unchanged.
    """
    flag = F.coalesce(always, F.lit(False)) if always is not None else F.lit(False)
    changes = diff_manifests(manifest(records, version, file, record_key, always), parents)
    live = changes.where((F.col("change") == ADDED) | (F.col("change") == REWRITTEN) | ((F.col("change") == SAME) & (F.col("n_open") > 0)))
    v, p, f, c, o = (unused(x, records) for x in ("version_", "parent_", "file_", "change_", "open_"))
    live = live.select(F.col("version").alias(v), F.col("parent").alias(p), F.col("file").alias(f), F.col("change").alias(c))
    touched = records.withColumn(o, flag).join(live, (F.col(version) == F.col(v)) & F.col(file).eqNullSafe(F.col(f)))
    whole = touched.where((F.col(c) == ADDED) | F.col(o))
    partly = touched.where((F.col(c) != ADDED) & ~F.col(o))
    names = [unused(f"old_{i}_", records) for i in range(len(record_key) + 2)]
    old = records.where(~flag).select(*[F.col(k).alias(n) for k, n in zip((version, file, *record_key), names)])
    held = F.col(p) == F.col(names[0])
    for k, n in zip((file, *record_key), names[1:]):
        held = held & F.col(k).eqNullSafe(F.col(n))
    return whole.unionByName(partly.join(old, held, "left_anti")).drop(v, p, f, c, o)


def latest_state(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Of each key the row with the greatest `at`; equal ones are decided by
    the other columns, so the result doesn't depend on the order of rows."""
    rest = [c for c in rows.columns if c not in (key, at)]
    top = rows.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_s"))
    return top.select(key, *[F.col("_s")[c].alias(c) for c in (at, *rest)])


def scan_parents(scan_runs: DataFrame) -> DataFrame:
    """`version`, `parent` of each completed scan: the parent is the completed
    scan of the same project and branch (null equals null) that began last
    before it; null if there is none. Scans that began at the same instant
    aren't each other's parents; of several equal ones the greatest id counts.
    Scans without a start have no parent and are none."""
    done = latest_state(scan_runs.select("id", "project_slug", "branch", "started_at", "status", "recorded_at"), "id", "recorded_at").where("status = 'completed'")
    starts = done.groupBy("project_slug", "branch", "started_at").agg(F.max("id").alias("last_id"))
    chain = starts.where("started_at is not null").withColumn("parent", F.lag("last_id").over(W.partitionBy("project_slug", "branch").orderBy("started_at")))
    c = chain.select(F.col("project_slug").alias("_p"), F.col("branch").alias("_b"), F.col("started_at").alias("_s"), "parent")
    on = done["project_slug"].eqNullSafe(c["_p"]) & done["branch"].eqNullSafe(c["_b"]) & (done["started_at"] == c["_s"])
    return done.join(c, on, "left").select(F.col("id").alias("version"), "parent")


def normal_hash(c: str) -> Column:
    """Letter case and surrounding blanks don't tell hashes apart; a blank one is none."""
    v = F.lower(F.trim(F.regexp_replace(F.col(c), r"^\s+|\s+$", "")))
    return F.when(v != "", v)


def scan_delta(nodes: DataFrame, chunks: DataFrame, scan_runs: DataFrame) -> DataFrame:
    """`rec_kind`, `rec_id`, `scan_id`, `parent`: the records of every completed
    scan that are new or changed since its predecessor, each once.

    When a row arrived and how often doesn't matter. Records without a usable
    hash are always taken. Null file paths and qualified names equal each other.
    """
    parents = scan_parents(scan_runs)
    n = nodes.select(F.lit("node").alias("rec_kind"), F.col("id").alias("rec_id"), "scan_id", "file_path", "qualified_name", normal_hash("file_hash").alias("hash"), F.lit(None).cast("int").alias("pos"))
    c = chunks.select(F.lit("chunk").alias("rec_kind"), F.col("chunk_id").alias("rec_id"), "scan_id", "file_path", "qualified_name", normal_hash("chunk_hash").alias("hash"), F.col("chunk_index").alias("pos"))
    both = n.unionByName(c)
    delta = record_delta(both, parents, "scan_id", "file_path", ["rec_kind", "qualified_name", "hash", "pos"], F.col("hash").isNull())
    once = delta.select("rec_kind", "rec_id", "scan_id").distinct()
    return once.join(parents.select(F.col("version").alias("scan_id"), "parent"), "scan_id")

