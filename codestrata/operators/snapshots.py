"""Snapshots of the store: pointer, retention, stages, reuse and drift."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEEP = 3


def flip(pointers: DataFrame, project: str, scan_id: int) -> DataFrame:
    """The pointer table with one project's readers sent to another scan."""
    spark = pointers.sparkSession
    new = spark.createDataFrame([(project, scan_id)], "project_slug string, scan_id long")
    return pointers.where(~F.col("project_slug").eqNullSafe(F.lit(project))).select("project_slug", "scan_id").unionByName(new)


def expired(scans: DataFrame, pointers: DataFrame, keep: int = KEEP) -> DataFrame:
    """`id` of the scans to remove: not among the newest `keep` of their project, not running, not the one readers see."""
    rank = F.row_number().over(W.partitionBy("project_slug").orderBy(F.desc("id")))
    old = scans.withColumn("_k", rank).where((F.col("_k") > keep) & (F.col("status") != "running"))
    return old.join(pointers.select(F.col("scan_id").alias("id")), "id", "left_anti").select("id")


def fingerprint(version: str, config: dict, commit: str, upstream: str = "") -> str:
    """Identity of a stage's input: its version, configuration, commit and what came before."""
    raw = json.dumps([version, config, commit, upstream], sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(raw.encode()).hexdigest()


def fingerprint_chain(stages: list[tuple[str, str, dict]], commit: str) -> dict[str, str]:
    """Stage name to fingerprint, each over the one before."""
    out, last = {}, ""
    for name, version, config in stages:
        last = out[name] = fingerprint(version, config, commit, last)
    return out


def decide(name: str, print_: str, stored: dict[str, tuple[str, str]], forced: bool = False) -> str:
    """run, reuse or forced, by the last run's status and fingerprint."""
    if forced:
        return "forced"
    status, last = stored.get(name, ("", ""))
    return "reuse" if status == "complete" and last == print_ else "run"


def run_stages(stages: list[tuple[str, str, dict, Callable[[], None]]], commit: str, stored: dict[str, tuple[str, str]], record: Callable[[str, str, str], None], forced: tuple[str, ...] = ()) -> dict[str, str]:
    """Run the stages (name, version, config, work) whose input changed; what each
    did. `record` (name, status, fingerprint) keeps a line before and after; a
    stage that fails ends the run, and the next run begins with it."""
    prints, out = fingerprint_chain([(n, v, c) for n, v, c, _ in stages], commit), {}
    for name, _, _, work in stages:
        out[name] = decide(name, prints[name], stored, name in forced)
        if out[name] == "reuse":
            continue
        record(name, "started", prints[name])
        try:
            work()
        except Exception:
            record(name, "error", prints[name])
            raise
        record(name, "complete", prints[name])
    return out


class RunLock:
    """One writer at a time: a file made exclusively, with the writer's process.
    The lock of a process that is no more is taken over."""

    def __init__(self, path: str):
        self.path = path

    def __enter__(self) -> RunLock:
        for _ in range(2):
            try:
                with open(self.path, "x") as f:
                    f.write(str(os.getpid()))
                return self
            except FileExistsError:
                with open(self.path) as f:
                    holder = f.read().strip()
                try:
                    os.kill(int(holder), 0)
                except (ValueError, ProcessLookupError):
                    os.unlink(self.path)
                    continue
                except PermissionError:
                    pass
                raise RuntimeError(f"process {holder} is writing") from None
        raise RuntimeError("another process is writing")

    def __exit__(self, *_) -> None:
        os.unlink(self.path)


def newest_indexed(scans: DataFrame, edges: DataFrame, commit: str | None = None) -> DataFrame:
    """`project_slug`, `scan_id`: of every project the newest scan that has a graph, of a commit if one is asked for."""
    s = scans.where(F.col("commit_sha") == commit) if commit else scans
    return s.join(edges.select(F.col("scan_id").alias("id")).distinct(), "id", "left_semi").groupBy("project_slug").agg(F.max("id").alias("scan_id"))


def cached_answers(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (`key` and more) with the last answer kept for their key, and those without one."""
    last = cache.groupBy("key").agg(F.max(F.struct("at", "answer")).alias("_a")).select("key", F.col("_a.answer").alias("answer"))
    j = requests.join(last, "key", "left")
    return j.where("answer is not null"), j.where("answer is null").drop("answer")


def watch_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """`path`, `change` of files (`path`, `mtime`, `size`) that were added, removed or changed."""
    b = before.select("path", F.struct("mtime", "size").alias("_b"))
    j = b.join(after.select("path", F.struct("mtime", "size").alias("_a")), "path", "full_outer")
    return j.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("path", F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("changed").alias("change"))


def resume_phase(phases: DataFrame) -> DataFrame:
    """`scan_id`, `next_phase`: one after the last phase that completed."""
    return phases.groupBy("scan_id").agg((F.coalesce(F.max(F.when(F.col("status") == "complete", F.col("phase"))), F.lit(0)) + 1).alias("next_phase"))


def drift(built: DataFrame, now: DataFrame, key: list[str], hash_column: str) -> DataFrame:
    """`key`, `state`: fresh, changed or missing, of what was built from files as they are now."""
    n = now.select(*key, F.col(hash_column).alias("_now"), F.lit(1).alias("_there"))
    j = built.select(*key, F.col(hash_column).alias("_then")).join(n, key, "left")
    return j.select(*key, F.when(F.col("_there").isNull(), "missing").when(F.col("_then").eqNullSafe(F.col("_now")), "fresh").otherwise("changed").alias("state"))


def reusable(new: DataFrame, old: DataFrame, values: DataFrame, existing: DataFrame, key: list[str], id_column: str = "id") -> DataFrame:
    """Values of old rows that hold for new rows with the same, non-empty key
    (name, path, hash) and aren't there yet: new id and the value's columns."""
    usable = new
    before = old
    for k in key:
        usable, before = usable.where((F.col(k).isNotNull()) & (F.col(k) != "")), before.where(F.col(k).isNotNull())
    one = before.select(*key, id_column).join(values, id_column).groupBy(*key).agg(F.max(F.struct(id_column, *[c for c in values.columns if c != id_column])).alias("_v"))
    got = usable.select(*key, F.col(id_column)).join(one, key).join(existing.select(id_column), id_column, "left_anti")
    return got.select(id_column, *[F.col("_v")[c].alias(c) for c in values.columns if c != id_column])


def removed_pages(before: DataFrame, now: DataFrame) -> DataFrame:
    """`page_id`, `successor`: pages that are no more, and their longest living ancestor (page ids are paths after the colon)."""
    from codestrata.operators.joins import nearest_ancestor

    gone = before.select("page_id").join(now.select("page_id"), "page_id", "left_anti")
    return nearest_ancestor(gone, "page_id", now, "page_id").withColumnRenamed("nearest", "successor")


def cached_parses(files: DataFrame, cache: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Files with a cached parse of the same content by this parser version, and those without."""
    c = cache.where(F.col("parser_version") == version).select("path", "content_hash", "payload").groupBy("path", "content_hash").agg(F.max("payload").alias("payload"))
    j = files.join(c, ["path", "content_hash"], "left")
    return j.where("payload is not null"), j.where("payload is null").drop("payload")
