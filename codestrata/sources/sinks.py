"""Writing results: tables by snapshot, exports, deliveries."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.rollups import first_per


def save_snapshot(df: DataFrame, root: str, partition: str = "scan_id") -> None:
    """Replace the partitions that `df` has rows of and leave the others."""
    df.write.partitionBy(partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def save_nodes(nodes: DataFrame, root: str) -> None:
    """One row per scan and qualified name: the first by path and line."""
    save_snapshot(first_per(nodes, ["scan_id", "qualified_name"], F.asc("file_path"), F.asc_nulls_last("line_start"), F.asc("id")), root)


def append(df: DataFrame, root: str) -> None:
    df.write.mode("append").option("mergeSchema", True).parquet(root)


def degradations(events: DataFrame) -> DataFrame:
    """`stage`, `kind`, `n` of what went less than well."""
    return events.groupBy("stage", "kind").agg(F.sum("count").alias("n"))


def export_json(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON object a line, in a total order; keys sorted, so equal data gives equal bytes."""
    cols = sorted(df.columns)
    df.orderBy(*order, *cols).select(F.to_json(F.struct(*cols)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def export_pages(pages: DataFrame, root: str, suffix: str = ".md") -> None:
    """A file per page (`path`, `body`), written where the rows are."""

    def write(rows):
        for r in rows:
            target = f"{root}/{r['path']}{suffix}"
            if not os.path.abspath(target).startswith(os.path.abspath(root) + os.sep):
                raise ValueError("a page's path leaves the export folder")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target + ".part", "w") as f:
                f.write(r["body"] or "")
            os.replace(target + ".part", target)

    pages.select("path", "body").foreachPartition(write)


def markdown(pages: DataFrame) -> DataFrame:
    """`path`, `body` of pages: title, facts and links."""
    facts = F.transform(F.map_entries(F.from_json("facts", "map<string,string>")), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    body = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.lit(""), F.array_join(F.sort_array(facts), "\n"), F.array_join(F.transform("links", lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n"))
    return pages.select(F.regexp_replace(F.regexp_replace("page_id", ":", "/"), r"[^A-Za-z0-9._/@-]|\.\.", "_").alias("path"), body.alias("body"))


def export_html(pages: DataFrame, root: str, title: str) -> None:
    """A file per page, written where the rows are, and an index with the number
    of pages of each type. Texts are escaped; links stay inside the export."""
    name = lambda c: F.regexp_replace(F.regexp_replace(c, ":", "/"), r"[^A-Za-z0-9._/@-]|\.\.", "_")
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    up = F.repeat(F.lit("../"), F.size(F.split(name(F.col("page_id")), "/")) - 1)
    links = F.array_join(F.transform("links", lambda x: F.concat(F.lit('<li><a href="'), up, name(x), F.lit('.html">'), safe(x), F.lit("</a></li>"))), "")
    body = F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), safe(F.col("title")), F.lit("</title><h1>"), safe(F.col("title")), F.lit("</h1><pre>"), safe(F.col("facts")), F.lit("</pre><ul>"), links, F.lit("</ul>"))
    export_pages(pages.select(name(F.col("page_id")).alias("path"), body.alias("body")), root, ".html")
    counts = pages.groupBy("type").agg(F.count("*").alias("n")).orderBy("type").collect()  # one row per type of page
    esc = title.replace("&", "&amp;").replace("<", "&lt;")
    with open(f"{root}/index.html", "w") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>{esc}</title><h1>{esc}</h1><ul>" + "".join(f"<li>{r.type}: {r.n}</li>" for r in counts) + "</ul>")


def export_machines(machines: DataFrame, path: str) -> None:
    """State machines as JSON lines, by entity; sets are sorted, so equal machines give equal bytes."""
    export_json(machines.withColumn("states", F.sort_array(F.array_distinct("states"))), path, ["entity"])


def export_federation(parts: dict[str, DataFrame], root: str, order: dict[str, list[str]]) -> list[str]:
    """Every part of a federation as a JSON export of its own; their paths."""
    for name, df in parts.items():
        export_json(df, f"{root}/{name}", order[name])
    return [f"{root}/{name}" for name in parts]


def record_call(path: str, entry: dict, largest: int = 5_000_000, keep: int = 5) -> None:
    """Add one line to a ledger on the driver; a full file makes room by renaming."""
    if os.path.exists(path) and os.path.getsize(path) >= largest:
        for k in range(keep - 1, 0, -1):
            if os.path.exists(f"{path}.{k}"):
                os.replace(f"{path}.{k}", f"{path}.{k + 1}")
        os.replace(path, f"{path}.1")
    with open(path, "a") as f:
        f.write(json.dumps(entry, sort_keys=True, default=str) + "\n")


def merge_parses(cache: DataFrame, new: DataFrame) -> DataFrame:
    """A cache of parses with new ones: of a path, version and encoding the latest stays."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_per(both, ["path", "parser_version", "encoding"], F.desc("_new"), F.desc("content_hash")).drop("_new")


def by_symbol(rows: DataFrame, nodes: DataFrame, scan_id: int) -> DataFrame:
    """Rows about symbols (`qn`), summaries for instance, with the symbol's id
    in a scan; those of unknown symbols are left out, one row per symbol stays."""
    n = nodes.where(F.col("scan_id") == scan_id).groupBy("qn").agg(F.min("id").alias("node_id"))
    one = first_per(rows, ["qn"], *[F.asc(c) for c in rows.columns if c != "qn"])
    return one.join(n, "qn").withColumn("scan_id", F.lit(scan_id)).drop("qn")


def phase_state(log: DataFrame) -> DataFrame:
    """`scan_id`, `phase`, `status`, `at` of every phase, by the last line of its
    log (`scan_id`, `phase`, `status`: started, complete or error, `at`)."""
    return log.groupBy("scan_id", "phase").agg(F.max(F.struct("at", "status")).alias("s")).select("scan_id", "phase", "s.status", "s.at")


def cost_rows(quotes: DataFrame, spent: DataFrame) -> DataFrame:
    """`scan_id`, `quoted`, `decision`, `actual`, `within`: what a scan was quoted, and what its calls cost."""
    a = spent.groupBy("scan_id").agg(F.round(F.sum("usd"), 6).alias("actual"))
    return quotes.join(a, "scan_id", "left").select("scan_id", "quoted", "decision", "actual", F.col("actual").between(F.col("low"), F.col("high")).alias("within"))


def to_push(pages: DataFrame, pushed: DataFrame, only_failed: bool = False) -> DataFrame:
    """Pages to deliver: new or changed since the last delivery, or only those that failed."""
    p = pages.withColumn("content_sha", F.sha2(F.concat_ws("\0", "page_id", "title", "facts"), 256))
    if only_failed:
        return p.join(pushed.where("status = 'failed'").select("page_id"), "page_id", "left_semi")
    return p.join(pushed.where("status = 'ok'").select("page_id", "content_sha"), ["page_id", "content_sha"], "left_anti")


def keep_manual_blocks(new: str, old: str) -> str:
    """The new text with the manual blocks of the old one, by name."""
    import re

    kept = dict(re.findall(r"<!-- manual:(\w+) -->(.*?)<!-- /manual -->", old, re.S))
    return re.sub(r"<!-- manual:(\w+) -->(.*?)<!-- /manual -->", lambda m: f"<!-- manual:{m[1]} -->{kept.get(m[1], m[2])}<!-- /manual -->", new, flags=re.S)


def migrate(root: str, steps: list[Callable[[str], None]]) -> int:
    """Run the numbered steps a store hasn't had; its version is kept beside it."""
    at = f"{root}/_version.json"
    done = json.load(open(at))["version"] if os.path.exists(at) else 0
    for i, step in enumerate(steps[done:], done + 1):
        step(root)
        with open(at + ".part", "w") as f:
            json.dump({"version": i}, f)
        os.replace(at + ".part", at)
    return len(steps)
