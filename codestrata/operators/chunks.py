"""Chunks for the index, costs, bindings of markup, and what feeds tables from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators.text import SECRET_KEY, token_estimate

CHUNK, OVERLAP, CLASS_LIMIT = 1500, 200, 6000


def line_chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """array<string>: whole lines up to `size` with the last `overlap` characters
    of the chunk before in front; a longer line is cut. Null gives null."""
    core = size - overlap
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{core}}}(?:\n|\z)|.{{1,{core}}}"), F.lit(0))
    before = F.slice(F.concat(F.array(F.lit("")), parts), F.lit(1), F.size(parts))
    return F.when(F.char_length(text) <= size, F.array(text)).otherwise(F.zip_with(parts, before, lambda p, b: F.concat(F.right(b, F.lit(overlap)), p)))


def class_chunks(nodes: DataFrame, text: str, limit: int = CLASS_LIMIT) -> DataFrame:
    """`id`, `chunk_index`, `chunk_text`, `token_estimate`: a class over the limit
    in parts that begin at its methods, each after the class's first line; others as they are."""
    head = F.regexp_extract(text, r"\A([^\n]*)", 1)
    parts = F.filter(F.split(F.col(text), r"(?m)(?=^(?: {4}|\t)(?:public|private|protected|internal|def|async|func|function|static)\b)"), lambda p: F.trim(p) != "")
    whole = F.col(text)
    pieces = F.when((F.col("node_type") == "class") & (F.char_length(whole) > limit) & (F.size(parts) > 1), F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(head, F.lit("\n"), p)))).otherwise(F.array(whole))
    rows = nodes.where(F.col(text).isNotNull() & (F.col(text) != "")).select("id", F.posexplode(pieces).alias("chunk_index", "chunk_text"))
    return rows.withColumn("token_estimate", token_estimate(F.col("chunk_text")))


def redact_map(m: Column) -> Column:
    """A map of strings whose values under credential-named keys are masked."""
    return F.transform_values(m, lambda k, v: F.when(k.rlike(SECRET_KEY) & v.isNotNull(), F.lit("[masked]")).otherwise(v))


def scan_shape(nodes: DataFrame, text: str) -> DataFrame:
    """`n`, `avg_tokens` of what a scan would send out, the mean kept within 50 and 1500."""
    return nodes.agg(F.count("*").alias("n"), F.least(F.greatest(F.coalesce(F.avg(token_estimate(F.col(text))), F.lit(50.0)), F.lit(50.0)), F.lit(1500.0)).alias("avg_tokens"))


def cost_estimate(shape: DataFrame, rates: DataFrame) -> DataFrame:
    """`stage`, `usd`, `low`, `high` by rates (`stage`, `per_node`, `usd_per_million`): half to twice the estimate."""
    usd = F.col("n") * F.col("avg_tokens") * F.col("per_node") * F.col("usd_per_million") / 1_000_000
    return rates.join(F.broadcast(shape)).select("stage", F.round(usd, 6).alias("usd"), F.round(usd * 0.5, 6).alias("low"), F.round(usd * 2, 6).alias("high"))


def cost_by_tier(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tier").agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("usd"), 6).alias("usd"))


def bind_markup(sites: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event handlers named in markup (`site`, `owner`, `member`) to code: the
    full name, else an owner with that ending; unresolved ones with a reason."""
    want = sites.select("site", F.concat_ws(".", "owner", "member").alias("qn"), "owner", "member")
    full = want.join(nodes.select("id", "qn"), "qn").select("site", "id", F.lit(0).alias("tier"))
    part = nodes.select("id", F.col("name").alias("member"), F.regexp_extract("qn", r"([^.]+)\.[^.]+$", 1).alias("owner"))
    short = want.withColumn("owner", F.substring_index("owner", ".", -1)).join(part, ["owner", "member"]).select("site", "id", F.lit(1).alias("tier"))
    per = full.unionByName(short).groupBy("site", "tier").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    first = per.groupBy("site").agg(F.min(F.struct("tier", "n", "id")).alias("b")).select("site", "b.n", "b.id")
    rest = sites.select("site").join(first, "site", "left").where("n is null or n > 1")
    return first.where("n = 1").select("site", "id"), rest.select("site", F.when(F.col("n") > 1, "ambiguous").otherwise("not_found").alias("reason"))


def bind_templates(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """Handlers a template names (`site`, `file_path`, `name`) to the one function of that name in the file."""
    j = sites.join(nodes.select("id", "file_path", "name"), ["file_path", "name"])
    return j.withColumn("_n", F.count("*").over(W.partitionBy("site"))).where("_n = 1").select("site", "id")


def table_extras(table: DataFrame, screens: DataFrame, keys: DataFrame, present: DataFrame) -> DataFrame:
    """`node`, `kind` affected by a table beside its callers: screens that read it, tables with keys to it; not those present already."""
    s = screens.select("screen", F.explode("tables").alias("table")).join(table, "table").select(F.concat(F.lit("screen:"), "screen").alias("node"), F.lit("screen").alias("kind"))
    k = keys.join(table.withColumnRenamed("table", "to_table"), "to_table").select(F.concat(F.lit("table:"), "from_table").alias("node"), F.lit("table").alias("kind"))
    return s.unionByName(k).distinct().join(present.select("node"), "node", "left_anti")


def etl_jobs(jobs: DataFrame, orphan_tables: DataFrame) -> DataFrame:
    """`job`, `confidence`, `tables`: batch jobs whose text names tables nobody
    writes: 0.7 and 0.1 more for every source, 0.9 at most. Words of the texts
    are joined with the names, so no pair is tried in vain."""
    words = jobs.select("job", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z_][a-z0-9_.]*"), F.lit(0)))).alias("table"))
    hit = words.join(orphan_tables.select(F.lower("table").alias("table")).distinct(), "table").groupBy("job").agg(F.sort_array(F.collect_set("table")).alias("tables"))
    return hit.select("job", F.round(F.least(F.lit(0.9), 0.7 + 0.1 * F.size("tables")), 2).alias("confidence"), "tables")


def api_inputs(endpoints: DataFrame) -> DataFrame:
    """Endpoints by which data comes in: `id`, `kind`."""
    low = F.lower(F.concat_ws(" ", "name", F.coalesce("annotations", F.lit(""))))
    kind = F.when(low.rlike("upload|multipart|file"), "file_upload").when(low.rlike("webhook|callback"), "webhook").when(low.rlike("import|bulk|batch|sync"), "import").when(low.rlike("post|put|patch|create|save"), "write")
    return endpoints.select("id", kind.alias("kind")).where("kind is not null")


def view_names(path: Column, prefixes: list[str]) -> Column:
    """Names by which a controller may mean a page: its path without ending, and without each prefix."""
    stem = F.regexp_replace(path, r"\.(?:jsp|html|aspx)$", "")
    out = [stem, *[F.when(stem.startswith(p), F.substr(stem, F.lit(len(p) + 1))) for p in prefixes]]
    return F.array_sort(F.array_distinct(F.filter(F.array(*out, *[F.concat(F.lit("/"), x) for x in out]), lambda x: x.isNotNull() & (x != ""))))
