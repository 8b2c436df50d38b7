"""Source trees: listing, keeping, decoding and counting files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Extension to language.
LANGUAGES = {"py": "python", "java": "java", "cs": "csharp", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "vue": "vue", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "jsp": "jsp", "aspx": "webforms", "ascx": "webforms", "sql": "sql", "vb": "vbnet"}
MANIFESTS = ["pom.xml", "build.gradle", "package.json", "requirements.txt", "pyproject.toml", "go.mod", "Cargo.toml", "Gemfile", "composer.json"]
SKIPPED_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", ".idea", ".vs", "coverage", ".mypy_cache", ".pytest_cache"]
# Folders that are skipped only beside signs that a tool filled them.
CONTEXT_DIRS = {"packages": [r"\.nupkg$", r"packages\.config$"], "bin": [r"\.csproj$", r"\.vbproj$"], "obj": [r"\.csproj$", r"\.vbproj$"], "target": [r"pom\.xml$", r"Cargo\.toml$"], "build": [r"build\.gradle(?:\.kts)?$", r"setup\.py$"], "vendor": [r"go\.mod$", r"composer\.json$"]}
MEDIA = r"(?i)\.(?:png|jpe?g|gif|ico|svg|webp|mp[34]|wav|avi|mov|pdf|zip|gz|tar|7z|jar|war|dll|exe|so|woff2?|ttf|eot|class|pyc|lock)$"
LARGEST = 1_000_000
LEGACY = ["cp949", "euc_kr"]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """`path` (relative), `size`, `mtime`, `content` of every file under a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    return df.select(F.expr(f"substring(path, instr(path, '{base}') + {len(base)})").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def context_skips(files: DataFrame) -> DataFrame:
    """`dir`: folders left out because what stands beside them shows a tool made them."""
    parent = F.regexp_extract("path", r"^(.*?)[^/]*$", 1)
    there = files.select(parent.alias("beside"), "path").distinct()
    out = None
    for name, signs in CONTEXT_DIRS.items():
        d = files.select(F.regexp_extract("path", rf"^((?:.*/)?)({name})/", 1).alias("beside"), F.regexp_extract("path", rf"^((?:.*/)?{name})/", 1).alias("dir")).where("dir <> ''").distinct()
        hit = d.join(there.where(F.col("path").rlike("|".join(signs))), "beside", "left_semi").select("dir")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def skip_reason(path: Column, size: Column, content: Column, excludes: list[str] | None = None) -> Column:
    """Why a file isn't read; null for one that is."""
    head = F.substring(content, 1, 8192)
    text = F.decode(head, "ISO-8859-1")
    w = F.when(path.rlike("(?:^|/)(?:" + "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS) + ")/"), "dir")
    if excludes:
        w = w.when(path.rlike("|".join(excludes)), "excluded")
    w = w.when(path.rlike(MEDIA), "media").when(size > LARGEST, "size").when(path.rlike(r"[.-]min\.(?:js|css)$"), "minified")
    return w.when(F.instr(text, "\0") > 0, "binary").when(F.substr(text, F.lit(1), F.lit(600)).rlike(r"(?i)<auto-generated|@generated|code generated by .* do not edit"), "generated")


def kept(files: DataFrame, excludes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files to read, and `reason`, `n` of those left out."""
    dirs = context_skips(files)
    up = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))).alias("dir"))
    made = up.join(dirs, "dir", "left_semi").select("path").distinct().withColumn("_made", F.lit("context_dir"))
    r = files.join(made, "path", "left").withColumn("reason", F.coalesce("_made", skip_reason(F.col("path"), F.col("size"), F.col("content"), excludes)))
    return r.where("reason is null").drop("_made", "reason"), r.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def language(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def language_stats(files: DataFrame) -> DataFrame:
    """`language`, files, extensions and manifests."""
    f = files.select(language(F.col("path")).alias("language"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext"))
    return f.where("language is not null").groupBy("language").agg(F.count("*").alias("n_files"), F.sort_array(F.collect_set("ext")).alias("extensions"))


def manifests(files: DataFrame) -> DataFrame:
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("manifest")).where(F.col("manifest").isin(MANIFESTS)).groupBy("manifest").agg(F.count("*").alias("n"))


def tree_fingerprint(files: DataFrame) -> DataFrame:
    """`fingerprint`, one row: over path, size and time of all files. Digests are combined
    without order, so no list of files is gathered; contents aren't read."""
    one = files.select("path", F.sha2(F.concat_ws("\0", "path", F.col("size").cast("string"), F.col("mtime").cast("string")), 256).alias("h"))
    return one.agg(F.sha2(F.concat(F.lpad(F.hex(F.bit_xor(F.xxhash64("path", "h"))), 16, "0"), F.lpad(F.hex(F.bit_xor(F.xxhash64("h", "path"))), 16, "0"), F.count("*").cast("string")), 256).alias("fingerprint"))


def decode(df: DataFrame, keys: list[str], content: str, legacy: list[str] = LEGACY) -> DataFrame:
    """`keys`, `text`, `encoding`, `lossy`: byte order mark, UTF-8, a declared
    encoding, legacy ones, and at last UTF-8 with replacements. Null content gives null text."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def one(raw: bytes | None) -> tuple[str | None, str | None, bool]:
        import re

        if raw is None:
            return None, None, False
        for mark, enc in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
            if raw.startswith(mark):
                return raw.decode(enc, "replace"), enc, False
        said = re.search(rb"(?:coding[:=]\s*|encoding=[\"']|charset=[\"']?)([\w-]+)", raw[:1024])
        for enc in ["utf-8", *([said[1].decode("ascii")] if said else []), *legacy]:
            try:
                return raw.decode(enc), enc, False
            except (UnicodeDecodeError, LookupError):
                pass
        return raw.decode("utf-8", "replace"), "utf-8", True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.bool_())], names=[*keys, "text", "encoding", "lossy"])

    return df.select(*keys, content).mapInArrow(run, f"{kinds}, text string, encoding string, lossy boolean")


def encoding_fallbacks(decoded: DataFrame) -> DataFrame:
    return decoded.agg(F.count_if(~F.col("encoding").isin("utf-8", "utf-8-sig")).alias("n_legacy"), F.count_if("lossy").alias("n_lossy"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Tool calls from JSON lines, rotated files too; lines that aren't JSON are left out."""
    schema = "ts timestamp, tool string, client string, args_sha string, status string, reason string, tokens long, truncated boolean, timing_ms double, scan_id long"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("tool is not null")


def artifacts(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of the JSON artifacts of several repositories with `repo`, the folder each lies in."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)
    return df.withColumn("repo", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def graded_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a graded sheet that have a verdict."""
    return spark.read.option("header", True).csv(path).where("verdict is not null and verdict <> ''")


def unified_diff(lines: DataFrame) -> DataFrame:
    """`diff`, `file`, `lo`, `hi`, `old_file` of the hunks of unified diffs given
    as (`diff`, `pos`, `line`): the lines of the new file each one covers."""
    new = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.substring_index(F.substr("line", F.lit(5)), "\t", 1), r"^b/", ""))
    old = F.when(F.col("line").startswith("--- "), F.regexp_replace(F.substring_index(F.substr("line", F.lit(5)), "\t", 1), r"^a/", ""))
    w = W.partitionBy("diff").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    h = lines.withColumns({"file": F.last(new, ignorenulls=True).over(w), "old_file": F.last(old, ignorenulls=True).over(w)}).where(F.col("line").rlike(r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"))
    at = lambda g: F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", g)
    start, n = at(3).cast("int"), F.coalesce(at(4).try_cast("int"), F.lit(1))
    return h.select("diff", F.when(F.col("file") == "/dev/null", F.col("old_file")).otherwise(F.col("file")).alias("file"), start.alias("lo"), (start + F.greatest(n, F.lit(1)) - 1).alias("hi"), "old_file")
