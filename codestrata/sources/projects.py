"""What a project is: its checkout, framework, menus, screens, beans and usings.

Facts are read from one file's text at a time on the executors; which facts
hold for a project is decided by joins. Files have `project`, `path`, `text`.
"""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators.joins import nearest_ancestor
from codestrata.sources.parsers import menu_items, routes


def _git(path: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", path, *args], check=True, capture_output=True).stdout


def checkout(repo: str, work: str, branch: str | None = None) -> tuple[str, str | None]:
    """Folder and commit of a local path, or of a clone of an address made below
    `work`; a folder that is no repository has no commit."""
    if Path(repo).is_dir():
        path = str(Path(repo).resolve())
    else:
        path = str(Path(work) / hashlib.sha256(f"{repo}\0{branch}".encode()).hexdigest()[:16])
        if not Path(path, ".git").exists():
            subprocess.run(["git", "clone", "--quiet", "--depth", "1", *(["--branch", branch] if branch else []), "--", repo, path], check=True, capture_output=True)
    try:
        return path, _git(path, "rev-parse", "HEAD").decode().strip()
    except subprocess.CalledProcessError:
        return path, None


def worktree_state(path: str) -> str:
    """A hash of what differs from the commit, files that aren't tracked
    included; empty for a clean checkout."""
    status = _git(path, "status", "--porcelain", "-z", "--untracked-files=all")
    if not status:
        return ""
    h = hashlib.sha256(status + b"\0" + _git(path, "diff", "HEAD", "--binary"))
    for entry in sorted(x[3:] for x in status.split(b"\0") if x.startswith(b"?? ")):
        h.update(entry + b"\0")
        with open(Path(path) / entry.decode("utf-8", "surrogateescape"), "rb") as f:
            while part := f.read(1 << 20):
                h.update(part)
    return h.hexdigest()


# Frameworks in the order they are tried, by manifest and what it holds.
FRAMEWORKS = [("spring", r"(?:^|/)(?:pom\.xml|build\.gradle(?:\.kts)?)$", "springframework"), ("aspnet", r"\.(?:csproj|vbproj)$", "Microsoft.NET.Sdk.Web"), ("aspnet", r"(?:^|/)[Ww]eb\.config$", "system.web"), ("express", r"(?:^|/)package\.json$", '"express"')]


def framework(files: DataFrame) -> DataFrame:
    """`project`, `framework`: the first of the known ones that a manifest names."""
    hit = F.coalesce(*[F.when(F.col("path").rlike(p) & F.contains("text", F.lit(has)), F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"))) for k, (name, p, has) in enumerate(FRAMEWORKS)])
    return files.select("project", hit.alias("h")).where("h is not null").groupBy("project").agg(F.min("h").alias("h")).select("project", F.col("h.name").alias("framework"))


Leaf = tuple[tuple[str, ...], str | None]
DETECTORS: list[tuple[str, str, Callable[[str, str], list[Leaf]]]] = []


def detector(name: str, path: str):
    """Register a reader of menus for files whose path fits; the first registered goes first."""

    def keep(f):
        DETECTORS.append((name, path, f))
        return f

    return keep


def human(name: str) -> str:
    """Words of an identifier or file name, each with a capital."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+", re.sub(r"[_.-]+", " ", name))
    return " ".join(p[:1].upper() + p[1:] for p in parts)


@detector("json", r"(?i)(?:menu|navigation|sidebar|nav)[^/]*\.json$")
def json_menu(path: str, text: str) -> list[Leaf]:
    return menu_items(text)


@detector("yaml", r"(?i)(?:menu|navigation|sidebar|nav)[^/]*\.ya?ml$")
def yaml_menu(path: str, text: str) -> list[Leaf]:
    """Menus as nested lists of mappings with a label and a path, by their indents."""
    out: list[Leaf] = []
    open_: list[tuple[int, dict]] = []

    def close(indent: int) -> None:
        while open_ and open_[-1][0] >= indent:
            _, item = open_.pop()
            if item.get("label") and not item.get("kids"):
                out.append(((*(i["label"] for _, i in open_ if i.get("label")), item["label"]), item.get("path")))

    for line in text.splitlines():
        m = re.match(r"( *)(- )?\s*(\w+):\s*(.*?)\s*$", line)
        if not m or line.lstrip().startswith("#"):
            continue
        indent, value = len(m[1]) + (2 if m[2] else 0), m[4].strip("'\"")
        if m[2]:
            close(indent)
            if open_:
                open_[-1][1]["kids"] = True
            open_.append((indent, {}))
        if open_ and open_[-1][0] == indent:
            if m[3] in ("label", "title", "name", "text"):
                open_[-1][1]["label"] = value
            elif m[3] in ("path", "url", "route", "href"):
                open_[-1][1]["path"] = value
    close(-1)
    return sorted(out, key=lambda x: text.find(x[0][-1]))


@detector("constants", r"(?i)(?:menu|navigation|sidebar|nav)[^/]*\.(?:ts|tsx|js|jsx)$")
def constant_menu(path: str, text: str) -> list[Leaf]:
    """Menus as literals of a script, read as JSON once keys and strings are quoted alike."""
    found = re.search(r"(?:export\s+default|=)\s*(\[.*\])", text, re.S)
    if not found:
        return []
    s = re.sub(r"//[^\n]*|/\*.*?\*/", "", found[1], flags=re.S)
    s = re.sub(r"'((?:\\.|[^'\\])*)'|`([^`$]*)`", lambda m: json.dumps(m[1] if m[1] is not None else m[2]), s)
    s = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', s)
    s = re.sub(r":\s*(?![\s\"\[{\d]|true\b|false\b|null\b)[^,}\]]+", ': null', s)  # names of components and the like
    return menu_items(re.sub(r",(\s*[}\]])", r"\1", s))


@detector("router", r"(?i)rout(?:er|es|ing)[^/]*\.(?:ts|tsx|js|jsx)$")
def router_menu(path: str, text: str) -> list[Leaf]:
    return [(tuple(human(p) for p in r["path"].strip("/").split("/") if p and not p.startswith(":")) or ("Home",), r["path"]) for r in routes(text) if r["component"]]


def folder_menu(path: str, root: str) -> list[Leaf]:
    """A page's folders below a root folder as its menus."""
    parts = re.sub(r"\.[^./]+$", "", path).split("/")
    below = parts[parts.index(root) + 1 :] if root in parts else parts
    return [(tuple(map(human, below)), path)]


@detector("webforms", r"\.aspx$")
def webforms_menu(path: str, text: str) -> list[Leaf]:
    return folder_menu(path, "Pages")


@detector("jsp", r"\.jsp$")
def jsp_menu(path: str, text: str) -> list[Leaf]:
    return [] if re.search(r"(?:^|/)(?:includes?|fragments?|layouts?|common)/", path) else folder_menu(path, "views" if "/views/" in path else "jsp")


def _texts(files: DataFrame, run: Callable[[str, str], list[tuple]], names: list[str], types: list[str], keep: list[str]) -> DataFrame:
    """Rows of `run` (path, text) for every file that has a text, beside the columns to keep."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = ", ".join([f"{k} string" for k in keep] + [f"{n} {t}" for n, t in zip(names, types)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*r[:-2], *x) for r in zip(*(c.to_pylist() for c in b.columns)) if r[-1] for x in run(r[-2] or "", r[-1])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([*[pa.string()] * len(keep), *(kinds[t] for t in types)])], names=[*keep, *names])

    return files.select(*[F.col(k).cast("string").alias(k) for k in keep], F.col("path").alias("_path"), F.col("text").alias("_text")).mapInArrow(each, schema)


def menus(files: DataFrame) -> DataFrame:
    """`project`, `detector`, `path`, `pos`, `labels`, `target` of all menu leaves
    of the first detector that finds any in a project. Empty pages count for folders."""

    def run(path: str, text: str) -> list[tuple]:
        for k, (name, pattern, f) in enumerate(DETECTORS):
            if re.search(pattern, path):
                return [(k, name, path, i, list(labels), target) for i, (labels, target) in enumerate(f(path, text)) if labels]
        return []

    found = _texts(files.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))), run, ["rank", "detector", "path", "pos", "labels", "target"], ["int", "string", "string", "int", "array<string>", "string"], ["project"])
    first = F.min("rank").over(W.partitionBy("project"))
    return found.withColumn("_f", first).where("rank = _f").drop("rank", "_f")


def screen_map(leaves: DataFrame) -> DataFrame:
    """`project`, `screen_id`, `label`, `menu`, `target`: menu leaves as screens;
    ids are unique within a project, numbered from the second of a name on."""
    base = F.trim(F.lower(F.regexp_replace(F.array_join("labels", "-"), r"[^\p{L}\p{N}]+", "-")), F.lit("-"))
    k = F.row_number().over(W.partitionBy("project", "_base").orderBy("path", "pos", "target"))
    s = leaves.withColumn("_base", F.when(base == "", "screen").otherwise(base)).withColumn("_k", k)
    return s.select("project", F.when(F.col("_k") > 1, F.concat_ws("-", "_base", "_k")).otherwise(F.col("_base")).alias("screen_id"), F.element_at("labels", -1).alias("label"), F.array_join("labels", " / ").alias("menu"), "target")


def project_usings(files: DataFrame) -> DataFrame:
    """`project_dir`, `module`: namespaces that a C# project imports everywhere,
    by `global using` in any of its files or by its project file."""
    use = lambda p, t: [(m,) for m in re.findall(r"^\s*global\s+using\s+(?:static\s+)?([\w.]+)\s*;", t, re.M)] if p.endswith(".cs") else [(m,) for m in re.findall(r"<Using\s+Include=\"([\w.]+)\"", t)]
    found = _texts(files.where(F.col("path").rlike(r"\.(?:cs|csproj)$")), use, ["module"], ["string"], ["project", "path"])
    roots = files.where(F.col("path").endswith(".csproj")).select(F.col("project").cast("string").alias("project"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("root"))
    at = nearest_ancestor(found, "path", roots, "root", ["project"])
    return found.join(at, ["project", "path"]).where("nearest is not null").select("project", F.col("nearest").alias("project_dir"), "module").distinct()


def beans(files: DataFrame) -> DataFrame:
    """`project`, `bean`, `impl`, `is_primary`: what a Spring container holds, by
    stereotypes, factory methods and XML."""

    def run(path: str, text: str) -> list[tuple]:
        if path.endswith(".xml"):
            tags = (dict(re.findall(r"([\w-]+)\s*=\s*\"([^\"]*)\"", t)) for t in re.findall(r"<bean\b([^>]*)>", text))
            return [(t.get("id") or t.get("name"), t["class"].rsplit(".", 1)[-1], t.get("primary") == "true") for t in tags if t.get("class")]
        out = []
        for m in re.finditer(r"((?:@\w+(?:\([^)]*\))?\s*)+)(?:public\s+|final\s+|abstract\s+)*class\s+(\w+)", text):
            said = re.search(r"@(?:Component|Service|Repository|Controller|RestController|Configuration)\b(?:\(\s*(?:value\s*=\s*)?\"([^\"]+)\")?", m[1])
            if said:
                out.append((said[1] or m[2][:1].lower() + m[2][1:], m[2], "@Primary" in m[1]))
        for m in re.finditer(r"((?:@\w+(?:\([^)]*\))?\s*)*@Bean\b(?:\([^)]*\))?\s*(?:@\w+(?:\([^)]*\))?\s*)*)(?:public\s+|static\s+)*[\w<>.]+\s+(\w+)\s*\([^)]*\)\s*\{[^}]*?\breturn\s+new\s+(\w+)", text):
            out.append((m[2], m[3], "@Primary" in m[1]))
        return out

    return _texts(files.where(F.col("path").rlike(r"\.(?:java|xml)$")), run, ["bean", "impl", "is_primary"], ["string", "string", "boolean"], ["project"]).distinct()


def page_handlers(files: DataFrame) -> DataFrame:
    """`project`, `path`, `route`, `handler`, `view` of Java methods that answer a
    route with a view's name."""

    def run(path: str, text: str) -> list[tuple]:
        base = re.search(r"@RequestMapping\(\s*(?:value\s*=\s*)?\"([^\"]*)\"[^)]*\)\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:public\s+)?class\b", text)
        out = []
        for m in re.finditer(r"@(?:Get|Post|Request)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]*)\"[^)]*\)\s*(?:@\w+(?:\([^)]*\))?\s*)*public\s+(?:String|ModelAndView)\s+(\w+)\s*\(", text):
            view = re.compile(r"\breturn\s+(?:new\s+ModelAndView\(\s*)?\"([^\"]+)\"").search(text, m.end())
            nxt = re.compile(r"@(?:Get|Post|Request)Mapping\(").search(text, m.end())
            if view and (not nxt or view.start() < nxt.start()):
                out.append(("/" + "/".join(x.strip("/") for x in ((base[1] if base else ""), m[1]) if x.strip("/")), m[2], view[1]))
        return out

    return _texts(files.where(F.col("path").endswith(".java")), run, ["route", "handler", "view"], ["string"] * 3, ["project", "path"])


# What source registers to be run, and the member that is.
REGISTERED = [("route", r"\.Map(?:Get|Post|Put|Delete|Patch)\(\s*\"[^\"]*\"\s*,\s*([\w.]+)\s*\)"), ("event", r"\.AddSubscription<\s*\w+\s*,\s*(\w+)\s*>"), ("hosted", r"\.AddHostedService<\s*(\w+)\s*>")]
MEMBERS = {"event": ["Handle", "HandleAsync"], "hosted": ["ExecuteAsync", "StartAsync"]}


def registered_entries(files: DataFrame) -> DataFrame:
    """`project`, `path`, `kind`, `name` of the handlers and classes that C# source registers."""
    run = lambda p, t: [(kind, name.rsplit(".", 1)[-1]) for kind, form in REGISTERED for name in re.findall(form, t)]
    return _texts(files.where(F.col("path").endswith(".cs")), run, ["kind", "name"], ["string", "string"], ["project", "path"]).distinct()


def is_index_chunk(path: Column, text: Column) -> Column:
    """Whether a chunk goes into the index: it has a text and isn't of a test."""
    from codestrata.origins import TEST_PATH

    return F.coalesce(F.trim(text) != "", F.lit(False)) & ~F.coalesce(path.rlike(TEST_PATH), F.lit(False))


# Schemas that databases keep about themselves.
CATALOG_SCHEMAS = ["information_schema", "pg_catalog", "sys", "mysql", "performance_schema", "sqlite_master", "sqlite_schema", "dual"]


def is_catalog_table(name: Column) -> Column:
    low = F.lower(F.regexp_replace(name, r"[\"`\[\]]", ""))
    return F.substring_index(low, ".", 1).isin(CATALOG_SCHEMAS) | low.rlike(r"^(?:#|@|tmp_|temp_)")


def phase_runs(phase: float, start: float | None, skipped: list[str]) -> bool:
    """Whether a phase runs when a scan begins at another and some are left out."""
    return (start is None or phase >= start) and str(phase) not in skipped and str(int(phase)) not in [s for s in skipped if phase == int(phase)]
