"""Symbols and facts from source texts, one text at a time on the executors.

A parser is a function (path, text) -> rows of NODE. It never raises for bad
input: what can't be read gives no rows. Parsers are registered by language.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

NODE = ["qualified_name", "name", "node_type", "line_start", "line_end", "detail"]
Row = tuple[str, str, str, int, int, str]
Parser = Callable[[str, str], list[Row]]
PARSERS: dict[str, Parser] = {}


def parser(language: str) -> Callable[[Parser], Parser]:
    """Register a parser for a language."""

    def keep(f: Parser) -> Parser:
        PARSERS[language] = f
        return f

    return keep


def module_of(path: str) -> str:
    return re.sub(r"\.[^./]+$", "", path).replace("/", ".")


def line_at(text: str, pos: int) -> int:
    return text.count("\n", 0, pos) + 1


@parser("python")
def python(path: str, text: str) -> list[Row]:
    """Classes, functions, endpoints by decorator, assignments of literal states; details hold calls and guards."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[Row] = []

    def decorators(n) -> list[str]:
        return [ast.unparse(d) for d in n.decorator_list]

    def calls(n) -> list[str]:
        return sorted({ast.unparse(c.func) for c in ast.walk(n) if isinstance(c, ast.Call)})

    def walk(body, prefix: str, guard: str | None) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                q = f"{prefix}.{n.name}"
                out.append((q, n.name, "class", n.lineno, n.end_lineno or n.lineno, json.dumps({"bases": [ast.unparse(b) for b in n.bases]})))
                walk(n.body, q, guard)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                q, d = f"{prefix}.{n.name}", decorators(n)
                kind = "endpoint" if any(re.search(r"\.(?:route|get|post|put|delete|patch)\(", x) for x in d) else "function"
                out.append((q, n.name, kind, n.lineno, n.end_lineno or n.lineno, json.dumps({"decorators": d, "calls": calls(n)})))
                states(n, q)
                walk([x for x in n.body if isinstance(x, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))], q, guard)

    def states(f, q: str) -> None:
        def inner(body, guard):
            for n in body:
                if isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
                    for t in n.targets:
                        if isinstance(t, ast.Attribute) and t.attr in ("status", "state", "phase", "stage"):
                            out.append((q, t.attr, "transition", n.lineno, n.end_lineno or n.lineno, json.dumps({"on": ast.unparse(t.value), "to": n.value.value, "guard": guard})))
                for child in ("body", "orelse", "finalbody"):
                    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        continue
                    inner(getattr(n, child, []) or [], ast.unparse(n.test) if isinstance(n, ast.If) and child == "body" else guard)

        inner(f.body, None)

    walk(tree.body, module_of(path), None)
    return out


_BRACE_TYPES = r"(?:class|interface|struct|record|enum|trait)"


def braces(path: str, text: str, types: str, methods: str, endpoint: str) -> list[Row]:
    """Types and callables of a language with braces. Ends are found by counting braces outside strings and comments."""
    bare = re.sub(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)

    def end(at: int) -> int:
        depth, i = 0, bare.find("{", at)
        if i < 0:
            return at
        for m in re.compile(r"[{}]").finditer(bare, i):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return m.start()
        return len(text)

    base, out = module_of(path), []
    owners = [(m.start(), line_at(text, end(m.start())), m["name"]) for m in re.finditer(types, bare)]
    for at, stop, name in owners:
        out.append((f"{base}.{name}", name, "class", line_at(text, at), stop, json.dumps({"bases": re.findall(r"[\w.]+", (re.match(r"[^{\n]*?(?:extends|implements|:)\s*([^{\n]*)", bare[at : at + 300]) or ["", ""])[1])})))
    for m in re.finditer(methods, bare, re.M):
        line = line_at(text, m.start())
        inside = [o for o in owners if line_at(text, o[0]) <= line <= o[1]]
        name = m["name"]
        if name in ("if", "for", "while", "switch", "catch", "return", "new", "else", "function", "foreach", "using", "lock"):
            continue
        before = text[max(0, m.start() - 200) : m.start()]
        kind = "endpoint" if re.search(endpoint, before.rsplit("}", 1)[-1]) else "method" if inside else "function"
        stop = end(m.start())
        first = bare.find("{", m.start())
        declared = ";" in re.sub(r"\[[^\]]*\]", "", bare[m.end() : first]) if first > m.end() else first < 0  # without a body
        found = [] if declared else sorted(set(re.findall(r"([A-Za-z_$][\w$.]*)\s*\(", bare[first:stop])))
        q = ".".join([base, *([inside[-1][2]] if inside else []), name])
        out.append((q, name, kind, line, line_at(text, stop), json.dumps({"calls": found})))
    return out


@parser("java")
def java(path: str, text: str) -> list[Row]:
    return braces(path, text, rf"\b{_BRACE_TYPES}\s+(?P<name>\w+)", r"(?:public|private|protected|static|final|abstract|synchronized)\s+[\w<>\[\], .?]+?\s+(?P<name>\w+)\s*\([^;{}]*\)\s*(?:throws [\w, .]+)?\{", r"@(?:Get|Post|Put|Delete|Patch|Request)Mapping")


@parser("csharp")
def csharp(path: str, text: str) -> list[Row]:
    return braces(path, text, rf"\b{_BRACE_TYPES}\s+(?P<name>\w+)", r"(?:public|private|protected|internal|static|async|override|virtual)\s+[\w<>\[\], .?]+?\s+(?P<name>\w+)\s*\([^;{}]*\)\s*\{", r"\[(?:Http(?:Get|Post|Put|Delete|Patch)|Route)")


@parser("javascript")
def javascript(path: str, text: str) -> list[Row]:
    served = [(f"{module_of(path)}.{m[1].upper()} {m[2]}", f"{m[1].upper()} {m[2]}", "endpoint", line_at(text, m.start()), line_at(text, m.start()), json.dumps({"method": m[1].upper(), "path": m[2]})) for m in re.finditer(r"\b(?:app|router|server)\.(get|post|put|delete|patch)\(\s*['\"`](/[^'\"`]*)['\"`]\s*,", text)]
    return served + braces(path, text, r"\bclass\s+(?P<name>\w+)", r"(?:(?:async\s+)?function\s+|^\s*(?:static\s+|async\s+)*|(?:const|let|var)\s+)(?P<name>[\w$]+)\s*(?:=\s*(?:async\s*)?)?\([^;{}]*\)\s*(?:=>\s*)?\{", r"@(?:Get|Post|Put|Delete)\(")


@parser("go")
def go(path: str, text: str) -> list[Row]:
    return braces(path, text, r"\btype\s+(?P<name>\w+)\s+(?:struct|interface)", r"\bfunc\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*\(", r"(?!)")


@parser("php")
def php(path: str, text: str) -> list[Row]:
    return braces(path, text, r"\b(?:class|interface|trait)\s+(?P<name>\w+)", r"\bfunction\s+(?P<name>\w+)\s*\(", r"#\[Route|@Route")


@parser("rust")
def rust(path: str, text: str) -> list[Row]:
    return braces(path, text, r"\b(?:struct|enum|trait)\s+(?P<name>\w+)", r"\bfn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\(", r"#\[(?:get|post|put|delete)\(")


@parser("ruby")
def ruby(path: str, text: str) -> list[Row]:
    """Classes, modules and methods, ended by the `end` of their own indent."""
    out, base, lines, open_ = [], module_of(path), text.split("\n"), []
    for i, line in enumerate(lines, 1):
        m = re.match(r"(\s*)(class|module|def)\s+(?:self\.)?([\w?!]+)", line)
        if m:
            stop = next((j for j in range(i, len(lines)) if re.match(rf"{m[1]}end\b", lines[j])), len(lines) - 1) + 1
            open_ = [o for o in open_ if o[1] > i and len(o[2]) < len(m[1])]
            q = ".".join([base, *(o[0] for o in open_), m[3]])
            out.append((q, m[3], "function" if m[2] == "def" else "class", i, stop, "{}"))
            if m[2] != "def":
                open_.append((m[3], stop, m[1]))
    return out


@parser("vue")
def vue(path: str, text: str) -> list[Row]:
    """The script of a single-file component, and the handlers its template names."""
    m = re.search(r"<script[^>]*>(.*?)</script>", text, re.S)
    shift = line_at(text, m.start(1)) - 1 if m else 0
    out = [(q, n, t, a + shift, b + shift, d) for q, n, t, a, b, d in (javascript(path, m[1]) if m else [])]
    t = re.search(r"<template[^>]*>(.*)</template>", text, re.S)
    for h in re.finditer(r"(?:@|v-on:)[\w.-]+=\"([\w$]+)", t[1] if t else ""):
        out.append((f"{module_of(path)}.{h[1]}", h[1], "template_binding", line_at(text, t.start(1) + h.start()), line_at(text, t.start(1) + h.start()), "{}"))
    return out


@parser("jsp")
def jsp(path: str, text: str) -> list[Row]:
    facts = {"forms": re.findall(r"<form[^>]*action=[\"']([^\"']+)", text), "includes": re.findall(r"<(?:jsp:include|%@\s*include)[^>]*(?:page|file)=[\"']([^\"']+)", text), "title": (re.findall(r"<title>([^<]*)", text) or [None])[0]}
    return [(module_of(path), path.rsplit("/", 1)[-1], "ui_component", 1, text.count("\n") + 1, json.dumps(facts))]


@parser("webforms")
def webforms(path: str, text: str) -> list[Row]:
    facts = {"inherits": (re.findall(r"Inherits=\"([^\"]+)", text) or [None])[0], "events": sorted(set(re.findall(r"\bOn(?:Click|Load|Command|SelectedIndexChanged|TextChanged)=\"(\w+)", text)))}
    return [(module_of(path), path.rsplit("/", 1)[-1], "ui_component", 1, text.count("\n") + 1, json.dumps(facts))]


@parser("openapi")
def openapi(path: str, text: str) -> list[Row]:
    try:
        spec = json.loads(text)
    except ValueError:
        return []
    out = []
    for route, ops in sorted((spec.get("paths") or {}).items()) if isinstance(spec, dict) else []:
        for method, op in sorted(ops.items()) if isinstance(ops, dict) else []:
            if method in ("get", "post", "put", "delete", "patch", "head", "options"):
                name = (op or {}).get("operationId") or f"{method} {route}"
                out.append((f"openapi::{method.upper()} {route}", name, "endpoint", 0, 0, json.dumps({"method": method.upper(), "path": route})))
    return out


@parser("graphql")
def graphql(path: str, text: str) -> list[Row]:
    out = []
    for m in re.finditer(r"\b(type|input|interface|enum)\s+(\w+)[^{]*\{([^}]*)\}", text):
        fields = re.findall(r"^\s*(\w+)\s*(?:\([^)]*\))?\s*:", m[3], re.M)
        if m[2] in ("Query", "Mutation", "Subscription"):
            out += [(f"graphql::{m[2]}.{f}", f, "endpoint", line_at(text, m.start()), line_at(text, m.end()), json.dumps({"kind": m[2]})) for f in fields]
        else:
            out.append((f"graphql::{m[2]}", m[2], "db_model", line_at(text, m.start()), line_at(text, m.end()), json.dumps({"fields": fields})))
    return out


@parser("proto")
def proto(path: str, text: str) -> list[Row]:
    out = []
    for m in re.finditer(r"\b(message|service)\s+(\w+)\s*\{((?:[^{}]|\{[^{}]*\})*)\}", text):
        if m[1] == "message":
            out.append((f"proto::{m[2]}", m[2], "db_model", line_at(text, m.start()), line_at(text, m.end()), json.dumps({"fields": re.findall(r"(\w+)\s*=\s*\d+\s*;", m[3])})))
        else:
            out += [(f"proto::{m[2]}.{r}", r, "endpoint", line_at(text, m.start()), line_at(text, m.end()), "{}") for r in re.findall(r"\brpc\s+(\w+)", m[3])]
    return out


# Images of services that stand beside an application.
BACKING = {"postgres": "database", "mysql": "database", "mariadb": "database", "mongo": "database", "redis": "cache", "memcached": "cache", "rabbitmq": "queue", "kafka": "queue", "elasticsearch": "search", "minio": "storage"}


@parser("compose")
def compose(path: str, text: str) -> list[Row]:
    """Backing services by the images that container files name."""
    out = []
    for m in re.finditer(r"^\s*image:\s*[\"']?([\w./-]+)", text, re.M):
        name = m[1].rsplit("/", 1)[-1]
        kind = next((v for k, v in BACKING.items() if k in name), None)
        if kind:
            out.append((f"external::{name}", name, "external_system", line_at(text, m.start()), line_at(text, m.start()), json.dumps({"kind": kind})))
    return out


def flatten_sql(body: str, fragments: dict[str, str], depth: int = 0) -> str:
    """A mapper's statement as one: includes put in, tags dropped, parameters as ?."""
    if depth < 8:
        body = re.sub(r"<include\s+refid=\"([^\"]+)\"\s*/>", lambda m: flatten_sql(fragments.get(m[1].rsplit(".", 1)[-1], ""), fragments, depth + 1), body)
    body = re.sub(r"<where>", " WHERE ", body)
    body = re.sub(r"<set>", " SET ", body)
    body = re.sub(r"<!\[CDATA\[|\]\]>|<[^>]+>", " ", body)
    body = re.sub(r"\$\{[^}]*\}", "DYN", re.sub(r"#\{[^}]*\}", "?", body))
    body = re.sub(r"&lt;", "<", re.sub(r"&gt;", ">", body))
    return re.sub(r"(?i)\bWHERE\s+(?:AND|OR)\b", "WHERE", re.sub(r"\s+", " ", body)).strip()


@parser("mybatis")
def mybatis(path: str, text: str) -> list[Row]:
    ns = re.search(r"<mapper\s+namespace=\"([^\"]+)\"", text)
    if not ns:
        return []
    fragments = {m[1]: m[2] for m in re.finditer(r"<sql\s+id=\"([^\"]+)\">(.*?)</sql>", text, re.S)}
    return [(f"mybatis::{ns[1]}.{m[2]}", m[2], "sql_statement", line_at(text, m.start()), line_at(text, m.end()), json.dumps({"kind": m[1], "sql": flatten_sql(m[3], fragments)})) for m in re.finditer(r"<(select|insert|update|delete)\s[^>]*?id=\"([^\"]+)\"[^>]*>(.*?)</\1>", text, re.S)]


_NAME = r"[\"`\[]?([A-Za-z_][\w$]*(?:[\"`\]]?\.[\"`\[]?[A-Za-z_][\w$]*)*)[\"`\]]?"
_NOT_TABLES = {"select", "set", "where", "values", "dual", "lateral", "unnest", "only", "table"}


def sql_facts(statement: str) -> dict:
    """Kind, tables read and written, and foreign keys of one SQL statement; common table expressions aren't tables."""
    s = re.sub(r"--[^\n]*|/\*.*?\*/", " ", statement, flags=re.S)
    s = re.sub(r"'(?:''|[^'])*'", "''", s)
    ctes = {c.lower() for c in re.findall(r"(?i)(?:\bwith\s+(?:recursive\s+)?|\)\s*,\s*)(\w+)\s*(?:\([^)]*\))?\s+as\s*\(", s)}
    clean = lambda names: sorted({re.sub(r"[\"`\[\]]", "", n).lower() for n in names} - ctes - _NOT_TABLES)
    kind = re.search(r"(?i)\b(select|insert|update|delete|merge|create|alter|drop|truncate|call|exec(?:ute)?)\b", s)
    writes = re.findall(rf"(?i)\b(?:insert\s+(?:into|overwrite)(?:\s+table)?|merge\s+into|delete\s+from|truncate\s+(?:table\s+)?|replace\s+into)\s+{_NAME}", s) + re.findall(rf"(?i)(?<!for )\bupdate\s+(?!of\b){_NAME}\s+(?:\w+\s+)?set\b", s) + re.findall(rf"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?{_NAME}", s)
    reads = re.findall(rf"(?i)\b(?:from|join|using)\s+{_NAME}", re.sub(r"(?i)\bdelete\s+from\b", "delete", s))
    keys = [{"columns": re.findall(r"\w+", a), "table": re.sub(r"[\"`\[\]]", "", t).lower(), "to": re.findall(r"\w+", b)} for a, t, b in re.findall(rf"(?i)foreign\s+key\s*\(([^)]*)\)\s*references\s+{_NAME}\s*(?:\(([^)]*)\))?", s)]
    if writes and kind and kind[1].lower() == "select":  # behind common table expressions
        kind = re.search(r"(?i)\b(insert|update|delete|merge|create|replace)\b", s) or kind
    return {"kind": kind[1].lower() if kind else None, "reads": clean(reads), "writes": clean(writes), "foreign_keys": keys}


def looks_like_sql(text: str) -> bool:
    return bool(re.match(r"(?is)\s*(?:with|select|insert|update|delete|merge|call|exec)\b", text) and re.search(r"(?is)\b(?:from|into|set|values|where)\b|\bcall\b|\bexec\b", text))


def sql_literals(source: str) -> list[str]:
    """SQL texts in string literals of code; joined literals as one, interpolations as __dyn__."""
    out = []
    for m in re.finditer(r"(?:\"\"\"(.*?)\"\"\"|((?:\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')(?:\s*[+.]\s*(?:\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'))*))", source, re.S):
        t = m[1] if m[1] is not None else "".join(a or b for a, b in re.findall(r"\"((?:\\.|[^\"\\])*)\"|'((?:\\.|[^'\\])*)'", m[2]))
        t = re.sub(r"\$\{[^}]*\}|\{[^}]*\}|%s|#\{[^}]*\}", "__dyn__", t)
        if looks_like_sql(t):
            out.append(t)
    return out


@parser("sql")
def sql(path: str, text: str) -> list[Row]:
    """Procedures and statements of a SQL file."""
    out = [(f"sqlproc::{re.sub(r'[^A-Za-z0-9_.]', '', m[2]).lower()}", m[2], "stored_proc", line_at(text, m.start()), line_at(text, m.end()), "{}") for m in re.finditer(rf"(?i)\bcreate\s+(?:or\s+(?:replace|alter)\s+)?(procedure|function)\s+{_NAME}", text)]
    at = 0
    for part in re.split(r";\s*(?:\n|$)", text):
        if part.strip() and re.match(r"(?is)\s*(?:--[^\n]*\n|\s)*(?:with|select|insert|update|delete|merge|create|alter)\b", part):
            f = sql_facts(part)
            out.append((f"sql::{module_of(path)}.{line_at(text, at)}", f["kind"] or "", "sql_statement", line_at(text, at), line_at(text, at + len(part)), json.dumps(f)))
        at += len(part) + 1
    return out


def parse_files(files: DataFrame, language: str = "language", path: str = "file_path", text: str = "text") -> DataFrame:
    """`file_path`, `qualified_name`, `name`, `node_type`, `line_start`,
    `line_end`, `detail` (JSON) of every symbol of every file, by the parser
    registered for its language. Null texts and unknown languages give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, lang, t in zip(*(c.to_pylist() for c in b.columns)):
                f = PARSERS.get((lang or "").lower())
                if f and t:
                    rows += [(p, *r) for r in f(p or "", t)]
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["file_path", *NODE])

    return files.select(path, language, text).mapInArrow(run, "file_path string, qualified_name string, name string, node_type string, line_start int, line_end int, detail string")


def imports_of(language: str, text: str) -> list[tuple[str, str]]:
    """(module, name) of what a file imports."""
    if language == "python":
        return [(m[1], n.split(" as ")[-1].strip()) for m in re.finditer(r"^\s*from\s+([\w.]+)\s+import\s+\(?([^)\n]+)", text, re.M) for n in m[2].split(",") if n.strip()] + [(m[1], m[1].split(".")[-1]) for m in re.finditer(r"^\s*import\s+([\w.]+)", text, re.M)]
    if language in ("java", "csharp"):
        return [(m[1].rsplit(".", 1)[0], m[1].rsplit(".", 1)[-1]) for m in re.finditer(r"^\s*(?:import(?:\s+static)?|(?:global\s+)?using)\s+([\w.]+)\s*;", text, re.M)]
    if language == "go":
        return [(p, a or p.rsplit("/", 1)[-1]) for a, p in re.findall(r"^\s*(?:import\s+)?(\w+)?\s*\"([\w./-]+)\"\s*$", text, re.M)]
    if language == "rust":
        return [(m[1].rsplit("::", 1)[0], n.strip()) for m in re.finditer(r"\buse\s+([\w:]+)(?:::\{([^}]*)\})?", text) for n in (m[2].split(",") if m[2] else [m[1].rsplit("::", 1)[-1]])]
    if language == "ruby":
        return [(m, m.rsplit("/", 1)[-1]) for m in re.findall(r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)", text, re.M)]
    if language == "php":
        return [(m[1].rsplit("\\", 1)[0], m[2] or m[1].rsplit("\\", 1)[-1]) for m in re.finditer(r"^\s*use\s+([\w\\]+)(?:\s+as\s+(\w+))?\s*;", text, re.M)]
    named = [(m[2], n.split(" as ")[-1].strip()) for m in re.finditer(r"import\s+\{([^}]*)\}\s+from\s+['\"]([^'\"]+)", text) for n in m[1].split(",") if n.strip()]
    return named + [(m[2], m[1]) for m in re.finditer(r"import\s+(\w+)\s+from\s+['\"]([^'\"]+)", text)]


def reexports(text: str) -> list[tuple[str, str]]:
    """(name, module) that a JavaScript barrel file hands on; * for all."""
    return [(n.split(" as ")[-1].strip(), m[2]) for m in re.finditer(r"export\s+\{([^}]*)\}\s+from\s+['\"]([^'\"]+)", text) for n in m[1].split(",") if n.strip()] + [("*", m) for m in re.findall(r"export\s+\*\s+from\s+['\"]([^'\"]+)", text)]


def registrations(text: str) -> list[tuple[str | None, str]]:
    """(interface, class) pairs a C# file registers for injection."""
    two = re.findall(r"\.Add(?:Scoped|Singleton|Transient)<\s*([\w.]+)\s*,\s*([\w.]+)\s*>", text)
    one = [(None, c) for c in re.findall(r"\.Add(?:Scoped|Singleton|Transient|HostedService)<\s*([\w.]+)\s*>", text)]
    return [*two, *one, *re.findall(r"typeof\(([\w.]+)\)\s*,\s*typeof\(([\w.]+)\)", text)]


def routes(text: str) -> list[dict]:
    """Paths and components of a router file, with parents joined."""
    out, stack = [], []
    for m in re.finditer(r"path:\s*['\"]([^'\"]*)['\"]|component:\s*(?:\(\)\s*=>\s*import\(['\"]([^'\"]+)|(\w+))|children:\s*\[|\]", text):
        if m[1] is not None:
            out.append({"path": "/".join(x.strip("/") for x in [*stack, m[1]] if x.strip("/")) or "/", "component": None})
        elif m[2] or m[3]:
            if out:
                out[-1]["component"] = m[2] or m[3]
        elif m[0].startswith("children") and out:
            stack.append(out[-1]["path"])
        elif m[0] == "]" and stack:
            stack.pop()
    return [{**r, "path": "/" + r["path"].lstrip("/")} for r in out]


def menu_items(text: str) -> list[tuple[tuple[str, ...], str | None]]:
    """(labels from the top, path) of the leaves of a JSON menu."""
    try:
        tree = json.loads(text)
    except ValueError:
        return []
    out: list[tuple[tuple[str, ...], str | None]] = []

    def walk(x, labels):
        if isinstance(x, list):
            for y in x:
                walk(y, labels)
        elif isinstance(x, dict):
            label = x.get("label") or x.get("title") or x.get("name") or x.get("text")
            here = (*labels, str(label)) if label else labels
            kids = x.get("children") or x.get("items") or x.get("submenu") or x.get("menu")
            if kids:
                walk(kids, here)
            elif label:
                out.append((here, x.get("path") or x.get("url") or x.get("route") or x.get("href")))
            else:
                for y in x.values():
                    walk(y, labels)

    walk(tree, ())
    return out
