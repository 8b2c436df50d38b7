"""Files that nobody wrote by hand in their project: generated, minified,
vendored, or holding nothing but data.

No labels come with the tables. Signs that settle a case by themselves
(headers tools write, folders and file names by convention, the shape of
packed or tabular text) label a bounded sample of records. On it one linear
support-vector classifier per kind is trained on hashed character n-grams of
the opening comments and of the rest, and on path components. Giveaway headers
are masked from the rest, and names, versions and dates within them; in half
of the sample they are dropped altogether, so body and path are learnt too.
Whole projects are kept apart for validation.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.runtime import cut_lineage, spread

KINDS = ("generated", "vendored", "minified", "data")
BITS = 18  # of the hash of a feature
LOOKED_AT = 20_000  # records that are labelled, at most: of larger tables 19,000 are drawn on average, more than this once in 10 ** 12 times
SAMPLE = 2_000  # labelled records per side that are trained on, at most
HEADER_LINES = 6
CHARS_AT_ONCE = 400_000
KEPT_RECORDS = 300_000  # of which a task remembers what they are

# How tools begin the comment that says a file is theirs.
_MARK = r"^\s*(?:/\*+!?|//+!?|#+!?|\*|<!--|--|;+|%|'|\(\*)?\s*"
GENERATED_HEADER = re.compile(
    _MARK + r"(?:code generated (?:by|from)|@generated\b|<auto-?generated|auto-?generated\b|automatically generated|this (?:file|code|class) (?:is|was|has been) (?:auto|machine|generated|produced)"
    r"|this file was (?:automatically|generated)|(?:generated|produced|written|created) (?:automatically )?(?:by|from|with) \S+[^a-z]*(?:v?\d|do not|; |$)|machine[- ](?:written|generated|made)\b|do not edit|do not modify|hands off"
    r"|automatisch (?:erzeugt|erstellt|generiert)|generiert (?:von|durch|aus)|diese datei wurde|fichier g[ée]n[ée]r[ée]|g[ée]n[ée]r[ée] (?:automatiquement|par)|(?:archivo|fichero|c[óo]digo) generado|generado (?:autom|por)|(?:arquivo|ficheiro|c[óo]digo) gerado|gerado (?:autom|por)"
    r"|(?:plik|kod) wygenerowan|wygenerowan[oy] |(?:файл|код) (?:создан|сгенерирован)|сгенерировано|このファイルは|自動生成|自动生成|本文件由)", re.I | re.M)  # fmt: skip
VENDORED_HEADER = re.compile(
    _MARK + r"(?:@license\b|[\w.@/-]+ v?\d+\.\d+(?:\.\d+)?\S* (?:-|\||by|\(c\)).{0,120}(?:licen[cs]e|\(c\)|copyright)|(?:taken|copied|imported|vendored|mirrored) (?:unchanged |verbatim |as is )?from \S+|upstream(?: file)?[: ]"
    r"|(?:unver[äa]ndert|[üu]bernommen) (?:[üu]bernommen )?aus|repris (?:tel quel )?de|copia de \S+ v?\d)", re.I | re.M)  # fmt: skip
PATHS = {
    "generated": re.compile(r"(?:^|/)(?:__generated__|generated-sources|generated-test-sources|\.generated)/|\.Designer\.\w+$|\.g\.(?:cs|dart|ts)$|\.generated\.\w+$|\.graphql\.ts$|_pb2(?:_grpc)?\.py$|\.pb\.(?:go|h|cc)$|_generated\.\w+$"),
    "vendored": re.compile(r"(?:^|/)(?:node_modules|bower_components|third_party|thirdparty|jspm_packages|Godeps|site-packages)/|^(?:vendor|extern|external|vendored)/|(?:^|/)(?:vendor|extern|external)/[\w.@-]*\d+\.\d+[\w.-]*/"),
    "minified": re.compile(r"[.-]min\.(?:js|css|mjs)$|(?:^|/)(?:public|static|dist|assets)/(?:[^/]*/)*[\w-]+\.[0-9a-f]{8,}\.(?:js|css)$|\.bundle\.js$"),
}
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|<!--|--|;|%|\(\*)")
_CODE = re.compile(r"[A-Za-z_]\w*\s*\(|\b(?:return|class|def|function|public|private|import|if|for|while)\b")
_JSON_LIKE = re.compile(r"\A\s*(?:export default|module\.exports\s*=|(?:export\s+)?(?:const|var|let|static)?\s*[\w.$]+\s*:?=)?\s*[\[{(].*[\]})]\s*;?\s*\Z", re.S)


# A comment line; of a very long line only a comment that is marked as one to its end.
_PIECE = r"(?:/\*[^\n]*?(?:\*/|(?=\n|\Z))|<!--[^\n]*?(?:-->|(?=\n|\Z))|//[^\n]*|(?:#|\*|--|;|%|\(\*)[^\n]{0,398}(?=\n|\Z))"
COMMENT, COMMENTS = re.compile(r"[ \t]*" + _PIECE), re.compile(r"\n([ \t]*" + _PIECE + ")")
# What may stand among the comments that a file begins with.
_PROLOGUE = re.compile(r"\s*(?:$|<\?|<!doctype|package\b|['\"]use strict|@charset)", re.I)
# Giveaways that speak of a whole file wherever they stand; others do so in its opening only.
OF_FILES = re.compile(
    _MARK + r"(?:code generated (?:by|from) .*do not|@generated\b|<auto-?generated|auto-?generated (?:file|by|from)\b|this file (?:is|was|has been) (?:auto|automatically|machine|generated|produced)"
    r"|diese datei wurde (?:automatisch|generiert|erzeugt)|このファイルは.*生成)", re.I | re.M)  # fmt: skip


def opening(text: str) -> str:
    """The comments among the first lines, and all of the block of comments or
    the docstring that a text begins with, however long."""
    out, until, leading = [], "", True
    for k, m in enumerate(re.finditer(r"([^\r\n]*)(?:\r\n|[\r\n]|\Z)", text)):
        x = m[1]
        if k >= HEADER_LINES and not leading:
            break
        if until:
            out.append(x[: x.find(until)] if until in x else x)
            until = "" if until in x else until
        elif (c := COMMENT.match(x)) and (len(x) < 400 or c[0].lstrip().startswith(("/*", "<!--", "//"))):
            out.append(x if len(x) < 400 else c[0])
            mark, end = next((p for p in (("/*", "*/"), ("<!--", "-->"), ("(*", "*)")) if x.lstrip().startswith(p[0])), ("", ""))
            until = end if end and leading and end not in x.lstrip()[len(mark) :] else ""
            leading = leading and len(x) < 400
        elif leading and (d := re.match(r"\s*[rRuU]?(\"\"\"|''')", x)):
            rest = x[d.end() :]
            out.append(rest.split(d[1])[0])
            until = "" if d[1] in rest else d[1]
        else:
            leading = leading and bool(_PROLOGUE.match(x))
        if m.end() == len(text):
            break
    return "\n".join(out)


def comments(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and text of the comment lines."""
    for m in COMMENTS.finditer("\n" + text.replace("\r", "\n")):
        yield m.start(1) - 1, m.end(1) - 1, m[1]


def giveaways(text: str) -> list[tuple[int, int]]:
    """Where the comment lines of a text stand that say what it is."""
    return [(a, b) for a, b, x in comments(text) if GENERATED_HEADER.match(x) or VENDORED_HEADER.match(x)]


def mask(header: str) -> str:
    """A header without names, versions, dates and numbers."""
    return re.sub(r"\S*\d\S*|\S*[/\\._-]\S*\w", "#", re.sub(r"[ \t]+", " ", header)).lower()


def body_kind(text: str) -> str | None:
    """'minified' or 'data' if the shape of a text leaves no doubt."""
    lines = [x for x in re.split(r"\r\n|[\r\n]", text) if x.strip()]
    if not lines or len(text) < 300:
        return None
    code = [x for x in lines if not _COMMENT.match(x) and not x.strip().startswith(("<?", "*/"))] or lines
    size = sum(map(len, code))
    packed = sum(len(x) for x in code if len(x) > 250 and len(re.findall(r"[;{}()]", x)) > len(x) / 25 and len(re.findall(r"\s", x)) < len(x) / 8)
    if packed > 0.6 * size and size > 400:
        return "minified"
    blob = sum(len(x) for x in lines if re.fullmatch(r"\s*[\"']?[A-Za-z0-9+/=]{56,}[\"']?[,+;]?\s*", x) and re.search(r"\d", x))
    if blob > 0.7 * sum(map(len, lines)):
        return "data"
    n_code = len(_CODE.findall(text))
    fields = {x.count(s) for s in ";" for x in code} if all(";" in x for x in code) else set()
    if len(code) >= 8 and len(fields) == 1 and fields.pop() >= 2 and n_code == 0:
        return "data"
    digits = sum(len(x) for x in re.findall(r"-?\d+(?:\.\d+)?|[,;|\[\]{}]", text))
    if digits > 0.5 * len(text) or (n_code <= 1 and _JSON_LIKE.match(text) and len(re.findall(r"[\"']?\w+[\"']?\s*:|,", text)) > len(text) / 40):
        return "data"
    return None


# Endings of configuration files, where a table of settings is what people write.
_CONFIG = re.compile(r"\.(?:json|ya?ml|xml|config|env|properties|toml|ini|cfg|conf)$")


def label(path: str | None, text: str | None, body: bool = True) -> set[str]:
    """The kinds whose signs a record bears; without `body` the text's shape isn't looked at."""
    return signs_beside_header(path, text, body) | header_signs(text)


def header_signs(text: str | None) -> set[str]:
    """The kinds that a text's comments say it is of."""
    out, head = set(), opening(text or "")
    if GENERATED_HEADER.search(head) or any(OF_FILES.match(x) for _, _, x in comments(text or "")):
        out.add("generated")
    if VENDORED_HEADER.search(head):
        out.add("vendored")
    return out


def signs_beside_header(path: str | None, text: str | None, body: bool = True) -> set[str]:
    path, text, out = path or "", text or "", set()
    out |= {k for k, p in PATHS.items() if p.search(path)}
    if body and (kind := body_kind(text)) and not (kind == "data" and _CONFIG.search(path) and not text.lstrip().startswith("[")):
        out.add(kind)
    return out


def _hash(a: np.ndarray) -> np.ndarray:
    a = a * np.uint64(0xD6E8FEB86659FD93)
    return ((a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)


def _number(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


def path_features(path: str, language: str | None) -> list[str]:
    parts = [re.sub(r"[0-9a-f]{8,}", "<hex>", p) for p in path.split("/")]
    dirs, name = parts[:-1], parts[-1]
    shape = [re.sub(r"\d+", "0", re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", d))) for d in dirs]
    stem, *ends = name.split(".")
    last = re.sub(r"\d\d+$", "", re.split(r"[_-]", stem)[-1])
    out = ["top=" + (dirs[0] if dirs else ""), "ends=." + ".".join(ends), "ext=" + (ends[-1] if ends else "")]
    out += [f"dir={d}" for d in dirs] + [f"two={a}/{b}" for a, b in zip(dirs, dirs[1:])] + [f"under={a}/{s}" for a, s in zip(dirs, shape[1:])]
    return [*out, "last=" + last, f"lang={(language or '').lower()}", f"ext|lang={ends[-1] if ends else ''}|{(language or '').lower()}"]


@lru_cache(maxsize=100_000)
def _path_columns(path: str, language: str | None) -> np.ndarray:
    return np.array([_number(f) >> (64 - BITS) for f in path_features(path, language)], np.int64)


_CLASS = np.zeros(128, np.uint64)
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = ord("a") if _c.islower() else ord("A") if _c.isupper() else ord("0") if _c.isdigit() else _i


def _grams(text: str, n: int, salt: int, shape: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a joined text and the place where each begins."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = np.arange(len(chars))
    if shape:  # runs of one class of characters count as one
        chars = np.where(chars < 128, _CLASS[np.minimum(chars, np.uint64(127))], np.uint64(ord("u")))
        keep = np.concatenate([[True], (chars[1:] != chars[:-1]) | (chars[1:] < 48) | (chars[1:] > 122)])
        chars, at = chars[keep], at[keep]
    if len(chars) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.full(len(chars) - n + 1, salt, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + chars[i : len(chars) - n + 1 + i]
    return _hash(h), at[: len(h)]


# length of the n-grams, salt, of the shape; the first group is of openings, the others of the rest
HEAD_GRAMS = [(4, 11, False), (7, 12, False)]
BODY_GRAMS = [(4, 21, False), (5, 22, True), (8, 23, True)]


def parts_of(text: str | None) -> tuple[str, str]:
    """The masked opening, and the rest without giveaway headers."""
    text = text or ""
    head = opening(text)
    rest, at = [], 0
    for a, b in giveaways(text):
        rest.append(text[at:a])
        at = b
    rest = "".join(rest) + text[at:]
    for x in head.split("\n"):  # those of a block or docstring whose lines bear no mark
        if x and (GENERATED_HEADER.search(x) or VENDORED_HEADER.search(x)):
            rest = rest.replace(x, "", 1)
    return (" ".join("^" + mask(x) for x in head.split("\n")) if head else ""), rest


@dataclass
class Rows:
    """Features of some records: columns and values of row i lie between ends[i] and ends[i + 1]."""

    ends: np.ndarray
    cols: np.ndarray
    vals: np.ndarray

    def dots(self, w: np.ndarray) -> np.ndarray:
        n = len(self.ends) - 1
        return np.bincount(np.repeat(np.arange(n), np.diff(self.ends)), w[self.cols] * self.vals, n)


def _pieces(strings: tuple[str, ...], grams: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each kind of n-gram: the record and column of every one, in order of
    records, and how many each record has."""
    n = len(strings)
    sizes = np.array([len(x) + 1 for x in strings])
    ends = np.cumsum(sizes) - 1
    owner = np.repeat(np.arange(n), sizes)
    joined = "\0".join(strings) + "\0"
    for size, salt, shape in grams:
        h, at = _grams(joined, size, salt, shape)
        row = owner[at]
        inside = at + (0 if shape else size) <= ends[row]
        row = row[inside]
        yield row, h[inside].astype(np.int64), np.bincount(row, minlength=n)


def _grouped(strings: tuple[str, ...], grams: list, power: float, scale: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [(row, col, (scale / np.maximum(total, 1) ** power)[row]) for row, col, total in _pieces(strings, grams)]


def _rows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, compact: bool) -> Rows:
    row, col, val = (np.concatenate(x) for x in zip(*parts))
    if compact:  # one entry per column
        both, at = np.unique(row.astype(np.int64) << BITS | col, return_inverse=True)
        row, col, val = both >> BITS, both & (1 << BITS) - 1, np.bincount(at, val)
    elif len(parts) > 1:
        order = np.argsort(row, kind="stable")
        row, col, val = row[order], col[order], val[order]
    return Rows(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), col.astype(np.int32), val.astype(np.float32))


def features(paths: list[str | None], languages: list[str | None], texts: list[str | None], compact: bool = False) -> tuple[Rows, Rows]:
    """n-grams of the openings; n-grams of the rest, and path components."""
    n = len(paths)
    heads, bodies = zip(*map(parts_of, texts))
    c = [_path_columns(p or "", languages[i]) for i, p in enumerate(paths)]
    path = (np.repeat(np.arange(n), [len(x) for x in c]), np.concatenate(c), np.full(sum(map(len, c)), 1 / np.sqrt(10)))
    return _rows(_grouped(heads, HEAD_GRAMS, 0.5, 1.0), n, compact), _rows([*_grouped(bodies, BODY_GRAMS, 1.0, 5.0), path], n, compact)


def blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of records of about CHARS_AT_ONCE characters."""
    i, upto = 0, np.cumsum(sizes)
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHARS_AT_ONCE)))
        yield i, min(j, len(sizes))
        i = j


def _stacked(parts: list[Rows]) -> Rows:
    shift = np.cumsum([0, *(len(p.cols) for p in parts)])
    return Rows(np.concatenate([[0], *(p.ends[1:] + o for p, o in zip(parts, shift))]), np.concatenate([p.cols for p in parts]), np.concatenate([p.vals for p in parts]))


def train(head: Rows, rest: Rows, at: np.ndarray, with_head: np.ndarray, wanted: np.ndarray, epochs: int = 8, c: float = 16.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under hinge loss, by dual
    coordinate descent. Case i is row at[i], with or without its opening. Rare
    cases weigh up to ten times as much as others."""
    n = len(at)
    y = np.where(wanted, 1.0, -1.0)
    cost = np.where(wanted, c * min(10.0, (~wanted).sum() / max(1, wanted.sum())), c)
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(n)
    norm = lambda r: np.add.reduceat(np.append(r.vals.astype(np.float64) ** 2, 0.0), r.ends[:-1]) * (np.diff(r.ends) > 0)
    square = norm(rest)[at] + np.where(with_head, norm(head)[at], 0.0) + 1.0
    rng = np.random.default_rng(seed)
    for turn in range(epochs):
        # Most cases lie beyond the margin; they are visited in the first and last turns only.
        visited = np.arange(n) if turn < 2 or turn == epochs - 1 else np.flatnonzero(alpha > 0)
        for i in rng.permutation(visited):
            r = at[i]
            x, z = rest.ends[r], rest.ends[r + 1]
            k, v = rest.cols[x:z], rest.vals[x:z]
            dot = w[k] @ v + bias
            if with_head[i]:
                x, z = head.ends[r], head.ends[r + 1]
                hk, hv = head.cols[x:z], head.vals[x:z]
                dot += w[hk] @ hv
            new = min(max(alpha[i] - (y[i] * dot - 1) / square[i], 0.0), cost[i])
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[k] += d * v  # no column stands twice in a row
                if with_head[i]:
                    w[hk] += d * hv
                bias += d
                alpha[i] = new
    return w.astype(np.float32), float(bias)


def score(paths: list[str | None], languages: list[str | None], texts: list[str | None], weights: np.ndarray, biases: np.ndarray) -> np.ndarray:
    """Margins, one row per record and one column per kind: what features() and
    the weights give, summed on the way. `weights` has a row per column of the
    features, so one look-up serves all kinds."""
    n = len(paths)
    heads, bodies = zip(*map(parts_of, texts))
    out = np.tile(biases, (n, 1))
    for strings, grams, power, scale in ((heads, HEAD_GRAMS, 0.5, 1.0), (bodies, BODY_GRAMS, 1.0, 5.0)):
        for row, col, total in _pieces(strings, grams):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else []
            if len(first):
                out[row[first]] += np.add.reduceat(weights[col], first, axis=0) * (scale / total[row[first]] ** power)[:, None]
    for i, p in enumerate(paths):
        out[i] += weights[_path_columns(p or "", languages[i])].sum(0) / np.sqrt(10)
    return out


UNSURE = (-1.0, 0.5)  # between these margins the exact signs decide


def settle(margin: np.ndarray, paths: list, texts: list) -> np.ndarray:
    """The margins, with those near the boundary settled by the signs a record bears."""
    near = (margin > UNSURE[0]) & (margin < UNSURE[1])
    for i in np.flatnonzero(near.any(1)):
        signs = label(paths[i], texts[i], bool(near[i, 2:].any()))
        for k, kind in enumerate(KINDS):
            if near[i, k]:
                margin[i, k] = UNSURE[1] if kind in signs else UNSURE[0]
    return margin


def sample(nodes: DataFrame, repository: str, looked_at: int = LOOKED_AT, size: int = SAMPLE) -> DataFrame:
    """At most `size` records that bear a sign and as many that bear none, of
    a draw of `looked_at` records; labels are made on executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bare = [signs_beside_header(p, t) for p, t in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
            kinds = [x | header_signs(t) for x, t in zip(bare, b.column(3).to_pylist())]
            told = [pa.array([sorted(x) for x in y], pa.list_(pa.string())) for y in (kinds, bare)]
            yield pa.RecordBatch.from_arrays([*b.columns, *told], names=["repository", "file_path", "language", "text", "h", "kinds", "bare"])

    rows = nodes.select(F.col(repository).cast("string").alias("repository"), "file_path", "language", F.col("source_code").alias("text"))
    rows = spread(rows)
    # A draw by row number, not by content: copies of one record can't fill it. Each task draws its own rows, nothing is gathered.
    share = min(1.0, 0.95 * looked_at / max(1, nodes.count()))
    drawn = rows.withColumn("h", F.xxhash64(F.monotonically_increasing_id()))
    if share < 1:
        drawn = drawn.where(F.col("h") < F.lit(int(-(2**63) + share * (2**64 - 1))))
    labelled = drawn.mapInArrow(run, "repository string, file_path string, language string, text string, h long, kinds array<string>, bare array<string>")
    kept = cut_lineage(labelled)
    marked, plain = kept.where(F.size("kinds") > 0), kept.where(F.size("kinds") == 0)
    return marked.orderBy("h").limit(size).unionByName(plain.orderBy("h").limit(size))


UNTRAINED = -0.25  # the margin of a kind without a labelled case: its signs decide


@dataclass
class Model:
    weights: np.ndarray  # one row per kind
    biases: np.ndarray
    report: dict[str, dict[str, float]]  # precision and recall on projects kept apart


def fit(paths: list, languages: list, texts: list, kinds: list, repositories: list, validate: bool = True, only: str | None = None, bare: list | None = None) -> Model:
    """Train all classifiers, or `only` one, on the records as they are and once more without
    their openings, as far as body or path bear a sign too. A fifth of the
    projects is kept apart for the report; the classifiers handed out are
    trained on all."""
    n = len(paths)
    weights, biases = np.zeros((len(KINDS), 1 << BITS), np.float32), np.full(len(KINDS), UNTRAINED)
    report: dict[str, dict[str, float]] = {}
    if not n:
        return Model(weights, biases, report)
    as_is = np.array([[k in row for k in KINDS] for row in kinds], bool)
    bare = bare or [signs_beside_header(p, t) for p, t in zip(paths, texts)]
    without = np.array([[k in row for k in KINDS] for row in bare], bool)
    heads, rests = zip(*(features(paths[i:j], languages[i:j], texts[i:j], True) for i, j in blocks(np.array([len(t or "") for t in texts]))))
    head, rest = _stacked(list(heads)), _stacked(list(rests))
    second = np.flatnonzero(without.any(1) | ~as_is.any(1))
    at, with_head = np.concatenate([np.arange(n), second]), np.arange(n + len(second)) < n
    wanted = np.concatenate([as_is, without[second]])
    apart = np.array([_number(str(r)) % 5 == 0 for r in repositories], bool)
    for i, kind in enumerate(KINDS):
        if not as_is[:, i].any() or only not in (None, kind):
            continue
        if validate and apart.any() and as_is[~apart, i].any():
            keep = ~apart[at]
            w, b = train(head, rest, at[keep], with_head[keep], wanted[keep, i])
            said = head.dots(w) + rest.dots(w) + b > 0
            hit = (said & as_is[:, i] & apart).sum()
            report[kind] = {"precision": float(hit / max(1, (said & apart).sum())), "recall": float(hit / max(1, (as_is[:, i] & apart).sum())), "cases": int((as_is[:, i] & apart).sum())}
        weights[i], biases[i] = train(head, rest, at, with_head, wanted[:, i])
    return Model(weights, biases, report)


def trained(nodes: DataFrame, repository: str = "scan_id", validate: bool = False) -> Model:
    """A model for these records, trained by one task per kind on at most
    2 * SAMPLE of them. Only the weights come to the driver: one array of
    2 ** BITS a kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (batches := [b for b in batches if b.num_rows]):
            return
        whole = pa.Table.from_batches(batches)
        for which in sorted(set(whole.column("which").to_pylist())):
            t = whole.filter(pc.equal(whole.column("which"), which)).to_pydict()
            model = fit(t["file_path"], t["language"], t["text"], t["kinds"], t["repository"], validate, KINDS[which], t["bare"])
            yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([model.weights[which].tobytes()]), pa.array([float(model.biases[which])]), pa.array([json.dumps(model.report)])], names=["which", "weights", "bias", "report"])

    each = sample(nodes, repository).withColumn("which", F.explode(F.array(*map(F.lit, range(len(KINDS))))))
    rows = each.repartitionByRange(len(KINDS), "which").mapInArrow(run, "which int, weights binary, bias double, report string").collect()  # a row per kind
    out = fit([], [], [], [], [])
    for r in rows:
        out.weights[r.which], out.biases[r.which] = np.frombuffer(r.weights, np.float32), r.bias
        out.report.update(json.loads(r.report))
    return out


def margins(nodes: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """`keys` and `margins` (one number per kind, positive: it is one) of every
    record that is of some kind."""
    shared = nodes.sparkSession.sparkContext.broadcast((np.ascontiguousarray(model.weights.T), model.biases))
    kinds = ", ".join(f"`{k}` {nodes.schema[k].dataType.simpleString()}" for k in keys)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, biases = shared.value
        kept: dict[bytes, np.ndarray | None] = {}  # what copies of a record are of is found once
        for b in batches:
            columns = [b.column(width + k).to_pylist() for k in range(3)]
            prints = [xxhash.xxh3_128_digest("\0".join(x or "" for x in row).encode("utf-8", "surrogatepass")) for row in zip(*columns)]
            new = list({p: i for i, p in enumerate(prints) if p not in kept}.values())
            for x, y in blocks(np.array([len(columns[2][i] or "") for i in new], np.int64)):
                part = [[c[i] for i in new[x:y]] for c in columns]
                m = settle(score(*part, weights, biases), part[0], part[2])
                kept.update((prints[i], row if (row > 0).any() else None) for i, row in zip(new[x:y], m))
            hit = [i for i, p in enumerate(prints) if kept[p] is not None]
            part = b.take(pa.array(hit, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array([list(map(float, kept[prints[i]])) for i in hit], pa.list_(pa.float64()))], names=[*keys, "margins"])
            if len(kept) > KEPT_RECORDS:
                kept.clear()

    picked = spread(nodes.select(*keys, F.col("file_path").alias("_p"), F.col("language").alias("_l"), F.col("source_code").alias("_t")))
    return picked.mapInArrow(run, f"{kinds}, margins array<double>")


def report(nodes: DataFrame, scans: DataFrame) -> DataFrame:
    """`kind`, `precision`, `recall`, `cases` against the labels, on projects kept
    apart: all scans of a project are on one side."""
    project = scans.select(F.col("id").alias("scan_id"), "project_slug").groupBy("scan_id").agg(F.min("project_slug").alias("project_slug"))
    told = trained(nodes.join(project, "scan_id", "left"), "project_slug", True).report
    return nodes.sparkSession.createDataFrame([(k, r["precision"], r["recall"], r["cases"]) for k, r in told.items()], "kind string, precision double, recall double, cases long")


def not_handwritten(nodes: DataFrame, model: Model | None = None) -> DataFrame:
    """`scan_id`, `file_path`, `kinds` of the files of which some record is
    classified as generated, vendored, minified or data.

    Records without text are judged by their path. Null paths and languages
    are empty ones; repeated rows change nothing; an empty table gives no
    files, and of a kind without a labelled case only the signs tell. Every record is
    classified; only training uses a sample.
    """
    model = model or trained(nodes)
    hits = margins(nodes, ["scan_id", "file_path"], model)
    named = F.filter(F.transform("margins", lambda m, i: F.when(m > 0, F.element_at(F.array(*map(F.lit, KINDS)), (i + 1).cast("int")))), lambda k: k.isNotNull())
    return hits.select("scan_id", "file_path", F.explode(named).alias("kind")).groupBy("scan_id", "file_path").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
