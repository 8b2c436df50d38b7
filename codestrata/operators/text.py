"""Full-text search, name look-up, text rules and chunking, as Column expressions where they can be."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

K1, B = 1.2, 0.75
COLUMN_WEIGHTS = {"title": 10.0, "body": 1.0, "facts": 2.0}
RRF_K, RRF_DEPTH = 60, 50
TOKEN = r"[\p{L}\p{N}]+"


# Latin letters with marks and the letters without, by Unicode's own decomposition.
MARKED = [(chr(c), d[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
MARKED_FROM, MARKED_TO = ("".join(x) for x in zip(*MARKED))


def without_marks(text: Column) -> Column:
    """A text whose Latin letters bear no diacritics, composed or combining."""
    return F.translate(F.regexp_replace(text, r"[\x{300}-\x{36F}]", ""), MARKED_FROM, MARKED_TO)


def tokens(text: Column) -> Column:
    """Lower-cased words of a text without diacritics; none for null."""
    return F.coalesce(F.transform(F.regexp_extract_all(without_marks(text), F.lit(TOKEN), F.lit(0)), F.lower), F.array().cast("array<string>"))


def build_index(pages: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """`key`, `token`, `col`, `tf` of every word of every column, and `key`, `length` of every page."""
    parts = [pages.select(key, F.lit(c).alias("col"), F.explode(tokens(F.col(c))).alias("token")) for c in columns]
    words = parts[0]
    for p in parts[1:]:
        words = words.unionByName(p)
    postings = words.groupBy(key, "token", "col").agg(F.count("*").alias("tf"))
    size = sum((F.size(tokens(F.col(c))) for c in columns), F.lit(0))
    return postings, pages.select(key, size.alias("length"))


def bm25(postings: DataFrame, lengths: DataFrame, key: str, query: str, weights: dict[str, float] = COLUMN_WEIGHTS) -> DataFrame:
    """`key`, `score` of the pages that hold a word with every prefix of the
    query, best first by score. A query without words finds nothing."""
    import re

    bare = "".join(c for c in unicodedata.normalize("NFD", query) if not "\u0300" <= c <= "\u036f")
    prefixes = [p.lower() for p in re.findall(r"[^\W_]+", bare)]
    if not prefixes:
        return lengths.select(key, F.lit(0.0).alias("score")).limit(0)
    stats = lengths.agg(F.count("*").alias("n_pages"), F.avg("length").alias("avg_length"))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("col")), F.lit(1.0))
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("token").startswith(p)
    # Said of the token itself, it holds before postings are counted and shuffled.
    per = postings.where(wanted).select(key, F.explode(F.filter(F.array(*map(F.lit, prefixes)), lambda p: F.col("token").startswith(p))).alias("prefix"), (F.col("tf") * weight).alias("w"))
    freq = per.groupBy(key, "prefix").agg(F.sum("w").alias("f"))
    df = freq.groupBy("prefix").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n_pages") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    term = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    scored = freq.join(F.broadcast(df), "prefix").join(lengths, key).join(F.broadcast(stats)).groupBy(key).agg(F.sum(term).alias("score"), F.count("*").alias("_n"))
    return scored.where(F.col("_n") == len(set(prefixes))).drop("_n")


def contains_any(pages: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Pages with the query in any column, whatever the case of ASCII letters: for stores without an index."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False))
    return pages.where(hit)


def name_tier(name: Column, query: str) -> Column:
    """0 the name, 1 a dotted ending of it, 2 anywhere in it; null for no match."""
    q = query.lower()
    return F.when(F.lower(name) == q, 0).when(F.lower(name).endswith("." + q), 1).when(F.instr(F.lower(name), q) > 0, 2)


def find_symbols(symbols: DataFrame, name: str, query: str, k: int = RRF_DEPTH) -> DataFrame:
    """The `k` best symbols: by tier, then length, then name."""
    return symbols.withColumn("tier", name_tier(F.col(name), query)).where("tier is not null").orderBy("tier", F.length(name), name).limit(k)


def fuse(lists: dict[str, DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """`key`, `score`, `sources` of ranked lists (`key`, `rank` from 1): the sum of 1 / (k + rank)."""
    both = None
    for name, df in lists.items():
        one = df.select(key, "rank", F.lit(name).alias("source"))
        both = one if both is None else both.unionByName(one)
    return both.groupBy(key).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 5).alias("score"), F.concat_ws(",", F.sort_array(F.collect_set("source"))).alias("sources"))


def ranked(df: DataFrame, *order: Column, k: int = RRF_DEPTH) -> DataFrame:
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def plain_snippet(text: Column) -> Column:
    """Without code fences, marks and repeated blanks."""
    t = F.regexp_replace(text, r"(?s)```.*?```", " ")
    t = F.regexp_replace(t, r"[#*_`>|]+", " ")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def chunk_hash(path: Column, qn: Column, index: Column, text: Column) -> Column:
    """Identity of a chunk's content."""
    zero = F.lit("\0")
    return F.sha2(F.concat(F.coalesce(path, F.lit("")), zero, F.coalesce(qn, F.lit("")), zero, F.coalesce(index.cast("string"), F.lit("")), zero, F.coalesce(text, F.lit(""))), 256)


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, `pos`, `heading`, `body`: a Markdown text cut before its second-level headings, front matter left out."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"(?s)\A---\n.*?\n---\n", "")
    parts = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(clean, r"(?m)^(?=## )")).alias("pos", "part"))
    heading = F.regexp_extract("part", r"\A## +([^\n]*)", 1)
    body = F.regexp_replace("part", r"\A## [^\n]*\n?", "")
    return parts.select(key, "pos", F.trim(heading).alias("heading"), F.trim(body).alias("body")).where("heading <> '' or body <> ''")


def facts_text(facts: Column) -> Column:
    """The values of a JSON text, strings, numbers and nested ones, without its
    keys, as words for the index. Null and broken texts give an empty one."""
    bare = F.regexp_replace(facts, r'"(?:[^"\\]|\\.)*+"\s*:', " ")
    values = F.regexp_extract_all(bare, F.lit(r'"(?:[^"\\]|\\.)*+"|-?\d+(?:\.\d+)?(?=\s*[,}\]])'), F.lit(0))
    return F.coalesce(F.array_join(F.transform(values, lambda v: F.regexp_replace(F.regexp_replace(v, r'^"|"$', ""), r'\\(["\\/])', "$1")), " "), F.lit(""))


def token_estimate(text: Column) -> Column:
    return F.floor(F.coalesce(F.char_length(text), F.lit(0)) / 4)


@F.pandas_udf(DoubleType())
def gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two short strings; null with null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def snake_stem(name: Column) -> Column:
    """camelCase to snake_case, singular."""
    s = F.lower(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_"))
    return F.when(s.endswith("ies"), F.concat(F.substr(s, F.lit(1), F.length(s) - 3), F.lit("y"))).when(s.endswith("ses"), F.substr(s, F.lit(1), F.length(s) - 2)).when(s.endswith("s") & ~s.endswith("ss"), F.substr(s, F.lit(1), F.length(s) - 1)).otherwise(s)


# Layer words that say nothing about the thing itself.
LAYER_ENDS = ["Controller", "Service", "Repository", "Handler", "Manager", "Entity", "Model", "Dto", "DTO", "Impl", "Store", "Record", "Policy", "View", "Page"]
LAYER_STARTS = ["Abstract", "Base", "Default", "I(?=[A-Z])"]


def layer_stem(name: Column) -> Column:
    """Lower-cased name without layer prefix, suffixes and plural."""
    s = F.regexp_replace(name, "^(?:" + "|".join(LAYER_STARTS) + ")", "")
    s = F.regexp_replace(s, "(?:" + "|".join(LAYER_ENDS) + ")+$", "")
    low = F.lower(F.when(s == "", name).otherwise(s))
    return F.when(low.endswith("s") & ~low.endswith("ss") & (F.length(low) > 3), F.substr(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def loose_stem(name: Column) -> Column:
    """Lower case, one known ending and a trailing s removed."""
    s = F.lower(F.regexp_replace(name, "(?:" + "|".join(LAYER_ENDS) + ")$", ""))
    return F.when(s.endswith("s"), F.substr(s, F.lit(1), F.length(s) - 1)).otherwise(s)


# Folders and name parts that name no domain.
NO_DOMAIN = ["com", "org", "net", "io", "src", "main", "java", "app", "lib", "internal", "core", "common", "shared", "utils", "util", "config", "test", "tests", "controllers", "services", "models", "api"]


def infer_domain(qn: Column, path: Column) -> Column:
    """The first telling part of the qualified name, else of the path's folders; null if there is none."""
    pick = lambda parts: F.get(F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(NO_DOMAIN)), F.lit(0))
    words = F.split(qn, r"\.")
    return F.lower(F.coalesce(pick(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))), pick(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))))))


# What a verb says a flow is for, in order.
INTENTS = [("create", r"^(?:create|add|register|store|post|open|attach|allocate|schedule)"), ("delete", r"^(?:delete|remove|drop|cancel|revoke|unlink|detach|archive)"), ("update", r"^(?:update|set|change|replace|adjust|resume|hold|defer|settle|scale|trim|pad)"), ("read", r"^(?:get|find|list|load|fetch|read|search|show|render|compare|match|rank|check)"), ("notify", r"^(?:notify|emit|send|publish|escalate)")]


def intent(name: Column) -> Column:
    """What a flow named so is for; 'other' if no verb tells."""
    low, out = F.lower(F.regexp_replace(name, "_", "")), None
    for word, pattern in INTENTS:
        out = F.when(low.rlike(pattern), word) if out is None else out.when(low.rlike(pattern), word)
    return out.otherwise("other")


# Forms of secrets that are masked in answers.
SECRET_FORMS = [
    r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b",
    r"\beyJ[\w-]+\.eyJ[\w-]+\.[\w-]+\b", r"\bsk_(?:live|test)_[A-Za-z0-9]{16,}\b", r"\bAIza[\w-]{35}\b", r"(?i)\bbearer +[\w.~+/-]{16,}=*", r"(?<=://)[^\s:/@]+:[^\s/@]+(?=@)",
]
SECRET_KEY = r"(?i)pass(?:word|wd|phrase)?|secret|token|api[_-]?key|private[_-]?key|credential|authorization"


def is_secret_key(name: Column) -> Column:
    return name.rlike(SECRET_KEY)


def mask_forms(text: Column) -> tuple[Column, Column]:
    """The text with known forms masked, and how many were."""
    n, out = F.lit(0), text
    for p in SECRET_FORMS:
        n = n + F.coalesce(F.regexp_count(out, F.lit(p)), F.lit(0))
        out = F.regexp_replace(out, p, "[masked]")
    return out, n


# Text that tries to steer a reader that is a program.
INSTRUCTION = r"(?i)\b(?:ignore|disregard|forget) (?:all |any )?(?:previous|prior|above|earlier) (?:instructions|prompts?|rules)|\byou are now\b|\bsystem prompt\b|\bact as (?:an?|the) "
HIDDEN = r"[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"


def injection_flags(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, `kind`, `line` of the first suspicious place of each kind."""
    parts = []
    for kind, p in (("instruction", INSTRUCTION), ("hidden_unicode", HIDDEN), ("encoded_comment", r"(?:#|//|<!--)\s*[A-Za-z0-9+/]{80,}={0,2}")):
        at = F.regexp_instr(F.col(text), F.lit(p))
        line = F.length(F.regexp_replace(F.substr(F.col(text), F.lit(1), at), r"[^\n]", "")) + 1
        parts.append(docs.where(at > 0).select(key, F.lit(kind).alias("kind"), line.alias("line")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def code_references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, `ref`: names in back-ticks, each once per text."""
    return docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"`([A-Za-z_][\w.]*)`"), F.lit(1))).alias("ref")).distinct()


def ungrounded(references: DataFrame, known: DataFrame, ref: str = "ref") -> DataFrame:
    """References to names that no symbol has, whole or as a part."""
    return references.join(known.select(F.col("name").alias(ref)).distinct(), ref, "left_anti")


def known_names(nodes: DataFrame) -> DataFrame:
    """`name`: all names, qualified names and their parts."""
    return nodes.select(F.explode(F.array_union(F.array("name", "qn"), F.split("qn", r"\."))).alias("name")).where("name is not null").distinct()


def page_id(kind: Column, key: Column) -> Column:
    return F.concat_ws(":", kind, F.regexp_replace(key, r"\s+", "-"))


def clean_diagram(text: Column) -> Column:
    """Labels of a diagram without characters that end them."""
    return F.regexp_replace(F.regexp_replace(text, r"[\[\]{}()\"<>|]", " "), r"\s+", " ")


def json_in_text(text: Column) -> Column:
    """The outermost JSON object of a text, null if it can't be read."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def normal_route(path: Column) -> Column:
    """Parameters as *, query and trailing slash dropped, lower case."""
    p = F.regexp_replace(F.substring_index(F.coalesce(path, F.lit("")), "?", 1), r"\{[^}/]*\}|:[A-Za-z_]\w*|\$\{[^}]*\}|<[^>/]*>", "*")
    p = F.lower(F.regexp_replace(p, r"/+$", ""))
    return F.when(p == "", "/").otherwise(p)


def normal_url(url: Column) -> Column:
    """Host dropped; parameters, numbers and ids as {}."""
    p = F.regexp_replace(F.regexp_replace(F.substring_index(url, "?", 1), r"^[a-z][a-z0-9+.-]*://[^/]*", ""), r"/+$", "")
    seg = F.transform(F.split(p, "/"), lambda s: F.when(s.rlike(r"^(?:\d+|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}|\{[^}]*\}|:\w+|<[^>]*>|\$\{[^}]*\})$"), "{}").otherwise(s))
    out = F.array_join(seg, "/")
    return F.when(out == "", "/").otherwise(out)
