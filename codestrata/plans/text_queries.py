"""Queries of full-text search, name look-up, text rules and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import text as T
from codestrata.operators import vectors as V
from codestrata.plans import relations as R
from codestrata.runtime import table


def _pages(spark, base) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", "title", F.col("text").alias("body"), F.col("source").alias("facts"))


def bm25_pages(spark: SparkSession, base: str) -> DataFrame:
    p = _pages(spark, base)
    postings, lengths = T.build_index(p, "doc_id", ["title", "body", "facts"])
    return T.bm25(postings, lengths, "doc_id", "ledger mapp").withColumn("score", F.round("score", 6))


def index_stats(spark: SparkSession, base: str) -> DataFrame:
    """Pages and uses of every word of the index."""
    postings, _ = T.build_index(_pages(spark, base), "doc_id", ["title", "body", "facts"])
    return postings.groupBy("token").agg(F.count_distinct("doc_id").alias("n_pages"), F.sum("tf").alias("n_uses"))


def pages_like(spark: SparkSession, base: str) -> DataFrame:
    return T.contains_any(_pages(spark, base), ["title", "body"], "rolled back").select("doc_id")


def name_tiers(spark: SparkSession, base: str) -> DataFrame:
    n = R.nodes(spark, base).select("qn").distinct().withColumn("tier", T.name_tier(F.col("qn"), "ledger"))
    return n.where("tier is not null")


def rrf_hybrid(spark: SparkSession, base: str) -> DataFrame:
    """Full text, title and length lists of documents, fused."""
    p = _pages(spark, base)
    postings, lengths = T.build_index(p, "doc_id", ["title", "body", "facts"])
    words = T.ranked(T.bm25(postings, lengths, "doc_id", "ledger").withColumn("score", F.round("score", 6)), F.desc("score"), F.asc("doc_id"))
    titles = T.ranked(p.where(F.contains(F.lower("title"), F.lit("ledger"))), F.length("title"), F.asc("doc_id"))
    return T.fuse({"words": words, "titles": titles}, "doc_id")


def plain_snippets(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").where("text is not null").select("doc_id", F.length(T.plain_snippet(F.col("text"))).alias("n"))


def chunk_hashes(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "discovery_chunk_meta").select("chunk_id", "file_path", "qualified_name", "chunk_index", "chunk_text").distinct()
    return c.select("chunk_id", T.chunk_hash(F.col("file_path"), F.col("qualified_name"), F.col("chunk_index"), F.col("chunk_text")).alias("hash"))


def markdown_sections(spark: SparkSession, base: str) -> DataFrame:
    return T.sections(table(spark, base, "documents"), "doc_id", "text").select("doc_id", "pos", "heading")


def token_estimates(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").groupBy("source").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


def intent_clusters(spark: SparkSession, base: str) -> DataFrame:
    n = R.nodes(spark, base).where("node_type in ('endpoint', 'batch_job', 'function', 'method')")
    return n.groupBy(T.intent(F.col("name")).alias("intent"), F.coalesce("domain", F.lit("(none)")).alias("domain")).agg(F.count("*").alias("n"))


def domain_inference(spark: SparkSession, base: str) -> DataFrame:
    return R.nodes(spark, base).select("id", T.infer_domain(F.col("qn"), F.col("file_path")).alias("inferred"))


def name_stems(spark: SparkSession, base: str) -> DataFrame:
    n = R.nodes(spark, base).where("node_type = 'class'").select("name").distinct()
    return n.select("name", T.snake_stem(F.col("name")).alias("snake"), T.loose_stem(F.col("name")).alias("loose"))


def similar_stems(spark: SparkSession, base: str) -> DataFrame:
    """Class names with the same first three letters and a similar stem."""
    n = R.nodes(spark, base).where("node_type = 'class'").select(T.layer_stem(F.col("name")).alias("stem")).distinct()
    a, b = n.select(F.substr("stem", F.lit(1), F.lit(3)).alias("block"), F.col("stem").alias("a")), n.select(F.substr("stem", F.lit(1), F.lit(3)).alias("block"), F.col("stem").alias("b"))
    # Stems that like have at most a fifth of their letters to insert or delete: told in the JVM, before the exact measure.
    like = a.join(b, "block").where("a < b").where(F.levenshtein("a", "b") <= 0.2 * (F.length("a") + F.length("b")))
    return like.withColumn("similarity", F.round(T.gestalt("a", "b"), 4)).where("similarity >= 0.8").select("a", "b", "similarity")


def injection_flags(spark: SparkSession, base: str) -> DataFrame:
    return T.injection_flags(table(spark, base, "documents"), "doc_id", "text")


def grounding_check(spark: SparkSession, base: str) -> DataFrame:
    return T.ungrounded(T.code_references(table(spark, base, "documents"), "doc_id", "text"), T.known_names(R.nodes(spark, base)))


def routes_normal(spark: SparkSession, base: str) -> DataFrame:
    n = R.nodes(spark, base).where("annotations like '%Route(%'")
    return n.select("id", T.normal_route(F.regexp_extract("annotations", r"Route\(([^)]*)\)", 1)).alias("route"))


def page_ids(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", T.page_id(F.col("source"), F.col("title")).alias("page_id"))


def mask_counts(spark: SparkSession, base: str) -> DataFrame:
    _, n = T.mask_forms(F.col("source_code"))
    c = table(spark, base, "code_nodes").select("id", "source_code").distinct()
    return c.select("id", n.alias("n")).where("n > 0")


def knn_l2(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "embeddings")
    return V.knn(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).select("query", "vec_id", F.round("distance", 4).alias("distance"), F.col("rank").cast("long").alias("rank"))


def dual_search(spark: SparkSession, base: str) -> DataFrame:
    """Neighbours of one vector among even and odd rows, merged."""
    e = table(spark, base, "embeddings")
    q = e.where("vec_id = 0")
    return V.merge_searches({"even": V.knn(e.where("vec_id % 2 = 0"), q, "vec_id", "embedding"), "odd": V.knn(e.where("vec_id % 2 = 1"), q, "vec_id", "embedding")}, "vec_id", 5).withColumn("distance", F.round("distance", 4))


def embed_delta(spark: SparkSession, base: str) -> DataFrame:
    """What the readers' scans need embedded against all finished scans before."""
    c = table(spark, base, "discovery_chunk_meta").select("scan_id", F.nullif(F.lower(F.trim("chunk_hash")), F.lit("")).alias("h"))
    now = c.join(R.current(spark, base), "scan_id", "left_semi")
    return V.vector_delta(c.join(R.current(spark, base), "scan_id", "left_anti"), now, "h").groupBy("action").agg(F.count("*").alias("n"))


_TOK = rf"regexp_extract_all(translate(regexp_replace({{0}}, '[\x{{{{300}}}}-\x{{{{36F}}}}]', '', 'g'), '{T.MARKED_FROM}', '{T.MARKED_TO}'), '[\p{{{{L}}}}\p{{{{N}}}}]+')"
_BM = f"""WITH p AS (SELECT doc_id, title, text AS body, source AS facts FROM documents),
w AS (SELECT doc_id, c, lower(unnest(k)) AS t FROM (SELECT doc_id, 10.0 AS c, {_TOK.format('title')} AS k FROM p UNION ALL SELECT doc_id, 1.0, {_TOK.format('body')} FROM p UNION ALL SELECT doc_id, 2.0, {_TOK.format('facts')} FROM p)),
l AS (SELECT p.doc_id, coalesce(len({_TOK.format('title')}), 0) + coalesce(len({_TOK.format('body')}), 0) + coalesce(len({_TOK.format('facts')}), 0) AS length FROM p),
s AS (SELECT count(*) AS n_pages, avg(length) AS avg_length FROM l)"""


def _bm(prefixes: list[str]) -> str:
    x = " UNION ALL ".join(f"SELECT doc_id, '{p}' AS x, sum(c) AS f FROM w WHERE starts_with(t, '{p}') GROUP BY 1" for p in prefixes)
    return _BM + f""", f AS ({x}), d AS (SELECT x, count(*) AS df FROM f GROUP BY 1),
bm AS (SELECT doc_id, round(sum(greatest(ln((n_pages - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score FROM f JOIN d USING (x) JOIN l USING (doc_id), s GROUP BY 1 HAVING count(*) = {len(prefixes)})"""


_N = f"WITH {R.NODES}"
_NOT = "'" + "', '".join(T.NO_DOMAIN) + "'"
QUERIES = {f.__name__: f for f in (bm25_pages, index_stats, pages_like, name_tiers, rrf_hybrid, plain_snippets, chunk_hashes, markdown_sections, token_estimates, intent_clusters, domain_inference, name_stems, similar_stems, injection_flags, grounding_check, routes_normal, page_ids, mask_counts, knn_l2, dual_search, embed_delta)}
ORACLE = {
    "bm25_pages": _bm(["ledger", "mapp"]) + " SELECT doc_id, score FROM bm",
    "index_stats": _BM + " SELECT t AS token, count(DISTINCT doc_id) AS n_pages, count(*) AS n_uses FROM w GROUP BY 1",
    "pages_like": "SELECT doc_id FROM documents WHERE title ILIKE '%rolled back%' OR text ILIKE '%rolled back%'",
    "name_tiers": _N + " SELECT DISTINCT qn, CASE WHEN lower(qn) = 'ledger' THEN 0 WHEN ends_with(lower(qn), '.ledger') THEN 1 ELSE 2 END AS tier FROM n WHERE instr(lower(qn), 'ledger') > 0",
    "rrf_hybrid": _bm(["ledger"]) + """, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, 'words' AS s FROM bm QUALIFY k <= 50),
b AS (SELECT doc_id, row_number() OVER (ORDER BY length(title), doc_id) AS k, 'titles' AS s FROM p WHERE contains(lower(title), 'ledger') QUALIFY k <= 50)
SELECT doc_id, round(sum(1.0 / (60 + k)), 5) AS score, string_agg(s, ',' ORDER BY s) AS sources FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""",
    "chunk_hashes": "SELECT DISTINCT chunk_id, sha256(coalesce(file_path, '') || chr(0) || coalesce(qualified_name, '') || chr(0) || coalesce(CAST(chunk_index AS VARCHAR), '') || chr(0) || coalesce(chunk_text, '')) AS hash FROM discovery_chunk_meta",
    "token_estimates": "SELECT source, CAST(sum(floor(coalesce(length(text), 0) / 4)) AS BIGINT) AS tokens FROM documents GROUP BY 1",
    "intent_clusters": _N + ", x AS (SELECT lower(replace(name, '_', '')) AS l, coalesce(domain, '(none)') AS domain FROM n WHERE node_type IN ('endpoint', 'batch_job', 'function', 'method')) SELECT CASE " + " ".join(f"WHEN regexp_matches(l, '{p}') THEN '{w}'" for w, p in T.INTENTS) + " ELSE 'other' END AS intent, domain, count(*) AS n FROM x GROUP BY 1, 2",
    "name_stems": _N + r""", x AS (SELECT DISTINCT name, lower(regexp_replace(name, '([A-Z])', '_\1', 'g')) AS s0, lower(regexp_replace(name, '(?:""" + "|".join(T.LAYER_ENDS) + r""")$', '')) AS l0 FROM n WHERE node_type = 'class'), y AS (SELECT name, CASE WHEN regexp_matches(name, '^[A-Z]') THEN substr(s0, 2) ELSE s0 END AS s, l0 FROM x)
SELECT name, CASE WHEN ends_with(s, 'ies') THEN substr(s, 1, length(s) - 3) || 'y' WHEN ends_with(s, 'ses') THEN substr(s, 1, length(s) - 2) WHEN ends_with(s, 's') AND NOT ends_with(s, 'ss') THEN substr(s, 1, length(s) - 1) ELSE s END AS snake, CASE WHEN ends_with(l0, 's') THEN substr(l0, 1, length(l0) - 1) ELSE l0 END AS loose FROM y""",
    "domain_inference": _N + f", x AS (SELECT id, string_split(qn, '.') AS q, string_split(file_path, '/') AS f FROM n) SELECT id, lower(coalesce(list_filter(q[1:len(q) - 1], lambda p: p <> '' AND lower(p) NOT IN ({_NOT}))[1], list_filter(f[1:len(f) - 1], lambda p: p <> '' AND lower(p) NOT IN ({_NOT}))[1])) AS inferred FROM x",
    "grounding_check": _N + r""", r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '`([A-Za-z_][\w.]*)`', 1)) AS ref FROM documents),
k AS (SELECT name FROM n UNION SELECT qn FROM n UNION SELECT unnest(string_split(qn, '.')) FROM n) SELECT doc_id, ref FROM r WHERE ref NOT IN (SELECT name FROM k WHERE name IS NOT NULL)""",
    "routes_normal": _N + r", x AS (SELECT id, lower(rtrim(regexp_replace(split_part(regexp_extract(annotations, 'Route\(([^)]*)\)', 1), '?', 1), '\{[^}/]*\}|:[A-Za-z_]\w*|\$\{[^}]*\}|<[^>/]*>', '*', 'g'), '/')) AS r FROM n WHERE annotations LIKE '%Route(%') SELECT id, CASE WHEN r = '' THEN '/' ELSE r END AS route FROM x",
    "plain_snippets": r"SELECT doc_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '[#*_`>|]+', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS n FROM documents WHERE text IS NOT NULL",
    "page_ids": r"SELECT doc_id, concat_ws(':', source, regexp_replace(title, '\s+', '-', 'g')) AS page_id FROM documents",
    "knn_l2": "WITH x AS (SELECT q.vec_id AS query, e.vec_id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) SELECT query, vec_id, round(d, 4) AS distance, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS rank FROM x QUALIFY rank <= 5",
    "dual_search": "WITH x AS (SELECT CASE WHEN e.vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, e.vec_id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d FROM embeddings q, embeddings e WHERE q.vec_id = 0) SELECT source, vec_id, round(d, 4) AS distance FROM x ORDER BY d, source, vec_id LIMIT 5",
    "embed_delta": """WITH c AS (SELECT scan_id IN (SELECT scan_id FROM current_scan) AS now, nullif(lower(trim(chunk_hash)), '') AS h FROM discovery_chunk_meta),
s AS (SELECT DISTINCT h FROM c WHERE NOT now AND h IS NOT NULL), w AS (SELECT DISTINCT h FROM c WHERE now AND h IS NOT NULL)
SELECT CASE WHEN s.h IS NULL THEN 'embed' WHEN w.h IS NULL THEN 'drop' ELSE 'keep' END AS action, count(*) AS n FROM s FULL JOIN w USING (h) GROUP BY 1""",
}
