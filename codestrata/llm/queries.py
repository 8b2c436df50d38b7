"""Queries of the operators for training texts, and their SQL where there is one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import bpe, garbled, handwritten, leaks, secrets, spans, split
from codestrata.runtime import table

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return secrets.scan_records(table(spark, base, "code_nodes"), table(spark, base, "discovery_chunk_meta")).select("rec_kind", "rec_id")


def p2_redacted(spark: SparkSession, base: str) -> DataFrame:
    return secrets.scan_records(table(spark, base, "code_nodes"), table(spark, base, "discovery_chunk_meta"), True)


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    cut = split.split_records(table(spark, base, "code_nodes"), table(spark, base, "discovery_chunk_meta"))
    return cut.where(F.size("pieces") > 1).select("rec_kind", "rec_id")


def p3_pieces(spark: SparkSession, base: str) -> DataFrame:
    cut = split.split_records(table(spark, base, "code_nodes"), table(spark, base, "discovery_chunk_meta"))
    return cut.select("rec_kind", "rec_id", F.inline("pieces"))


def _current(spark: SparkSession, base: str) -> DataFrame:
    return spans.current_nodes(table(spark, base, "code_nodes"), table(spark, base, "current_scan"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return spans.sharing_pairs(_current(spark, base), "id", "source_code").select(F.col("a").alias("node_id_a"), F.col("b").alias("node_id_b"))


def p5_shared(spark: SparkSession, base: str) -> DataFrame:
    return spans.shared_amount(_current(spark, base), "id", "source_code")


def p5_cleaned(spark: SparkSession, base: str) -> DataFrame:
    """What is left of the texts that repeat others."""
    return spans.without_repeats(_current(spark, base), "id", "source_code")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, base, "code_nodes")).select("scan_id", "file_path")


def p6_kinds(spark: SparkSession, base: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, base, "code_nodes")).select("scan_id", "file_path", F.concat_ws(",", "kinds").alias("kinds"))


def p6_report(spark: SparkSession, base: str) -> DataFrame:
    return handwritten.report(table(spark, base, "code_nodes"), table(spark, base, "scan_runs"))


def p7_ids(spark: SparkSession, base: str) -> DataFrame:
    return bpe.encode_table(table(spark, base, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return leaks.exact_leaks(table(spark, base, "documents"), table(spark, base, "benchmark"))


def p8_leaks(spark: SparkSession, base: str) -> DataFrame:
    return leaks.leaks(table(spark, base, "documents"), table(spark, base, "benchmark"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return garbled.garbled(table(spark, base, "documents"), "doc_id", "text").select("doc_id")


def p9_restored(spark: SparkSession, base: str) -> DataFrame:
    return garbled.restore(table(spark, base, "documents"), "doc_id", "text")


_P8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) > 12)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) > 12))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)"""
_P5 = """
WITH n AS (SELECT DISTINCT id, source_code AS t FROM code_nodes WHERE scan_id IN (SELECT scan_id FROM current_scan) AND length(source_code) >= 200),
c AS (SELECT min(id) AS lead, t, count(*) AS copies, length(t) AS n_chars FROM n GROUP BY t), m AS (SELECT n.id, c.lead FROM n JOIN c USING (t)),
w AS MATERIALIZED (SELECT lead, i, md5(substring(t, i, 200)) AS s FROM (SELECT lead, t, unnest(range(1, n_chars - 198)) AS i FROM c)),
k AS MATERIALIZED (SELECT s, min(lead) AS first FROM w GROUP BY s HAVING min(lead) < max(lead))
"""
QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p3_pieces": p3_pieces, "p5_found": p5_found, "p5_shared": p5_shared, "p5_cleaned": p5_cleaned, "p6_found": p6_found, "p6_kinds": p6_kinds, "p6_report": p6_report, "p7_ids": p7_ids, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_restored": p9_restored}
ORACLE = {
    "p3_found": """
SELECT DISTINCT 'node' AS rec_kind, id AS rec_id FROM code_nodes WHERE length(source_code) > 6000
UNION ALL SELECT DISTINCT 'chunk', chunk_id FROM discovery_chunk_meta WHERE length(chunk_text) > 1500""",
    "p5_found": _P5 + """, x AS (SELECT DISTINCT lead, s FROM w JOIN k USING (s)), y AS (SELECT DISTINCT a.lead AS a, b.lead AS b FROM x a JOIN x b USING (s) WHERE a.lead < b.lead)
SELECT least(p.id, q.id) AS node_id_a, greatest(p.id, q.id) AS node_id_b FROM y JOIN m p ON p.lead = a JOIN m q ON q.lead = b UNION ALL SELECT p.id, q.id FROM m p JOIN m q USING (lead) WHERE p.id < q.id""",
    "p5_shared": _P5 + """, x AS (SELECT lead, i, k.first < lead AS later FROM w JOIN k USING (s)),
g AS (SELECT lead, sum(least(200, coalesce(nxt - i, 200))) AS n_shared FROM (SELECT *, lead(i) OVER (PARTITION BY x.lead ORDER BY i) AS nxt FROM x) GROUP BY lead),
h AS (SELECT lead, sum(least(200, coalesce(nxt - i, 200))) AS n_later FROM (SELECT *, lead(i) OVER (PARTITION BY x.lead ORDER BY i) AS nxt FROM x WHERE later) GROUP BY lead),
z AS (SELECT DISTINCT lead, s FROM w JOIN k USING (s)), p AS (SELECT a.lead, count(DISTINCT b.lead) AS n_partners FROM z a JOIN z b USING (s) WHERE a.lead <> b.lead GROUP BY 1)
SELECT m.id, c.n_chars, CAST(CASE WHEN copies > 1 THEN c.n_chars ELSE n_shared END AS BIGINT) AS n_shared, CAST(CASE WHEN m.id <> m.lead THEN c.n_chars ELSE coalesce(n_later, 0) END AS BIGINT) AS n_later, coalesce(n_partners, 0) AS n_partners
FROM m JOIN c USING (lead) LEFT JOIN g USING (lead) LEFT JOIN h USING (lead) LEFT JOIN p USING (lead) WHERE copies > 1 OR n_shared IS NOT NULL""",
    "p8_found": _P8,
}
