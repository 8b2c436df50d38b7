"""Scalar functions of the engine for use in SQL: temporary functions that the
optimizer inlines, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Name with parameters, type of the result, expression.
FUNCTIONS = [
    ("last_part(s STRING)", "STRING", "substring_index(s, '.', -1)"),
    ("owner_of(s STRING)", "STRING", r"regexp_extract(s, '^(.*)[.][^.]+$', 1)"),
    ("folder_of(s STRING)", "STRING", "regexp_extract(s, '^(.*)/[^/]*$', 1)"),
    ("extension_of(s STRING)", "STRING", "lower(regexp_extract(s, '[.]([^./]+)$', 1))"),
    ("snake(s STRING)", "STRING", "lower(regexp_replace(s, '(?<!^)(?=[A-Z])', '_'))"),
    ("slug(s STRING)", "STRING", r"trim(BOTH '-' FROM lower(regexp_replace(s, '[^\\p{L}\\p{N}]+', '-')))"),
    ("normal_hash(s STRING)", "STRING", "nullif(lower(trim(s)), '')"),
    ("route_of(s STRING)", "STRING", "coalesce(nullif(lower(regexp_replace(regexp_replace(substring_index(s, '?', 1), '[{][^}/]*[}]|:[A-Za-z_][A-Za-z0-9_]*|<[^>/]*>', '*'), '/+$', '')), ''), '/')"),
    ("tokens_in(s STRING)", "BIGINT", "floor(coalesce(char_length(s), 0) / 4)"),
    ("overlap(a ARRAY<STRING>, b ARRAY<STRING>)", "DOUBLE", "coalesce(try_divide(size(array_intersect(a, b)), size(array_union(a, b))), 0.0)"),
    ("clamp(x DOUBLE, lo DOUBLE, hi DOUBLE)", "DOUBLE", "least(greatest(x, lo), hi)"),
    ("wilson_low(k BIGINT, n BIGINT)", "DOUBLE", "CASE WHEN n > 0 THEN greatest(0.0, (k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)) ELSE 0.0 END"),
    ("wilson_high(k BIGINT, n BIGINT)", "DOUBLE", "CASE WHEN n > 0 THEN least(1.0, (k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)) ELSE 1.0 END"),
]


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to a session; their names."""
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head, _, _ in FUNCTIONS]
