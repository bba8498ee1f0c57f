"""The scalar rules as SQL functions, so that SQL users get them without Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lacuna.functions.names import CONNECTORS

_WORDS = (
    r"trim(regexp_replace(concat(' ', trim(regexp_replace(regexp_replace(n, r'\([^)]*\)', ' '), '[^A-Za-z]+', ' '))), "
    r"r'(?i)(?: (?:" + "|".join(CONNECTORS) + r"))+(?= |$)', ''))"
)

# name, parameters, return type, body
FUNCTIONS = (
    ("latin_words", "n STRING", "STRING", _WORDS),
    ("managed_key", "n STRING", "STRING",
     f"nullif(lower(regexp_extract({_WORDS}, '^[A-Za-z]+ [A-Za-z]+(?: [a-z][A-Za-z]*)?', 0)), '')"),
    ("binomial", "n STRING", "STRING", f"nullif(lower(regexp_extract({_WORDS}, '^[A-Za-z]+ [A-Za-z]+', 0)), '')"),
    ("vernacular_key", "n STRING", "STRING", r"regexp_replace(coalesce(n, ''), r'(?U)[\s\x1c-\x1f]+', '')"),
    ("clean_year", "y STRING", "INT",
     "CASE WHEN try_cast(trim(y) AS INT) BETWEEN 1900 AND 2026 THEN try_cast(trim(y) AS INT) END"),
    ("province_of", "r STRING", "STRING", "substring(r, 1, 2)"),
    ("year_from_date", "d STRING", "STRING",
     r"coalesce(nullif(regexp_extract(trim(d), r'^(\d{4})-\d{2}-\d{2}', 1), ''), regexp_extract(trim(coalesce(d, '')), r'(\d{4})', 1))"),
)


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; returns their names."""
    for name, params, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
