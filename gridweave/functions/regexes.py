"""Regex helpers with NULL-friendly results, built only from native expressions.

Patterns are written in the Python dialect's common subset; named groups and backreferences are
translated to Java's spelling. A pattern that does not compile never fails a job: a match is false, an
extract is NULL and a replace returns its input.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def java_pattern(pattern: str) -> str:
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def java_replacement(repl: str) -> str:
    """``\\1`` and ``\\g<name>`` references become ``$1`` / ``${name}``; a literal dollar is escaped."""
    out = repl.replace("$", r"\$")
    out = re.sub(r"\\g<(\d+)>", r"$\1", out)
    out = re.sub(r"\\g<(\w+)>", r"${\1}", out)
    return re.sub(r"\\(\d)", r"$\1", out)


def _groups(pattern: str) -> int | None:
    try:
        return re.compile(pattern).groups
    except re.error:
        return None


def re_match(value: Column, pattern: str | Column) -> Column:
    """True when the pattern occurs anywhere; NULL on either side counts as no match."""
    if isinstance(pattern, Column):
        return F.coalesce(F.rlike(value, pattern), F.lit(False))
    if _groups(pattern) is None:
        return F.lit(False)
    return F.coalesce(value.rlike(java_pattern(pattern)), F.lit(False))


def re_extract(value: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, NULL when there is none or the group does not exist."""
    n = _groups(pattern)
    if n is None or group > n:
        return F.lit(None).cast("string")
    p = java_pattern(pattern)
    return F.when(value.rlike(p), F.regexp_extract(value, p, group))


def re_extract_all(value: Column, pattern: str, group: int = 0) -> Column:
    """Every match as an array; empty when nothing matches or the value is NULL."""
    n = _groups(pattern)
    if n is None or group > n:
        return F.array().cast("array<string>")
    return F.coalesce(F.regexp_extract_all(value, F.lit(java_pattern(pattern)), F.lit(group)),
                      F.array().cast("array<string>"))


def re_replace(value: Column, pattern: str, repl: str | None) -> Column:
    """Replace every match; a NULL replacement deletes the matches."""
    if _groups(pattern) is None:
        return value
    return F.regexp_replace(value, java_pattern(pattern), java_replacement(repl or ""))


def register_sql(spark: SparkSession) -> None:
    """Expose the helpers to SQL text as inlined SQL functions (no Python in the hot path)."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION re_match(pattern STRING, value STRING) "
              "RETURNS BOOLEAN RETURN coalesce(value RLIKE pattern, false)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION re_extract(value STRING, pattern STRING, grp INT DEFAULT 0) "
              "RETURNS STRING RETURN CASE WHEN value RLIKE pattern THEN regexp_extract(value, pattern, grp) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION re_replace(value STRING, pattern STRING, repl STRING) "
              "RETURNS STRING RETURN CASE WHEN pattern IS NULL THEN value "
              "ELSE regexp_replace(value, pattern, coalesce(repl, '')) END")
