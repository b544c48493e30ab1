"""Regex, text and cell helper functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions import regexes, text

from . import derived, query, table


@query("n01_regexp", r"""SELECT doc_id, regexp_matches(text, '[A-Z][a-z]+ (the|la|der) ') AS hit FROM documents""")
def n01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", regexes.re_match(F.col("text"), r"[A-Z][a-z]+ (the|la|der) ").alias("hit"))


@query("n02_regexp_extract", r"""
    SELECT page_id, nullif(regexp_extract(url, 'https?://([^/]+)/([a-z]+)/(\d+)', 3), '') AS number,
           CASE WHEN regexp_matches(url, 'utm_source=(\w*)') THEN regexp_extract(url, 'utm_source=(\w*)', 1) END AS utm, CAST(NULL AS VARCHAR) AS none FROM pages""")
def n02(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", regexes.re_extract(u, r"https?://(?P<host>[^/]+)/([a-z]+)/(\d+)", 3).alias("number"),
        regexes.re_extract(u, r"utm_source=(\w*)", 1).alias("utm"), regexes.re_extract(u, "(", 1).alias("none"))


@query("n03_regexp_replace", r"""
    SELECT doc_id, sha256(regexp_replace(text, '(\w+) (\w+)', '\2 \1', 'g')) AS swapped, sha256(regexp_replace(text, '\s+', '', 'g')) AS packed FROM documents""")
def n03(spark, sf):
    t = F.col("text")
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(regexes.re_replace(t, r"(\w+) (\w+)", r"\2 \1"), 256).alias("swapped"),
                    F.sha2(regexes.re_replace(t, r"\s+", None), 256).alias("packed"))


@query("n04_clip", """
    SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '… (+' || (length(text) - 80) || ' chars)' ELSE text END AS shown FROM documents""")
def n04(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clip(F.col("text"), 80).alias("shown"))


@query("n05_clip_line", r"""
    SELECT doc_id, CASE WHEN length(s) > 140 THEN left(s, 140) || '…' ELSE s END AS shown FROM
      (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)""")
def n05(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clip_line(F.col("text"), 140).alias("shown"))


@query("n06_clean_invisible", r"""SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cleaned FROM documents""")
def n06(spark, sf):
    dirty = F.concat(F.lit("﻿ "), F.replace(F.col("text"), F.lit("\n"), F.lit(" ​\n⁠")))
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.clean_invisible(dirty), 256).alias("cleaned"))


@query("n07_slug", """
    SELECT rid, CASE WHEN s = '' THEN 'dataset' ELSE s END AS slug FROM (SELECT rid, trim(regexp_replace(lower(coalesce(segment, '')) || CASE WHEN segment IS NULL THEN '' ELSE ' & ' || lower(name) END,
      '[^a-z0-9]+', '-', 'g'), '-') AS s FROM contacts)""", uses=("contacts",))
def n07(spark, sf):
    c = derived(spark, sf, "contacts")
    return c.select("rid", text.slug(F.concat("segment", F.lit(" & "), "name"), "dataset").alias("slug"))


@query("n08_split_list", """
    SELECT doc_id, len(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '')) AS n,
           array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, E' \\n\\t\\r')), lambda x: x <> ''), '|') AS parts FROM documents""".replace("lambda x: trim(x)), lambda", "lambda x: trim(x, E' \\n\\t\\r')), lambda"))
def n08(spark, sf):
    parts = text.split_list(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(parts).cast("bigint").alias("n"), F.array_join(parts, "|").alias("parts"))


@query("n09_time_and_size_text", """
    WITH s AS (SELECT o_orderkey, o_orderkey * 37 AS secs, o_orderkey * o_custkey * 977 AS bytes FROM orders)
    SELECT o_orderkey, CASE WHEN secs < 60 THEN secs || 's' ELSE (secs // 60) || 'm ' || (secs % 60) || 's' END AS took,
      CASE WHEN secs < 60 THEN secs || 's ago' WHEN secs < 3600 THEN (secs // 60) || 'm ago' WHEN secs < 86400 THEN (secs // 3600) || 'h ago' ELSE (secs // 86400) || 'd ago' END AS ago,
      CASE WHEN secs <= 0 THEN 'now' WHEN secs < 60 THEN 'in ' || secs || 's' WHEN secs < 3600 THEN 'in ' || (secs // 60) || 'm' WHEN secs < 86400 THEN 'in ' || (secs // 3600) || 'h' ELSE 'in ' || (secs // 86400) || 'd' END AS until,
      CASE WHEN bytes = 0 THEN 'empty' WHEN bytes < 1024 THEN bytes || ' B'
           WHEN bytes < 10.0 * 1024 THEN printf('%.1f KB', bytes / 1024.0) WHEN bytes < 1048576 THEN CAST(floor(bytes / 1024.0 + 0.5) AS BIGINT) || ' KB'
           WHEN bytes < 10.0 * 1048576 THEN printf('%.1f MB', bytes / 1048576.0) WHEN bytes < 1073741824 THEN CAST(floor(bytes / 1048576.0 + 0.5) AS BIGINT) || ' MB'
           WHEN bytes < 10.0 * 1073741824 THEN printf('%.1f GB', bytes / 1073741824.0) ELSE CAST(floor(bytes / 1073741824.0 + 0.5) AS BIGINT) || ' GB' END AS size FROM s""")
def n09(spark, sf):
    now, secs = F.lit(1.7e9), (F.col("o_orderkey") * 37).cast("double")
    return table(spark, sf, "orders").select(
        "o_orderkey", text.duration_text(now - secs, now).alias("took"), text.relative_time(now - secs, now).alias("ago"),
        text.until_time(now + secs, now).alias("until"), text.format_bytes(F.col("o_orderkey") * F.col("o_custkey") * 977).alias("size"))


@query("n10_fold_accents", "SELECT doc_id, sha256(strip_accents(text)) AS folded FROM documents")
def n10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.fold_accents(F.col("text")), 256).alias("folded"))


@query("n11_mime_family", """
    SELECT id, CASE WHEN mime LIKE 'image/%' THEN 'image' WHEN mime LIKE 'video/%' THEN 'film' WHEN mime LIKE 'text/%' OR mime = 'application/json' THEN 'code' ELSE 'file' END AS family,
           mime LIKE 'text/%' OR mime = 'application/json' AS textual FROM file_meta""", uses=("file_meta",))
def n11(spark, sf):
    m = F.col("mime")
    return derived(spark, sf, "file_meta").select("id", text.mime_family(m).alias("family"), text.is_textual(m).alias("textual"))


@query("n12_looks_like_id", """
    SELECT file_id, regexp_full_match(file_id, '[0-9a-f]{8}') AS is_id, count(*) AS n FROM (SELECT file_id FROM attachment_items UNION ALL SELECT name FROM file_meta) GROUP BY 1""", uses=("attachment_items", "file_meta"))
def n12(spark, sf):
    both = derived(spark, sf, "attachment_items").select("file_id").union(derived(spark, sf, "file_meta").select("name"))
    return both.groupBy("file_id", text.looks_like_id(F.col("file_id")).alias("is_id")).agg(F.count("*").alias("n"))
