"""Campaign planning and accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import campaign as camp
from gridweave.operators import catalogue as cat

from . import derived, query, table
from .files import attachments, catalogue


@query("c01_canonical_profile_url", r"""
    SELECT seq, CASE seq % 6 WHEN 0 THEN 'https://www.linkedin.com/in/customer-' || lpad(CAST(seq AS VARCHAR), 9, '0') || '/' WHEN 1 THEN 'https://www.linkedin.com/in/user' || seq || '/'
      WHEN 2 THEN 'https://www.linkedin.com/in/handle' || seq || '/' WHEN 5 THEN 'https://www.linkedin.com/in/late' || seq || '/' ELSE '' END AS canonical_url FROM recipients""", uses=("recipients",))
def c01(spark, sf):
    return camp.canonical_profile_url(derived(spark, sf, "recipients").drop("community")).select("seq", "canonical_url")


@query("c02_canonical_community", """
    SELECT seq, CASE seq % 7 WHEN 0 THEN 'Area' || seq WHEN 1 THEN 'name' || seq WHEN 2 THEN 'bare_' || seq ELSE '' END AS canonical_community FROM recipients""", uses=("recipients",))
def c02(spark, sf):
    return camp.canonical_community(derived(spark, sf, "recipients").select("seq", "community")).select("seq", "canonical_community")


@query("c03_parse_variants", r"""
    SELECT doc_id, len(v) AS n, sha256(array_to_string(v, '|')) AS variants FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\.', '||', 'g'), '||'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))),
      lambda x: x <> '') AS v FROM documents)""")
def c03(spark, sf):
    v = camp.parse_variants(F.regexp_replace("text", r"\.", "||"), collapse=True)
    return table(spark, sf, "documents").select("doc_id", F.size(v).cast("bigint").alias("n"), F.sha2(F.array_join(v, "|"), 256).alias("variants"))


@query("c03_parse_variants_json", "SELECT conv_id, turn, sha256(trim(text, E' \\n\\t') || '|second') AS variants FROM conversations")
def c03b(spark, sf):
    v = camp.parse_variants(F.to_json(F.array(F.concat(F.lit(" "), "text"), F.lit("second "), F.lit("  "))))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.array_join(v, "|"), 256).alias("variants"))


PLAN = """
    WITH a AS (SELECT *, valid AND media_ok AS tried, coalesce(row_message, '') AS own FROM attempts),
    b AS (SELECT *, coalesce(sum(CASE WHEN tried AND outcome = 'sent' THEN 1 ELSE 0 END) OVER w, 0) AS sent_before, coalesce(sum(CASE WHEN tried AND outcome = 'sent' AND own = '' THEN 1 ELSE 0 END) OVER w, 0) AS fb_before,
      coalesce(sum(CASE WHEN tried AND outcome = 'rate_limited' THEN 1 ELSE 0 END) OVER w, 0) AS stops_before FROM a WINDOW w AS (PARTITION BY campaign ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, CASE WHEN NOT valid THEN 'invalid_input' WHEN {stop} THEN 'skipped' WHEN NOT media_ok THEN 'media_invalid' ELSE outcome END AS status FROM b),
    plan AS (SELECT campaign, seq, status, CASE WHEN status NOT IN ('invalid_input', 'skipped') THEN CASE WHEN own <> '' THEN own WHEN fb_before % 3 = 0 THEN 'Hi' WHEN fb_before % 3 = 1 THEN 'Hey' ELSE 'Dear' END END AS message, own <> '' AS personal FROM c)
"""
VARIANTS = ["Hi", "Hey", "Dear"]


@query("c04_resolve_message", PLAN.replace("{stop}", "false") + "SELECT campaign, seq, status, message FROM plan", uses=("attempts",))
def c04(spark, sf):
    return camp.resolve_message(derived(spark, sf, "attempts"), VARIANTS).select("campaign", "seq", "status", "message")


@query("c07_apply_cap", PLAN.replace("{stop}", "stops_before > 0 OR sent_before >= 12") + "SELECT campaign, seq, status, message FROM plan", uses=("attempts",))
def c07(spark, sf):
    return camp.apply_cap(derived(spark, sf, "attempts"), VARIANTS, cap=12, stop_on=["rate_limited"]).select("campaign", "seq", "status", "message")


@query("c07_one_big_campaign", PLAN.replace("{stop}", "sent_before >= 3000").replace("FROM attempts", "FROM (SELECT * REPLACE (1 AS campaign) FROM attempts)") + "SELECT seq, status, message FROM plan", uses=("attempts",))
def c07b(spark, sf):
    """Every attempt in a single campaign."""
    one = derived(spark, sf, "attempts").withColumn("campaign", F.lit(1))
    return camp.apply_cap(one, VARIANTS, cap=3000, stop_on=[]).select("seq", "status", "message")


@query("c05_title_body", r"""
    WITH m AS (SELECT conv_id, turn, trim(CASE WHEN turn = 2 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END, E' \n\t') AS msg FROM conversations),
    s AS (SELECT *, instr(msg, chr(10) || chr(10)) AS brk, trim(regexp_replace(CASE WHEN instr(msg, chr(10) || chr(10)) > 0 THEN left(msg, instr(msg, chr(10) || chr(10)) - 1)
      ELSE regexp_extract(msg, '^((?:[^.!?…]|[.!?…]+[^\s.!?…])*[.!?…]*)', 1) END, '\s+', ' ', 'g')) AS first FROM m)
    SELECT conv_id, turn, CASE WHEN msg = '' THEN 'Hello' WHEN brk = 0 AND instr(msg, chr(10)) = 0 AND length(msg) <= 280 THEN msg WHEN length(first) > 299 THEN rtrim(left(first, 298)) || '…' WHEN first = '' THEN 'Hello' ELSE first END AS title,
      CASE WHEN brk > 0 THEN sha256(trim(substr(msg, brk + 2), E' \n\t')) WHEN instr(msg, chr(10)) = 0 AND length(msg) <= 280 THEN sha256('') ELSE sha256(msg) END AS body FROM s""")
def c05(spark, sf):
    msg = F.when(F.col("turn") == 2, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text"))
    tb = camp.title_body(msg)
    return table(spark, sf, "conversations").select("conv_id", "turn", tb["title"].alias("title"), F.sha2(tb["body"], 256).alias("body"))


MEDIA = """
    WITH c AS (SELECT rid, count(id) AS total, count(*) FILTER (WHERE mime = 'image/png') AS images, count(*) FILTER (WHERE mime = 'video/mp4') AS videos,
      count(*) FILTER (WHERE mime = 'application/json') AS jsons FROM attachment_items LEFT JOIN file_meta ON id = file_id GROUP BY rid)
"""


@query("c06_validate_media_gallery", MEDIA + """
    SELECT rid, CASE WHEN total > 0 AND images + videos = total AND images = 0 AND videos = 1 THEN 'video' WHEN total > 0 AND images = total THEN 'images' ELSE '' END AS kind,
      CASE WHEN total = 0 THEN '' WHEN images + videos < total THEN 'unsupported type' WHEN images > 0 AND videos > 0 THEN 'images and video mixed' WHEN videos > 1 THEN 'too many videos' ELSE '' END AS detail FROM c""", uses=("attachment_items", "file_meta"))
def c06(spark, sf):
    out = cat.expand_files(attachments(spark, sf), catalogue(spark, sf), "files")
    v = camp.validate_media(F.col("files"), "gallery")
    return out.select(F.col("_rid").alias("rid"), v["kind"].alias("kind"), v["detail"].alias("detail"))


@query("c06_validate_media_message", MEDIA + """
    SELECT rid, CASE WHEN total > 0 AND jsons = 0 THEN 'files' ELSE '' END AS kind, CASE WHEN jsons > 0 THEN 'unsupported type' ELSE '' END AS detail FROM c""", uses=("attachment_items", "file_meta"))
def c06b(spark, sf):
    out = cat.expand_files(attachments(spark, sf), catalogue(spark, sf), "files")
    v = camp.validate_media(F.col("files"), "message")
    return out.select(F.col("_rid").alias("rid"), v["kind"].alias("kind"), v["detail"].alias("detail"))


@query("c08_campaign_summary", PLAN.replace("{stop}", "stops_before > 0 OR sent_before >= 12") + """
    SELECT campaign, status, count(*) AS rows, count(*) FILTER (WHERE message IS NOT NULL AND personal) AS personal, count(*) FILTER (WHERE message IS NOT NULL AND NOT personal) AS fallback FROM plan GROUP BY 1, 2""", uses=("attempts",))
def c08(spark, sf):
    return camp.campaign_summary(camp.apply_cap(derived(spark, sf, "attempts"), VARIANTS, cap=12, stop_on=["rate_limited"]))


@query("c09_no_message_short_circuit", """
    SELECT campaign, seq, CASE WHEN NOT any_own THEN 'error' END AS status, CASE WHEN any_own THEN '' ELSE 'no message configured' END AS detail FROM
      (SELECT campaign, seq, bool_or(campaign % 2 = 0 AND row_message IS NOT NULL OR campaign % 5 = 0) OVER (PARTITION BY campaign) AS any_own FROM attempts)""", uses=("attempts",))
def c09(spark, sf):
    a = derived(spark, sf, "attempts").withColumn("row_message", F.when(F.col("campaign") % 2 == 0, F.col("row_message")))
    return camp.no_message_short_circuit(a, F.col("campaign") % 5 == 0).select("campaign", "seq", "status", "detail")
