"""Workflows with contracts, chained into one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import model
from gridweave.operators import pages, rows, writes
from gridweave.plans import workflows as wf

from . import query, table


def registry(sf):
    reg = wf.Registry()

    @reg.workflow("page-search", params=[{"name": "term", "required": True}], output=["Address", {"name": "Hits", "type": "number"}], builtin=True)
    def page_search(spark, params, _):
        p = table(spark, sf, "pages").withColumn("_rid", F.col("page_id"))
        return rows.search(p, params["term"], ["html"]).select("_rid", F.col("url").alias("Address"), F.size(F.split("html", "<p>")).alias("Hits"))

    @reg.workflow("page-titles", input=["url"], output=["url", "title", "ok"], builtin=True)
    def page_titles(spark, _, inputs):
        return pages.page_titles(inputs, table(spark, sf, "pages"))

    return reg


@query("u01_workflow", "SELECT url AS address, CAST(len(string_split(html, '<p>')) AS DOUBLE) AS hits FROM pages WHERE contains(lower(html), 'nicht')")
def u01(spark, sf):
    return registry(sf).run(spark, "page-search", {"term": "Nicht"}).select("address", "hits")


TITLE = r"""trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query("u02_chain", f"SELECT url, {TITLE} AS title, 'yes' AS ok FROM pages WHERE contains(lower(html), 'nicht')")
def u02(spark, sf):
    return registry(sf).chain(spark, [("page-search", {"term": "nicht"}), ("project", [{"from": "Address", "to": "url"}]), ("page-titles", {})])


@query("u03_check_params", """
    WITH a AS (SELECT o_orderkey AS run_id, o_orderkey % 3 AS m FROM orders)
    SELECT run_id, 'query' AS name, CASE WHEN m = 0 THEN 'missing' ELSE 'ok' END AS state FROM a UNION ALL SELECT run_id, 'limit', CASE m WHEN 0 THEN 'ok' WHEN 1 THEN 'unreadable' ELSE 'blank' END FROM a
    UNION ALL SELECT run_id, 'files', CASE m WHEN 1 THEN 'ok' ELSE 'blank' END FROM a UNION ALL SELECT run_id, 'stray', 'unknown' FROM a WHERE m = 2""")
def u03(spark, sf):
    m = F.col("o_orderkey") % 3
    args = F.when(m == 0, '{"query": "", "limit": "5"}').when(m == 1, '{"query": "x", "limit": "many", "files": "[\\"a\\"]"}').otherwise('{"query": "y", "stray": "1"}')
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit("search").alias("workflow"), args.alias("args"))
    defs = spark.createDataFrame([("search", "query", "string", True), ("search", "limit", "number", False), ("search", "files", "file_list", False)], "workflow string, name string, type string, required boolean")
    return wf.check_params(runs, defs).select("run_id", "name", "state")


@query("u05_map_rows", """
    SELECT p_partkey, CASE WHEN p_size % 10 = 0 OR p_size % 10 = 5 THEN NULL ELSE reverse(p_name) END AS mirrored, CASE WHEN p_size % 10 = 0 OR p_size % 10 = 5 THEN NULL ELSE CAST(p_size * 2 AS DOUBLE) END AS doubled,
      CASE WHEN p_size % 10 = 0 THEN 'error' WHEN p_size % 10 = 5 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN p_size % 10 = 0 THEN 'round size' ELSE '' END AS detail FROM part""")
def u05(spark, sf):
    def mirror(row):
        if row["p_size"] % 10 == 0:
            raise ValueError("round size")
        return None if row["p_size"] % 10 == 5 else {"Mirrored": row["p_name"][::-1], "Doubled": row["p_size"] * 2}
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    return wf.map_rows(p, mirror, ["Mirrored", {"name": "Doubled", "type": "number"}], keep=["p_partkey"])


@query("u06_status_tolerant", """
    SELECT id, CASE WHEN regexp_full_match(cell, '[0-9]+(,[0-9.]+)?') OR cell LIKE '%\\_000' ESCAPE '\\' OR cell LIKE '%e2' AND cell NOT LIKE '% %' OR cell LIKE '  %' THEN 'ok' WHEN coalesce(cell, '') IN ('', 'nan') THEN 'blank' ELSE 'unreadable' END AS status
    FROM messy_cells""", uses=("messy_cells",))
def u06(spark, sf):
    from gridweave.functions import cells

    from . import derived
    d = derived(spark, sf, "messy_cells")
    value, kept = cells.coerce_number(F.col("cell")), cells.rescue_number(F.col("cell"))
    return d.select("id", F.when(value.isNotNull(), "ok").when(kept.isNotNull(), "unreadable").otherwise("blank").alias("status"))


@query("u02_edit_then_append", """
    WITH e AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' ELSE p_type END AS kind FROM part WHERE p_brand <> 'Brand#3'), k AS (SELECT kind, min(p_partkey) AS first FROM e GROUP BY 1)
    SELECT kind, first FROM k""")
def u02b(spark, sf):
    """A longer lazy chain: delete, update, project and dedup of one dataset."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("_rid"), F.col("p_type").alias("Kind"), "p_brand", "p_size")
    kept = writes.delete_where(p, F.col("p_brand") == "Brand#3")
    changed = writes.update_where(kept, {"Kind": F.lit("big")}, F.col("p_size") > 40)
    one = writes.dedup(model.as_dataset(changed.select("_rid", "Kind")), ["kind"])
    return one.select("kind", F.col("_rid").alias("first"))
