"""Sources, typing, row reads, row writes and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import model
from gridweave.functions import cells
from gridweave.operators import reshape, rows, sequence, writes
from gridweave.session import shared_dir
from gridweave.sources import logs, tables
from gridweave.streaming.appends import append_stream, read_appended

from . import derived, place_of, query, table

CONTACT_COLUMNS = ["Name", "Nation", {"name": "Balance", "type": "number"}, "Segment"]


def customers_ds(spark, sf):
    c = table(spark, sf, "customer")
    return model.as_dataset(c.select(
        F.col("c_custkey").alias("_rid"), F.concat(F.lit("Contact#"), F.col("c_custkey") % 997).alias("Name"),
        F.col("c_nationkey").alias("Nation"), F.col("c_acctbal").alias("Balance"), F.col("c_mktsegment").alias("Segment")))


def suppliers_ds(spark, sf):
    s = table(spark, sf, "supplier")
    return model.as_dataset(s.select(
        F.col("s_suppkey").alias("_rid"), F.concat(F.lit("Contact#"), F.col("s_suppkey") * 7).alias("NAME"),
        F.col("s_nationkey").cast("string").alias("Nation"), F.col("s_acctbal").alias("Balance")))


def contacts_ds(spark, sf):
    return reshape.merge([customers_ds(spark, sf), suppliers_ds(spark, sf)])


CONTACTS = "SELECT name, nation, balance, segment FROM contacts"
NUMBER_TEXT = "CASE WHEN balance = floor(balance) THEN CAST(CAST(balance AS BIGINT) AS VARCHAR) ELSE CAST(balance AS VARCHAR) END"


@query("flagship_contacts", """
    WITH firsts AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY source_idx, rid) AS k FROM contacts)
    SELECT coalesce(segment, 'none') AS segment, count(*) AS people, round(sum(balance), 2) AS balance
    FROM firsts WHERE k = 1 AND (contains(lower(name), '1') OR contains(nation, '1') OR contains(lower(segment), '1')
         OR contains(CASE WHEN balance = floor(balance) THEN CAST(CAST(balance AS BIGINT) AS VARCHAR) ELSE CAST(balance AS VARCHAR) END, '1'))
    GROUP BY 1""", uses=("contacts",))
def flagship_contacts(spark, sf):
    """Merge two sources with different types, keep one row per name, search all columns, roll up."""
    people = reshape.merge([customers_ds(spark, sf), suppliers_ds(spark, sf)], ["Name"])
    return rows.search(people, "1").groupBy(F.coalesce("segment", F.lit("none")).alias("segment")).agg(
        F.count("*").alias("people"), F.round(F.sum("balance"), 2).alias("balance"))


# --- sources and sinks

@query("s01_read_csv", CONTACTS, uses=("contacts",))
def s01(spark, sf):
    path = shared_dir(spark, "contacts-csv")
    tables.write_csv(contacts_ds(spark, sf), path)
    return tables.read_csv(spark, path, [{"name": "BALANCE", "type": "number"}]).select("name", "nation", "balance", "segment")


@query("s02_append_csv", """
    SELECT name, nation, balance, segment FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY source_idx, rid) AS k FROM contacts)
    WHERE k = 1 OR source_idx = 0""", uses=("contacts",))
def s02(spark, sf):
    path = shared_dir(spark, "suppliers-csv")
    tables.write_csv(suppliers_ds(spark, sf), path)
    base = model.as_dataset(customers_ds(spark, sf), CONTACT_COLUMNS)
    return tables.append_csv(spark, base, path, ["Name"]).rows.select("name", "nation", "balance", "segment")


@query("s03_write_csv", f"""
    SELECT name AS "Name", nation AS "Nation", {NUMBER_TEXT} AS "Balance", coalesce(segment, '') AS "Segment" FROM contacts""", uses=("contacts",))
def s03(spark, sf):
    path = shared_dir(spark, "export-csv")
    tables.write_csv(contacts_ds(spark, sf), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


PAYLOADS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 9 THEN 'no json' ELSE concat('[{"Name": "', c_name, '", "balance": "',
    CAST(c_nationkey AS STRING), ',000"}, "stray", 5, {"NAME": "second", "extra": 1}]') END AS payload FROM {customer}"""


def _payloads(spark, sf):
    return spark.sql(PAYLOADS.replace("[{", "[{{").replace(' {"', ' {{"').replace('"}', '"}}').replace("1}]", "1}}]"), customer=table(spark, sf, "customer"))


@query("s04_read_rows_json", """
    SELECT row_number() OVER (ORDER BY id, spot) AS rid, name, balance FROM (
      SELECT c_custkey AS id, 0 AS spot, c_name AS name, CAST(c_nationkey AS DOUBLE) * 1000 AS balance FROM customer WHERE c_custkey % 10 <> 9
      UNION ALL SELECT c_custkey, 3, 'second', NULL FROM customer WHERE c_custkey % 10 <> 9)""")
def s04(spark, sf):
    good, _ = tables.read_rows_json(_payloads(spark, sf), "payload", ["Name", {"name": "Balance", "type": "number"}])
    return good.select(F.col("_rid").alias("rid"), "name", "balance")


@query("s04_rejected_rows", """
    SELECT 'not an object' AS reason, 2 * count(*) AS n FROM customer WHERE c_custkey % 10 <> 9
    UNION ALL SELECT 'not an array', count(*) FROM customer WHERE c_custkey % 10 = 9""")
def s04_rejects(spark, sf):
    _, bad = tables.read_rows_json(_payloads(spark, sf), "payload", ["Name"])
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query("s06_encode_nested", """
    SELECT event_id, '{"user":' || user_id || ',"type":"' || event_type || '"}' AS who, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS k,
           CASE WHEN event_id % 2 = 0 THEN '' ELSE '["' || event_type || '"]' END AS tags
    FROM (SELECT CAST(event_id AS VARCHAR) AS event_id_text, * FROM events) """.replace("SELECT event_id,", "SELECT event_id_text AS event_id,"))
def s06(spark, sf):
    e = table(spark, sf, "events")
    return tables.encode_nested(e.select(
        "event_id", F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type")).alias("who"),
        F.get_json_object("props", "$.k").alias("k"), F.when(F.col("event_id") % 2 == 1, F.array("event_type")).alias("tags")))


def run_lines(spark, sf):
    """Process output derived from events: structured lines, plain logs and broken ones."""
    e = derived(spark, sf, "run_events")
    js = F.to_json(F.struct("hb_event", "t", "state", "collected", "total", "message", "url", "csv", "rows"))
    line = (F.when(F.col("seq") % 10 == 0, F.concat(F.lit("plain "), F.col("message")))
            .when(F.col("seq") % 10 == 1, F.concat(F.lit(logs.EVENT_MARK), F.lit("{broken")))
            .when(F.col("seq") % 10 == 2, F.lit("   ")).otherwise(F.concat(F.lit(logs.EVENT_MARK), js)))
    return e.select("run_id", "seq", line.alias("value"))


@query("s07_run_event_lines", """
    SELECT CASE seq % 10 WHEN 0 THEN 'log' WHEN 1 THEN 'reject' ELSE 'event' END AS part,
           CASE WHEN seq % 10 > 2 THEN hb_event ELSE '' END AS hb_event, count(*) AS n
    FROM run_events WHERE seq % 10 <> 2 GROUP BY 1, 2""", uses=("run_events",))
def s07(spark, sf):
    parsed = logs.parse_run_lines(run_lines(spark, sf))
    kind = F.when(F.col("part") == "event", F.col("event.hb_event")).otherwise("")
    return parsed.groupBy("part", kind.alias("hb_event")).agg(F.count("*").alias("n"))


TURN = "conv_id bigint, turn bigint, role string, text string"


@query("s08_read_transcripts", "SELECT conv_id, turn, role, text FROM conversations")
def s08(spark, sf):
    path = shared_dir(spark, "transcripts")
    table(spark, sf, "conversations").write.json(path)
    return logs.read_transcripts(spark, path, TURN).select("conv_id", "turn", "role", "text")


@query("s09_write_transcript", "SELECT conv_id, turn, role, text FROM conversations WHERE turn % 3 <> 1")
def s09(spark, sf):
    root = shared_dir(spark, "live-transcript")
    table(spark, sf, "conversations").repartition(4).write.parquet(f"{root}/in")
    stream = (spark.readStream.schema(TURN).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
              .withColumn("partial", F.col("turn") % 3 == 1))
    logs.write_transcript(stream, f"{root}/out", f"{root}/check").awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("partial")


@query("s10_read_files")
def s10(spark, sf):
    """The stored table files themselves; only path and size are read."""
    return logs.read_files(spark, sf, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("s11_result_preview", """
    SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS row_count FROM orders ORDER BY o_orderkey LIMIT 5000""")
def s11(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("_rid"), "o_totalprice")
    preview, info = rows.result_preview(o)
    return preview.select(F.col("_rid").alias("o_orderkey"), "o_totalprice", info.select("row_count").scalar().alias("row_count"))


# --- schema and typing

@query("t01_sanitize_columns", r"""
    WITH b AS (SELECT id, display, trim(regexp_replace(lower(display), '[^0-9a-z]+', '_', 'g'), '_') AS s FROM names),
    c AS (SELECT id, display, CASE WHEN s = '' THEN 'col' WHEN regexp_matches(s, '^[0-9]') THEN 'c_' || s ELSE s END AS base FROM b),
    d AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM c)
    SELECT id, display, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS name FROM d""", uses=("names",))
def t01(spark, sf):
    n = derived(spark, sf, "names").withColumn("base", model.base_name_column(F.col("display")))
    k = sequence.number_rows(n, "id", "k", keys=["base"])
    return k.select("id", "display", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "k")).alias("name"))


@query("t02_normalize_type", """
    SELECT CASE WHEN lower(trim(declared)) IN ('integer', 'money') THEN 'number' WHEN lower(trim(declared)) = 'bool' THEN 'boolean'
                WHEN lower(trim(declared)) = 'images' THEN 'file_list' WHEN lower(trim(declared)) = 'video' THEN 'file' ELSE 'text' END AS type,
           count(*) AS n FROM messy_cells GROUP BY 1""", uses=("messy_cells",))
def t02(spark, sf):
    return derived(spark, sf, "messy_cells").groupBy(model.normalize_type_column(F.col("declared")).alias("type")).agg(F.count("*").alias("n"))


COERCED = """
    SELECT id, CASE WHEN v = 'nan' OR isnan(try_cast(v AS DOUBLE)) THEN NULL ELSE try_cast(v AS DOUBLE) END AS value,
           CASE WHEN v <> '' AND v <> 'nan' AND try_cast(v AS DOUBLE) IS NULL THEN cell END AS rescued
    FROM (SELECT *, replace(replace(trim(cell), ',', ''), '_', '') AS v FROM messy_cells)"""


@query("t04_coerce_number", COERCED, uses=("messy_cells",))
def t04(spark, sf):
    c = F.col("cell")
    return derived(spark, sf, "messy_cells").select("id", cells.coerce_number(c).alias("value"), cells.rescue_number(c).alias("rescued"))


@query("t05_coerce", f"""
    SELECT m.id, c.value AS cell, CASE WHEN m.flag IS NOT NULL THEN lower(trim(m.flag)) IN ('yes', 'true', 'on', '1', 'y') END AS flag,
           m.declared, c.rescued FROM messy_cells m JOIN ({COERCED}) c ON c.id = m.id""", uses=("messy_cells",))
def t05(spark, sf):
    d = model.coerce(derived(spark, sf, "messy_cells"), [{"name": "Cell", "type": "number"}, {"name": "flag", "type": "bool"}, "declared"])
    return d.select(F.col("id").cast("bigint").alias("id"), "cell", "flag", "declared", F.try_element_at("_rescued", F.lit("cell")).alias("rescued"))


@query("t06_coerce_boolean", """
    SELECT coalesce(flag, 'NULL') AS flag, CASE WHEN flag IS NOT NULL THEN trim(lower(flag)) IN ('1', 'true', 'yes', 'y', 'on') END AS value,
           count(*) AS n FROM messy_cells GROUP BY 1, 2""", uses=("messy_cells",))
def t06(spark, sf):
    d = derived(spark, sf, "messy_cells")
    return d.groupBy(F.coalesce("flag", F.lit("NULL")).alias("flag"), cells.coerce_boolean(F.col("flag")).alias("value")).agg(F.count("*").alias("n"))


@query("t07_coerce_file_list", """
    SELECT rid, string_agg(file_id, '|' ORDER BY pos) AS ids FROM attachment_items GROUP BY rid""", uses=("attachment_items",))
def t07(spark, sf):
    items = derived(spark, sf, "attachment_items").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "file_id"))).alias("l"))
    ids = F.transform("l", lambda x: F.concat(F.lit(" "), x["file_id"]))
    text = F.when(F.size(ids) == 1, ids[0]).otherwise(F.to_json(F.array_append(ids, F.lit("  "))))
    return items.select("rid", F.array_join(cells.coerce_file_list(text), "|").alias("ids"))


@query("t08_infer_result_types", """
    SELECT 'id' AS "column", 'number' AS type, count(*) AS present FROM messy_cells UNION ALL
    SELECT 'cell', 'text', count(cell) FROM messy_cells UNION ALL SELECT 'flag', 'text', count(flag) FROM messy_cells UNION ALL
    SELECT 'declared', 'text', count(declared) FROM messy_cells UNION ALL SELECT 'digits', 'number', count(*) FROM messy_cells""", uses=("messy_cells",))
def t08(spark, sf):
    d = derived(spark, sf, "messy_cells").withColumn("digits", F.concat(F.col("id").cast("string"), F.lit(".5")))
    return model.infer_types(d)


@query("t09_add_column", "SELECT name, nation, balance, segment, CAST(NULL AS DOUBLE) AS balance_2 FROM contacts", uses=("contacts",))
def t09(spark, sf):
    return model.add_column(contacts_ds(spark, sf), "balance!", "money").drop("_rid")


@query("t10_drop_column", "SELECT name, balance, segment FROM contacts", uses=("contacts",))
def t10(spark, sf):
    df, _ = model.drop_column(contacts_ds(spark, sf), "Nation", ["Name", "Nation"])
    return model.drop_column(df, "no such column")[0].drop("_rid")


@query("t11_rename_column", """SELECT name AS "Full name", nation AS "Nation", balance AS "Balance", segment AS "Segment" FROM contacts""", uses=("contacts",))
def t11(spark, sf):
    df, _ = model.rename_column(contacts_ds(spark, sf), "Name", "Full name", ["Name"])
    return df.select(*[F.col(s["name"]).alias(s["display"]) for s in model.specs_of(df)])


@query("t12_schema_summary", """
    WITH n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM supplier) AS s)
    SELECT 'customers' AS dataset, c AS row_count, o.ordinal, o.name, o.display, o.type FROM n, (VALUES (0, 'name', 'Name', 'text'),
      (1, 'nation', 'Nation', 'number'), (2, 'balance', 'Balance', 'number'), (3, 'segment', 'Segment', 'text')) AS o(ordinal, name, display, type)
    UNION ALL SELECT 'suppliers', s, o.ordinal, o.name, o.display, o.type FROM n, (VALUES (0, 'name', 'NAME', 'text'),
      (1, 'nation', 'Nation', 'text'), (2, 'balance', 'Balance', 'number')) AS o(ordinal, name, display, type)""")
def t12(spark, sf):
    return model.schema_summary(spark, {"customers": customers_ds(spark, sf), "suppliers": suppliers_ds(spark, sf)})


@query("t13_validate_contract", f"""
    SELECT 'Cell' AS "column", 'wrong_type' AS state, count(rescued) AS bad_cells FROM ({COERCED})
    UNION ALL SELECT 'missing one', 'missing', 0 UNION ALL SELECT 'id', 'ok', 0 UNION ALL SELECT 'flag', 'extra', 0 UNION ALL SELECT 'declared', 'extra', 0""", uses=("messy_cells",))
def t13(spark, sf):
    return model.validate_contract(derived(spark, sf, "messy_cells"), [
        {"name": "Cell", "type": "number"}, "missing one", {"name": "id", "type": "int"}])


@query("t14_epoch_to_ts", """
    SELECT o_orderkey, CAST(EPOCH(o_orderdate) AS BIGINT) AS seconds FROM orders""")
def t14(spark, sf):
    o = table(spark, sf, "orders")
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").cast("double")
    mixed = F.when(F.col("o_orderkey") % 2 == 0, seconds * 1000).otherwise(seconds)
    return o.select("o_orderkey", F.unix_seconds(cells.epoch_to_ts(mixed)).alias("seconds"))


# --- row reads

def part_ds(spark, sf):
    p = table(spark, sf, "part")
    return model.as_dataset(p.select(F.col("p_partkey").alias("_rid"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))


@query("r01_search_part", """
    SELECT p_partkey AS rid, p_name, CAST(p_size AS DOUBLE) AS p_size FROM part WHERE contains(lower(p_name), '99') OR contains(lower(p_brand), '99') OR contains(lower(p_type), '99')
      OR contains(CAST(p_size AS VARCHAR), '99') OR contains(CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR)
      ELSE CAST(p_retailprice AS VARCHAR) END, '99')""")
def r01(spark, sf):
    return rows.search(part_ds(spark, sf), "99").select(F.col("_rid").alias("rid"), "p_name", "p_size")


@query("r01_search_customer", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#0000001') OR contains(lower(c_mktsegment), 'r#0000001')")
def r01b(spark, sf):
    c = table(spark, sf, "customer")
    return rows.search(c, "R#0000001", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name")


@query("r02_sort_rows", """SELECT c_custkey, c_name, rank FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rank FROM customer)""")
def r02(spark, sf):
    c = model.as_dataset(table(spark, sf, "customer").withColumn("_rid", F.col("c_custkey")))
    ranked = place_of(rows.sort_rows(c, "C_AcctBal", "desc"), "rank")
    return ranked.select(F.col("_rid").alias("c_custkey"), "c_name", "rank")


@query("r03_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
def r03(spark, sf):
    return rows.page(table(spark, sf, "orders"), 50, 100, "o_totalprice", "desc", tie="o_orderkey").select("o_orderkey", "o_totalprice")


@query("r03_page_after", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 200")
def r03b(spark, sf):
    return rows.page_after(table(spark, sf, "orders"), 1000, 200, tie="o_orderkey").select("o_orderkey", "o_totalprice")


@query("r04_page_with_total", """
    WITH hits AS (SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red'))
    SELECT *, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY p_partkey LIMIT 25 OFFSET 10""")
def r04(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return rows.page_with_total(p, "red", limit=25, offset=10, tie="p_partkey")


@query("r05_result_filter", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), 'auto') OR contains(lower(c_mktsegment), 'auto')")
def r05(spark, sf):
    return rows.result_filter(table(spark, sf, "customer"), "AuTo").select("c_custkey", "c_name", "c_mktsegment")


@query("r06_mixed_sort", f"""
    SELECT id, cell, row_number() OVER (ORDER BY value IS NULL, value, cell, id) AS place
    FROM (SELECT m.id, coalesce(m.cell, '') AS cell, c.value FROM messy_cells m JOIN ({COERCED}) c ON c.id = m.id)""", uses=("messy_cells",))
def r06(spark, sf):
    d = derived(spark, sf, "messy_cells").select("id", F.coalesce("cell", F.lit("")).alias("cell"))
    return place_of(rows.mixed_sort(d, "cell", tie="id"))


@query("r07_top_n", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def r07(spark, sf):
    return rows.top_n(table(spark, sf, "orders"), 10, F.col("o_totalprice").desc(), F.col("o_orderkey")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("r08_tail", """
    SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 5""")
def r08(spark, sf):
    return rows.tail(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", 5)


@query("r09_select_where", """
    SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def r09(spark, sf):
    return table(spark, sf, "lineitem").where(
        (F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ'1999-01-01 00:00:00'")) & F.col("l_discount").between(0.05, 0.07)
        & (F.col("l_quantity") < 24)).select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


# --- row writes

def _halves(spark, sf):
    c = contacts_ds(spark, sf)
    even = c.where(F.col("_rid") % 2 == 0)
    odd = c.where(F.col("_rid") % 2 == 1).withColumnRenamed("_rid", "_seq")
    return even, odd


APPEND_SQL = """
    WITH base AS (SELECT * FROM contacts WHERE rid % 2 = 0), incoming AS (SELECT * FROM contacts WHERE rid % 2 = 1),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY coalesce(name, ''), coalesce(segment, '') ORDER BY source_idx, rid) AS k FROM incoming),
    fresh AS (SELECT * FROM firsts f WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM base b WHERE coalesce(b.name, '') = coalesce(f.name, '')
              AND coalesce(b.segment, '') = coalesce(f.segment, '')))
"""


@query("w01_append", APPEND_SQL + "SELECT name, nation, balance, segment FROM base UNION ALL SELECT name, nation, balance, segment FROM fresh", uses=("contacts",))
def w01(spark, sf):
    base, incoming = _halves(spark, sf)
    return writes.append(base, incoming, ["name", "SEGMENT"]).rows.select("name", "nation", "balance", "segment")


@query("w01_append_row_ids", """
    WITH base AS (SELECT o_orderkey AS rid FROM orders WHERE o_orderkey % 2 = 0)
    SELECT (SELECT max(rid) FROM base) + row_number() OVER (ORDER BY o_orderkey) AS rid, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1""")
def w01_ids(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    base = o.where("o_orderkey % 2 = 0").withColumn("_rid", F.col("o_orderkey"))
    fresh = o.where("o_orderkey % 2 = 1").withColumn("_seq", F.col("o_orderkey"))
    return writes.append(base, fresh, ["o_orderkey"]).added.select(F.col("_rid").alias("rid"), F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus")


@query("w01_append_counts", APPEND_SQL + "SELECT (SELECT count(*) FROM fresh) AS inserted, (SELECT count(*) FROM incoming) - (SELECT count(*) FROM fresh) AS skipped", uses=("contacts",))
def w01_counts(spark, sf):
    base, incoming = _halves(spark, sf)
    return writes.append(base, incoming, ["Name", "Segment"]).counts


@query("w02_insert_rows", "SELECT name, nation, balance, segment FROM contacts", uses=("contacts",))
def w02(spark, sf):
    base, incoming = _halves(spark, sf)
    return writes.insert_rows(base, incoming).drop("_rid")


EDITS = """SELECT o_custkey AS _rid, o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'Balance' WHEN 1 THEN 'Segment' ELSE 'Nowhere' END AS column,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN concat('1,', CAST(100 + o_orderkey % 900 AS STRING)) ELSE o_orderpriority END AS value FROM {orders}"""


@query("w03_apply_cell_edits", f"""
    WITH e AS ({EDITS.replace('{orders}', 'orders').replace('AS column', 'AS col')}),
    l AS (SELECT *, row_number() OVER (PARTITION BY _rid, col ORDER BY seq DESC) AS k FROM e)
    SELECT c_custkey AS rid, CASE WHEN b._rid IS NULL THEN c_acctbal ELSE CAST(replace(b.value, ',', '') AS DOUBLE) END AS balance,
           CASE WHEN s._rid IS NULL THEN c_mktsegment ELSE s.value END AS segment
    FROM customer LEFT JOIN l b ON b._rid = c_custkey AND b.col = 'Balance' AND b.k = 1 LEFT JOIN l s ON s._rid = c_custkey AND s.col = 'Segment' AND s.k = 1""")
def w03(spark, sf):
    edits = spark.sql(EDITS, orders=table(spark, sf, "orders"))
    return writes.apply_cell_edits(customers_ds(spark, sf), edits).select(F.col("_rid").alias("rid"), "balance", "segment")


@query("w04_delete_rows", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def w04(spark, sf):
    c = table(spark, sf, "customer").withColumn("_rid", F.col("c_custkey"))
    big = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("_rid"))
    return writes.delete_rows(c, big).select("c_custkey", "c_name")


@query("w05_dedup_documents", "SELECT min(doc_id) AS doc_id, lang, sha256(text) AS sha FROM documents GROUP BY text, lang")
def w05(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("_rid"), "text", "lang")
    return writes.dedup(d).select(F.col("_rid").alias("doc_id"), "lang", F.sha2("text", 256).alias("sha"))


@query("w05_dedup_contacts", """
    SELECT name, nation, balance, segment FROM (SELECT *, row_number() OVER (PARTITION BY name, segment ORDER BY source_idx, rid) AS k FROM contacts) WHERE k = 1""", uses=("contacts",))
def w05b(spark, sf):
    return writes.dedup(contacts_ds(spark, sf), ["name", "segment", "unknown"]).drop("_rid")


@query("w06_update_where", """
    SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(regexp_replace(p_name, 'r(.)', '\\1r', 'g')) ELSE p_name END AS p_name,
           CASE WHEN p_size > 25 THEN round(p_retailprice * 0.9, 2) ELSE p_retailprice END AS p_retailprice FROM part""")
def w06(spark, sf):
    from gridweave.functions.regexes import re_replace
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return writes.update_where(p, {"p_name": F.upper(re_replace(F.col("p_name"), "r(.)", r"\1r")),
                                   "p_retailprice": F.round(F.col("p_retailprice") * 0.9, 2)}, F.col("p_size") > 25).drop("p_size")


@query("w07_delete_where", "SELECT rid, name FROM contacts WHERE NOT coalesce(segment = 'MACHINERY', false)", uses=("contacts",))
def w07(spark, sf):
    return writes.delete_where(derived(spark, sf, "contacts"), F.col("segment") == "MACHINERY").select("rid", "name")


@query("w07_rows_affected", "SELECT count(*) AS rows_affected FROM contacts WHERE segment = 'MACHINERY'", uses=("contacts",))
def w07b(spark, sf):
    return writes.affected(derived(spark, sf, "contacts"), F.col("segment") == "MACHINERY")


@query("w08_insert_select", """
    SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier WHERE s_acctbal > 0""")
def w08(spark, sf):
    target = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    src = table(spark, sf, "supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return writes.insert_select(target, src)


@query("w09_attach_file", """
    WITH f AS (SELECT rid, file_id, min(pos) AS pos FROM attachment_items GROUP BY 1, 2),
    l AS (SELECT rid, string_agg(file_id, '|' ORDER BY pos) AS ids FROM f GROUP BY 1)
    SELECT conv_id * 100 + turn AS rid, coalesce(l.ids, '') AS ids FROM conversations LEFT JOIN l ON l.rid = conv_id * 100 + turn""", uses=("attachment_items",))
def w09(spark, sf):
    rids = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("_rid"))
    base = model.as_dataset(rids.withColumn("files", F.array().cast("array<string>")), [{"name": "Files", "type": "file_list"}])
    items = derived(spark, sf, "attachment_items").select(F.col("rid").alias("_rid"), "file_id", F.col("pos").alias("seq"))
    twice = items.unionByName(items.withColumn("seq", F.col("seq") + 100))
    return writes.attach_file(base, twice, "files").select(F.col("_rid").alias("rid"), F.array_join("files", "|").alias("ids"))


@query("w10_append_stream", """SELECT name, count(*) AS n FROM (SELECT DISTINCT name, coalesce(segment, '') FROM contacts) GROUP BY name""", uses=("contacts",))
def w10(spark, sf):
    root = shared_dir(spark, "append-stream")
    src = contacts_ds(spark, sf).withColumnRenamed("_rid", "_seq")
    src.repartition(6).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    base_schema = src.drop("_seq").schema
    append_stream(stream, f"{root}/out", f"{root}/check", base_schema, ["Name", "Segment"]).awaitTermination()
    return read_appended(spark, f"{root}/out", base_schema).groupBy("name").agg(F.count("*").alias("n"))


# --- reshape

@query("d01_project", """SELECT min(c_custkey) AS rid, c_mktsegment AS kind, CAST(c_nationkey AS DOUBLE) AS nation FROM customer GROUP BY 2, 3""")
def d01(spark, sf):
    out = reshape.project(customers_ds(spark, sf), [{"from": "Segment", "to": "Kind"}, "Nation", "Nope"], ["Kind", "Nation"])
    return out.select(F.col("_rid").alias("rid"), "kind", "nation")


@query("d02_merge", CONTACTS, uses=("contacts",))
def d02(spark, sf):
    return contacts_ds(spark, sf).drop("_rid")


@query("d03_query_to_dataset", """
    SELECT n_name AS nation, CAST(count(*) AS DOUBLE) AS customers, round(avg(c_acctbal), 4) AS avg_balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def d03(spark, sf):
    out = reshape.query_to_dataset(spark, {"customer": table(spark, sf, "customer"), "nation": table(spark, sf, "nation")}, """
        SELECT n_name AS Nation, count(*) AS Customers, round(avg(c_acctbal), 4) AS `Avg balance`
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1""")
    return out.drop("_rid")


@query("d04_extract_to_tidy", r"""
    SELECT DISTINCT u.host FROM (SELECT unnest(regexp_extract_all(url, 'https?://([^/?#]+)', 1)) AS host FROM pages
      UNION ALL SELECT unnest(regexp_extract_all(html, 'https?://([^/?#"<>\s]+)', 1)) FROM pages) u""")
def d04(spark, sf):
    p = table(spark, sf, "pages")
    first = reshape.extract_to_tidy([(p, "url")], r"https?://([^/?#]+)", "host", 1)
    return first.union(reshape.extract_to_tidy([(p, "html")], r'https?://([^/?#"<>\s]+)', "host", 1)).distinct()


@query("d05_unique_preserve_order", """
    WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
    f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY 1, 2)
    SELECT doc_id, sha256(string_agg(w, ' ' ORDER BY i)) AS words FROM f GROUP BY 1""")
def d05(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(F.array_join(reshape.unique_preserve_order(F.split("text", " ")), " "), 256).alias("words"))


for _name, _op in {"union": "UNION", "union_all": "UNION ALL", "intersect": "INTERSECT", "except": "EXCEPT"}.items():
    def _set_query(spark, sf, op=_op):
        c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
        s = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
        return {"UNION": lambda: c.union(s).distinct(), "UNION ALL": lambda: c.union(s), "INTERSECT": lambda: c.intersect(s),
                "EXCEPT": lambda: c.subtract(s)}[op]()
    query(f"d06_{_name}", f"SELECT c_nationkey AS k FROM customer {_op} SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")(_set_query)
