"""Transcripts of agent sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import sessions as ag
from gridweave.operators.runs import activity
from gridweave.session import shared_dir
from gridweave.streaming import transcripts as live

from . import derived, place_of, query, table


def turns(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text",
                                                    ((F.col("conv_id") + F.col("turn")) % 8).alias("k"))




def _json(**fields):
    return F.to_json(F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(n) for n, v in fields.items()]))


def _struct(**fields):
    return F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(n) for n, v in fields.items()])


@query("a01_normalize_dialect_a", f"""
    WITH c AS (SELECT conv_id AS session, turn AS seq, text, (conv_id + turn) % 8 AS k FROM conversations)
    SELECT session, seq, CASE k WHEN 0 THEN 'system' WHEN 1 THEN 'usage' WHEN 2 THEN 'message' WHEN 3 THEN 'reasoning' WHEN 4 THEN 'tool_call' WHEN 5 THEN 'tool_result' WHEN 6 THEN 'status' ELSE 'error' END AS kind,
      CASE k WHEN 0 THEN 'session started' WHEN 2 THEN text WHEN 3 THEN text WHEN 6 THEN '✓ read · ○ write' WHEN 7 THEN 'broke' END AS text, CASE WHEN k IN (4, 5) THEN 'shell' END AS tool,
      CASE WHEN k = 5 THEN seq % 2 = 0 END AS ok, CASE WHEN k = 5 THEN text END AS result, CASE WHEN k = 6 THEN 'plan-p' || seq END AS id, CASE WHEN k IN (4, 5) THEN 'c' || seq END AS call_id FROM c WHERE k <> 2 OR trim(text) <> ''""")
def a01(spark, sf):
    c = turns(spark, sf)
    k, cid = F.col("k"), F.concat(F.lit("c"), F.col("seq"))
    def item(kind, **f):
        return _struct(type=kind, **f)
    raw = (F.when(k == 0, _json(type="thread.started", thread_id="t1")).when(k == 1, _json(type="turn.completed", usage=_struct(input_tokens=F.col("seq"))))
           .when(k == 2, _json(type="item.completed", item=item("agent_message", text=F.col("text"))))
           .when(k == 3, _json(type="item.completed", item=item("reasoning", text=F.col("text"))))
           .when(k == 4, _json(type="item.started", item=item("command_execution", id=cid, command="ls")))
           .when(k == 5, _json(type="item.completed", item=item("command_execution", id=cid, exit_code=F.col("seq") % 2, aggregated_output=F.col("text"))))
           .when(k == 6, _json(type="item.updated", item=item("todo_list", id=F.concat(F.lit("p"), "seq"), items=F.array(
               _struct(text="read", completed=F.lit(True)), _struct(text="write", completed=F.lit(False))))))
           .otherwise(_json(type="turn.failed", error=_struct(message="broke"))))
    return ag.normalize_dialect_a(c.select("session", "seq", raw.alias("raw"))).select("session", "seq", "kind", "text", "tool", "ok", "result", "id", "call_id")


@query("a02_normalize_dialect_b", f"""
    WITH c AS (SELECT conv_id AS session, turn AS seq, text, (conv_id + turn) % 8 AS k FROM conversations),
    e AS (SELECT session, seq, 0 AS part, 'system' AS kind, 'session started (m1)' AS text, NULL AS tool, NULL AS result FROM c WHERE k = 0
      UNION ALL SELECT session, seq, 0, 'text_delta', text, NULL, NULL FROM c WHERE k = 1 AND text <> ''
      UNION ALL SELECT session, seq, 0, 'message', text, NULL, NULL FROM c WHERE k = 2 UNION ALL SELECT session, seq, 1, 'tool_call', '{{"a":1}}', 'board_find', NULL FROM c WHERE k = 2
      UNION ALL SELECT session, seq, 0, 'tool_result', NULL, '', text FROM c WHERE k = 3
      UNION ALL SELECT session, seq, 0, 'usage', NULL, NULL, NULL FROM c WHERE k IN (4, 5) UNION ALL SELECT session, seq, 1, 'error', '[529] overloaded', NULL, NULL FROM c WHERE k = 5
      UNION ALL SELECT session, seq, 0, 'status', NULL, NULL, NULL FROM c WHERE k = 6 UNION ALL SELECT session, seq, 1, 'system', 'five-hour usage limit reached', NULL, NULL FROM c WHERE k = 6)
    SELECT * FROM e""")
def a02(spark, sf):
    c = turns(spark, sf)
    k = F.col("k")
    raw = (F.when(k == 0, _json(type="system", subtype="init", model="m1", session_id="s"))
           .when(k == 1, _json(type="stream_event", event=_struct(type="content_block_delta", index=F.lit(2), delta=_struct(type="text_delta", text=F.col("text")))))
           .when(k == 2, F.concat(F.lit('{"type":"assistant","message":{"id":"m","content":[{"type":"text","text":'), F.get(F.split(F.to_json(F.array("text")), "^\\["), F.lit(1)).substr(F.lit(1), F.length(F.to_json(F.array("text"))) - 2),
                                  F.lit('},{"type":"tool_use","id":"c1","name":"mcp__board__board_find","input":{"a":1}}]}}')))
           .when(k == 3, _json(type="user", message=_struct(content=F.array(_struct(type="tool_result", tool_use_id="c1", content=F.col("text"))))))
           .when(k == 4, _json(type="result", total_cost_usd=F.lit(0.5), usage=_struct(input_tokens=F.lit(3))))
           .when(k == 5, _json(type="result", is_error=F.lit(True), api_error_status=F.lit(529), result="overloaded"))
           .when(k == 6, _json(type="rate_limit_event", rate_limit_info=_struct(status="rejected", rateLimitType="five_hour")))
           .otherwise(_json(type="rate_limit_event", rate_limit_info=_struct(status="allowed"))))
    out = ag.normalize_dialect_b(c.select("session", "seq", raw.alias("raw")))
    return out.select("session", "seq", "part", "kind", F.coalesce("text", "chunk", F.when(F.col("kind") == "tool_call", F.col("args"))).alias("text"), "tool", "result")


def deltas(spark, sf):
    """Every turn streamed in pieces of forty characters; odd turns never get their final block."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.concat(F.lit("m"), "turn").alias("msg_id"), F.lit(0).alias("block"), "turn", "text")
    pieces = c.select("session", "msg_id", "block", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,40}"), F.lit(0))).alias("pos", "chunk"))
    streamed = pieces.select("session", "msg_id", "block", F.lit("text_delta").alias("kind"), (F.col("turn") * 1000000 + F.col("pos")).alias("seq"), F.lit(None).cast("string").alias("text"), "chunk")
    finals = c.where("turn % 2 = 0").select("session", "msg_id", "block", F.lit("message").alias("kind"), (F.col("turn") * 1000000 + 900000).alias("seq"), F.concat(F.lit("final "), "text").alias("text"), F.lit(None).cast("string").alias("chunk"))
    return streamed.unionByName(finals)


SETTLED = """SELECT conv_id AS session, 'm' || turn AS msg_id, sha256(CASE WHEN turn % 2 = 0 THEN 'final ' || text ELSE trim(text) END) AS text, turn % 2 = 1 AS truncated FROM conversations"""


@query("a03_accumulate_partials", SETTLED)
def a03(spark, sf):
    return ag.accumulate_partials(deltas(spark, sf)).select("session", "msg_id", F.sha2("text", 256).alias("text"), "truncated")


@query("a03_accumulate_stream", SETTLED)
def a03b(spark, sf):
    root = shared_dir(spark, "partials")
    d = deltas(spark, sf)
    d.repartition(5, F.xxhash64("session", "seq")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    live.accumulate_stream(stream, f"{root}/out", f"{root}/check").awaitTermination()
    return live.settled_blocks(spark, f"{root}/out").select("session", "msg_id", F.sha2("text", 256).alias("text"), "truncated")


@query("a04_latest_by_id", """
    SELECT session, id, arg_max(seq, seq) AS seq, arg_max(kind, seq) AS kind, min(seq) AS position FROM chat_events WHERE id IS NOT NULL GROUP BY session, id
    UNION ALL SELECT session, id, seq, kind, seq FROM chat_events WHERE id IS NULL""", uses=("chat_events",))
def a04(spark, sf):
    return ag.latest_by_id(derived(spark, sf, "chat_events")).select("session", "id", "seq", "kind", "position")


def tool_events(spark, sf):
    """A call and its result per order; sessions with a multiple of three lose the ids of their results."""
    o = table(spark, sf, "orders")
    common = [F.col("o_custkey").alias("session")]
    cid = F.concat(F.lit("c"), "o_orderkey")
    calls = o.select(*common, (F.col("o_orderkey") * 2).alias("seq"), F.lit("tool_call").alias("kind"), cid.alias("call_id"), F.col("o_orderpriority").alias("tool"), F.lit(None).cast("boolean").alias("ok"))
    results = o.select(*common, (F.col("o_orderkey") * 2 + 1).alias("seq"), F.lit("tool_result").alias("kind"), F.when(F.col("o_custkey") % 3 != 0, cid).alias("call_id"), F.lit("").alias("tool"), (F.col("o_orderstatus") != "F").alias("ok"))
    return calls.unionByName(results)


@query("a05_pair_tool_calls", "SELECT o_custkey AS session, o_orderkey * 2 + 1 AS result_seq, o_orderkey * 2 AS call_seq, o_orderpriority AS tool, o_orderstatus <> 'F' AS ok FROM orders")
def a05(spark, sf):
    return ag.pair_tool_calls(tool_events(spark, sf))


@query("a06_extract_run_id", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE 'run-' || o_orderkey END AS run_id FROM orders")
def a06(spark, sf):
    k, rid = F.col("o_orderkey") % 6, F.concat(F.lit("run-"), "o_orderkey")
    plain = _json(runId=rid, status="queued")
    listed = F.array(_struct(type="text", text=plain))
    text = (F.when(k == 0, plain).when(k == 1, _json(content=listed)).when(k == 2, F.to_json(listed)).when(k == 3, F.concat(F.lit('{"x": [1, 2, {"runId": "'), rid, F.lit('", "cut')))
            .when(k == 4, F.substring(_json(content=listed), F.lit(1), F.length(rid) + 60)).otherwise('{"status": "none"}'))
    return table(spark, sf, "orders").select("o_orderkey", ag.extract_run_id(text).alias("run_id"))


ACKS = """SELECT DISTINCT session, run FROM tool_results WHERE tool = 'board_wait_run' OR (tool IN ('board_run_status', 'board_run_logs') AND contains(result, 'succeeded'))"""


@query("a07_pending_notifications", f"""
    SELECT n.session, n.run FROM notes n WHERE NOT delivered AND NOT EXISTS (SELECT 1 FROM ({ACKS}) a WHERE n.kind = 'workflow_finished' AND a.session = n.session AND a.run = n.run)""", uses=("notes", "tool_results"))
def a07(spark, sf):
    acks = ag.acknowledged_runs(derived(spark, sf, "tool_results"))
    return ag.pending_notifications(derived(spark, sf, "notes"), acks).select("session", "run")


@query("a07_pending_by_session", f"""
    SELECT n.session, count(*) AS waiting, min(n.run) AS first_run, max(n.run) AS last_run FROM notes n LEFT JOIN ({ACKS}) a ON n.kind = 'workflow_finished' AND a.session = n.session AND a.run = n.run WHERE NOT delivered AND a.run IS NULL GROUP BY 1""", uses=("notes", "tool_results"))
def a07b(spark, sf):
    acks = ag.acknowledged_runs(derived(spark, sf, "tool_results"))
    return ag.pending_by_session(ag.pending_notifications(derived(spark, sf, "notes"), acks))


@query("a08_notification_summary", """
    SELECT run, CASE WHEN kind = 'workflow_finished' THEN 'workflow ' || CASE WHEN workflow = '' THEN CAST(run AS VARCHAR) ELSE workflow END || ' ' || status ||
      CASE WHEN rows IS NOT NULL THEN ' — ' || rows || ' rows' WHEN error IS NOT NULL THEN ' — ' || error ELSE '' END || ' (run ' || run || ')' ELSE kind END AS summary FROM notes""", uses=("notes",))
def a08(spark, sf):
    return derived(spark, sf, "notes").select("run", ag.notification_summary().alias("summary"))


CONTEXT = r"""
    WITH l AS (SELECT session, seq, CASE kind WHEN 'message' THEN E'\nYou said:\n' || left(trim(text), 1800) WHEN 'reasoning' THEN E'\n[thinking] ' || left(trim(text), 600) ELSE CASE WHEN contains(text, '🔔') THEN text END END AS line FROM {src}),
    u AS (SELECT *, sum(length(line)) OVER (PARTITION BY session ORDER BY seq DESC) AS used FROM l)
    SELECT session, sha256(string_agg(line, chr(10) ORDER BY seq)) AS context, count(*) AS events, CAST(max(used) AS BIGINT) AS used FROM u WHERE used <= 4000 AND line IS NOT NULL GROUP BY session"""


@query("a09_rebuild_context", CONTEXT.replace("{src}", "chat_events"), uses=("chat_events",))
def a09(spark, sf):
    out = ag.rebuild_context(derived(spark, sf, "chat_events").withColumns({n: F.lit(None).cast(t) for n, t in {"tool": "string", "args": "string", "ok": "boolean", "result": "string"}.items()}), budget=4000,
                             line=ag.context_line(said_chars=1800, thought_chars=600))
    return out.withColumn("context", F.sha2("context", 256))


@query("a10_usage_rollup", """
    SELECT user_id AS session, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), event_id)::DOUBLE AS input_tokens, arg_max(value, event_id) AS cost, count(*) AS reports FROM events GROUP BY 1""")
def a10(spark, sf):
    e = table(spark, sf, "events")
    usage = F.to_json(F.struct(F.col("value").alias("total_cost_usd"), F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens")).alias("tokens")))
    return ag.usage_rollup(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.lit("usage").alias("kind"), usage.alias("usage"))).select("session", "input_tokens", "cost", "reports")


@query("a11_retain_latest", "SELECT session, seq FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS k FROM chat_events) WHERE k <= 3", uses=("chat_events",))
def a11(spark, sf):
    return ag.retain_latest(derived(spark, sf, "chat_events").select("session", "seq"), 3)


@query("a12_sessions_by_activity", """
    SELECT id, status, row_number() OVER (ORDER BY status NOT IN ('done', 'failed', 'stopped') DESC, coalesce(finished_at, started_at, created_at, 0) DESC, id DESC) AS place FROM run_table""", uses=("run_table",))
def a12(spark, sf):
    return place_of(derived(spark, sf, "run_table").orderBy(*activity(ag.SESSION_ENDS)).select("id", "status"))


@query("a12_interrupted_sessions", """
    SELECT id, CASE status WHEN 'queued' THEN 'failed' WHEN 'running' THEN 'failed' WHEN 'starting' THEN 'failed' WHEN 'succeeded' THEN 'stopped' ELSE status END AS status FROM run_table""", uses=("run_table",))
def a12b(spark, sf):
    s = derived(spark, sf, "run_table").withColumn("status", F.when(F.col("status") == "succeeded", "canceled").otherwise(F.col("status")))
    return ag.interrupted_sessions(s, F.lit(2e9)).select("id", "status")


@query("a13_owned_active_runs", """
    SELECT DISTINCT session, run FROM (SELECT session, run FROM notes WHERE run % 3 = 0 UNION ALL SELECT o_custkey + 1, o_orderkey FROM orders WHERE o_orderkey % 4 = 0) WHERE run % 6 IN (0, 1, 5)""", uses=("notes",))
def a13(spark, sf):
    listed = derived(spark, sf, "notes").where("run % 3 = 0")
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey") + 1).alias("owner"),
                                             F.element_at(F.array(*[F.lit(x) for x in ("queued", "running", "succeeded", "failed", "scheduled", "starting")]), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("status"))
    return ag.owned_active_runs(listed, runs, ["starting", "running", "controlled", "queued"])


@query("a14_backlog_then_live", "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def a14(spark, sf):
    root = shared_dir(spark, "backlog")
    c = table(spark, sf, "conversations")
    c.where("turn < 3").write.json(f"{root}/in")
    def follow():
        s = live.backlog_then_live(spark, f"{root}/in", "conv_id bigint, turn bigint, role string, text string")
        s.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    follow()
    c.where("turn >= 3").write.mode("append").json(f"{root}/in")
    follow()
    return spark.read.parquet(f"{root}/out").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("a15_claim_runs", """
    WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS claim, min(l_suppkey) AS session, l_orderkey * CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 1 END AS run FROM lineitem GROUP BY l_orderkey, l_linenumber),
    r AS (SELECT o_orderkey AS run, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 10 END AS owner, o_orderstatus AS status FROM orders),
    f AS (SELECT run, arg_min(session, claim) AS first FROM c GROUP BY 1)
    SELECT c.claim, c.session, c.run, CASE WHEN r.run IS NULL THEN 'no such run' WHEN coalesce(r.owner, CASE WHEN r.status <> 'F' THEN f.first END) <> c.session THEN 'owned by another'
      WHEN r.status = 'F' THEN 'already finished' ELSE 'claimed' END AS answer FROM c LEFT JOIN r ON r.run = c.run LEFT JOIN f ON f.run = c.run""")
def a15(spark, sf):
    li = table(spark, sf, "lineitem")
    claims = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("session")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim"), "session", (F.col("l_orderkey") * F.when(F.col("l_linenumber") == 7, 1000000).otherwise(1)).alias("run"))
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 10).alias("owner"), F.col("o_orderstatus").alias("status"))
    return ag.claim_runs(claims, runs, ["F"])


@query("a16_queued_messages", """
    WITH m AS (SELECT user_id AS session, event_id AS seq, event_id // 500 AS turn FROM events WHERE event_type <> 'view' AND event_id % 7 <> 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS place FROM m)
    SELECT session, seq, place, place + max(turn + 1 - place) OVER (PARTITION BY session ORDER BY seq) AS delivered_turn FROM k""")
def a16(spark, sf):
    e = table(spark, sf, "events")
    messages = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.floor(F.col("event_id") / 500).cast("bigint")).alias("turn"))
    cancelled = e.where("event_id % 7 = 0").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"))
    return ag.queued_messages(messages, cancelled).select("session", "seq", "place", "delivered_turn")
