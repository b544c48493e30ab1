"""Transcripts: both dialects line by line, pairing against a replay, and the derived tables."""

import json
import random

from pyspark.sql import functions as F

from gridweave.operators import sessions as ag


def raw(spark, lines):
    return spark.createDataFrame([(1, i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)], "session bigint, seq bigint, raw string")


def test_dialect_a(spark):
    item = lambda t, **f: {"type": f"item.{t}", "item": f}
    lines = [{"type": "thread.started", "thread_id": "th"}, {"type": "turn.started"}, {"type": "turn.completed", "usage": {"a": 1}}, {"type": "turn.failed"}, {"type": "error", "message": "x"},
             item("completed", type="agent_message", text="hi"), item("started", type="agent_message", text="no"), item("completed", type="agent_message", text="  "),
             item("completed", type="reasoning", text="why"), item("updated", type="todo_list", id="7", items=[{"text": "a", "completed": True}, {"text": "b"}]), item("updated", type="todo_list", items=[]),
             item("completed", type="error", message="odd"), item("started", type="mcp_tool_call", id="c1", tool="find", arguments={"q": 1}),
             item("completed", type="mcp_tool_call", id="c1", tool="find", status="failed", error={"message": "gone"}), item("completed", type="command_execution", id="c2", exit_code=0, aggregated_output="y" * 1300),
             item("started", type="file_change", id="c3", changes=[{"path": "a.py"}, {"kind": "add"}]), item("completed", type="file_change", id="c3", changes=[{"path": "a.py"}]),
             item("completed", type="web_search", id="c4", query="q"), item("completed", type="unknown"), "not json", {"type": "other"}]
    rows = [r.asDict() for r in ag.normalize_dialect_a(raw(spark, lines)).orderBy("seq").collect()]
    kinds = [(r["seq"], r["kind"]) for r in rows]
    assert kinds == [(0, "system"), (1, "status"), (2, "usage"), (3, "error"), (4, "error"), (5, "message"), (8, "reasoning"), (9, "status"), (11, "system"), (12, "tool_call"), (13, "tool_result"),
                     (14, "tool_result"), (15, "tool_call"), (16, "tool_result"), (17, "tool_result")]
    by = {r["seq"]: r for r in rows}
    assert by[0]["thread_id"] == "th" and by[3]["text"] == "turn failed" and json.loads(by[2]["usage"]) == {"a": 1}
    assert (by[9]["id"], by[9]["text"]) == ("plan-7", "✓ a · ○ b") and by[11]["text"] == "⚠ odd" and by[11]["level"] == "warn"
    assert json.loads(by[12]["args"]) == {"q": 1} and by[13]["ok"] is False and by[13]["result"] == "gone"
    assert by[14]["ok"] is True and by[14]["result"] == "y" * 1300 and by[14]["tool"] == "shell"
    assert json.loads(json.loads(by[15]["args"])["paths"]) == ["a.py"] and json.loads(by[16]["result"]) == ["a.py"] and by[17]["tool"] == "web_search"


def test_dialect_b(spark):
    ev = lambda **e: {"type": "stream_event", "event": e}
    lines = [{"type": "system", "subtype": "init", "model": "m", "session_id": "s1"}, {"type": "system", "subtype": "compact_boundary", "compact_metadata": {"messages_summarized": 4}},
             {"type": "system", "subtype": "model_fallback", "fallback_model": "z"}, {"type": "system", "subtype": "status", "status": "compacting"}, {"type": "system", "subtype": "status", "status": "requesting"},
             ev(type="message_start", message={"id": "m1"}), ev(type="content_block_start", index=1, content_block={"type": "text"}), ev(type="content_block_delta", index=1, delta={"type": "text_delta", "text": "a"}),
             ev(type="content_block_delta", index=0, delta={"type": "thinking_delta", "thinking": "t"}), ev(type="content_block_delta", delta={"type": "text_delta", "text": ""}),
             {"type": "assistant", "message": {"id": "m1", "content": [{"type": "thinking", "thinking": "t"}, {"type": "text", "text": "ab"}, {"type": "tool_use", "id": "c1", "name": "mcp__board__go", "input": {"x": 1}}, {"type": "text", "text": " "}]}},
             {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "is_error": True, "content": [{"type": "text", "text": "bad"}]}]}}, {"type": "user", "message": {"content": "plain"}},
             {"type": "result", "total_cost_usd": 0.5, "usage": {"input_tokens": 3}}, {"type": "result", "is_error": True, "result": "no model"},
             {"type": "rate_limit_event", "rate_limit_info": {"status": "allowed"}}, {"type": "rate_limit_event", "rate_limit_info": {"status": "allowed_warning", "rateLimitType": "five_hour", "resetsAt": 0}}]
    rows = [r.asDict() for r in ag.normalize_dialect_b(raw(spark, lines)).orderBy("seq", "part").collect()]
    assert [(r["seq"], r["kind"]) for r in rows] == [(0, "system"), (1, "system"), (2, "system"), (3, "status"), (5, "message_start"), (6, "block_start"), (7, "text_delta"), (8, "reasoning_delta"),
                                                     (10, "reasoning"), (10, "message"), (10, "tool_call"), (11, "tool_result"), (13, "usage"), (14, "usage"), (14, "error"), (16, "system")]
    assert rows[0]["text"] == "session started (m)" and rows[1]["text"] == "context compacted (4 messages summarised)" and rows[2]["text"] == "⚠ another model took over: z"
    assert (rows[9]["block"], rows[9]["msg_id"], rows[9]["text"]) == (1, "m1", "ab") and rows[10]["tool"] == "go" and json.loads(rows[10]["args"]) == {"x": 1}
    assert rows[11]["ok"] is False and "bad" in rows[11]["result"] and rows[14]["text"] == "no model"
    assert rows[15]["text"] == "approaching five-hour usage limit — resets Thu 00:00"
    usage = ag.usage_rollup(ag.normalize_dialect_b(raw(spark, lines[13:14]))).first()
    assert (usage["cost"], usage["input_tokens"], usage["output_tokens"]) == (0.5, 3.0, None)


def test_a_line_is_parsed_once(spark):
    df = raw(spark, [{"type": "turn.started"}])
    for normalise in (ag.normalize_dialect_a, ag.normalize_dialect_b):
        plan = normalise(df)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parse_json") + plan.count("parseJson") == 1 and "get_json_object" not in plan


def replay(events):
    """One list of open calls, searched from its front."""
    waiting, out = [], []
    for seq, kind, cid, tool in events:
        same = [w for w in waiting if cid and w[0] == cid]
        if kind == "tool_call":
            if same:
                same[0][1:] = [seq, tool]
            else:
                waiting.append([cid, seq, tool])
        else:
            hit = same[0] if same else waiting[0] if waiting else [None, None, None]
            waiting = [w for w in waiting if w is not hit]
            out.append((seq, hit[1], hit[2]))
    return sorted(out)


def test_queues_pair_by_counts(spark):
    """Sessions without names, never idle or with results before any call, are not replayed."""
    rnd, rows = random.Random(6), []
    for session in range(5):
        for seq in range(300):
            call = seq < 3 and session or rnd.random() < (0.55 if session % 2 else 0.48)
            rows.append((session, seq, "tool_call" if call else "tool_result", f"x{seq}" if session == 4 else None, f"t{seq}" if call else "", None if call else True))
    df = spark.createDataFrame(rows, "session bigint, seq bigint, kind string, call_id string, tool string, ok boolean").repartition(4)
    depths, _ = ag._depths(df.select("session", "seq", "kind", "call_id", "tool", "ok"))
    got = {}
    for r in ag._queued(depths).collect():
        got.setdefault(r["session"], []).append((r["result_seq"], r["call_seq"], r["tool"]))
    whole = {}
    for r in ag.pair_tool_calls(df).collect():
        whole.setdefault(r["session"], []).append((r["result_seq"], r["call_seq"], r["tool"]))
    for session in range(5):
        want = replay([(s, k, c, t) for n, s, k, c, t, _ in rows if n == session])
        assert sorted((a, b, t or None) for a, b, t in got[session]) == want and sorted((a, b, t or None) for a, b, t in whole[session]) == want


def test_pairing_equals_replay(spark):
    rnd, rows = random.Random(5), []
    for session in range(12):
        open_ids = []
        for seq in range(80):
            if open_ids and rnd.random() < 0.55 or (session % 3 == 2 and rnd.random() < 0.1):
                cid = open_ids.pop(rnd.randrange(len(open_ids))) if open_ids else "ghost"
                rows.append((session, seq, "tool_result", cid if session % 2 == 0 or rnd.random() < 0.6 else None, "", True))
            else:
                cid = f"c{seq}" if session % 4 < 2 or rnd.random() < 0.8 else None
                open_ids.append(cid)
                rows.append((session, seq, "tool_call", cid, f"t{seq}", None))
    df = spark.createDataFrame(rows, "session bigint, seq bigint, kind string, call_id string, tool string, ok boolean").repartition(4)
    got = {}
    for r in ag.pair_tool_calls(df).collect():
        got.setdefault(r["session"], []).append((r["result_seq"], r["call_seq"], r["tool"]))
    for session in range(12):
        want = replay([(s, k, c, t) for n, s, k, c, t, _ in rows if n == session])
        assert sorted(got.get(session, []), key=lambda x: x[0]) == want, session


def test_run_ids(spark):
    inner = json.dumps({"runId": "ab1", "x": 1})
    cases = [(inner, "ab1"), (json.dumps({"content": [{"type": "text", "text": inner}]}), "ab1"), (json.dumps([{"type": "text", "text": inner}]), "ab1"),
             ('{"a": {"runId": "cd2", "tex', "cd2"), ("", None), (None, None), ('{"status": "x"}', None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, r string")
    assert [r["x"] for r in df.select("i", ag.extract_run_id(F.col("r")).alias("x")).orderBy("i").collect()] == [c[1] for c in cases]


def test_acknowledgements(spark):
    df = spark.createDataFrame([(1, 1, "board_wait_run", ""), (1, 2, "board_run_status", '{"status": "running"}'), (1, 3, "board_run_logs", 'cut {"status":"failed", "l'), (1, 4, "other", '{"status": "failed"}')],
                               "session bigint, run bigint, tool string, result string")
    assert sorted(r["run"] for r in ag.acknowledged_runs(df).collect()) == [1, 3]


def test_queue_delivers_one_per_turn(spark):
    rows = [(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, None), (1, 5, 7), (2, 9, 2)]
    df = spark.createDataFrame(rows, "session bigint, seq bigint, turn bigint")
    got = {(r["session"], r["seq"]): r["delivered_turn"] for r in ag.queued_messages(df).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 3): 3, (1, 5): 8, (2, 9): 3}
