"""Run events: folds, logs, schedules and captured results, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave import model
from gridweave.operators import runs
from gridweave.session import shared_dir
from gridweave.sources import logs
from gridweave.streaming import runs as live

from . import derived, place_of, query, table
from .datasets import run_lines


def events(spark, sf):
    return derived(spark, sf, "run_events")


FOLD = """
    WITH ev AS (SELECT * FROM run_events),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS k FROM ev WHERE hb_event = 'progress') WHERE k = 1),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS k FROM ev WHERE hb_event IN ('progress', 'error') AND url <> '') WHERE k = 1),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS k FROM ev WHERE hb_event = 'result') WHERE k = 1),
    e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS k FROM ev WHERE hb_event = 'error') WHERE k = 1),
    b AS (SELECT run_id, bool_or(hb_event = 'status' AND state = 'running') AS ran, count(*) FILTER (WHERE hb_event IN ('progress', 'log')) AS log_lines FROM ev GROUP BY 1),
    f AS (SELECT b.run_id, ran, p.collected, p.total, p.message, coalesce(u.url, '') AS last_url, r.csv, r.rows, e.message AS error, log_lines
      FROM b LEFT JOIN p ON p.run_id = b.run_id LEFT JOIN u ON u.run_id = b.run_id LEFT JOIN r ON r.run_id = b.run_id LEFT JOIN e ON e.run_id = b.run_id)
"""
LIVE = FOLD + "SELECT run_id, CASE WHEN ran THEN 'running' ELSE 'starting' END AS status, collected, total, message, last_url, csv, rows, error, log_lines FROM f"


@query("e01_normalize_run_events", """
    SELECT run_id, hb_event, count(*) AS n, CAST(sum(collected) AS BIGINT) AS collected, CAST(sum(length(message)) AS BIGINT) AS message_chars, CAST(sum(rows) AS BIGINT) AS rows
    FROM run_events WHERE seq % 10 > 2 GROUP BY 1, 2""", uses=("run_events",))
def e01(spark, sf):
    typed = logs.normalize_run_events(logs.parse_run_lines(run_lines(spark, sf)))
    return typed.groupBy("run_id", "hb_event").agg(F.count("*").alias("n"), F.sum("collected").alias("collected"),
                                                   F.sum(F.length("message")).alias("message_chars"), F.sum("rows").alias("rows"))


@query("e02_fold_runs", FOLD + """
    SELECT f.run_id, CASE WHEN code IS NULL THEN CASE WHEN ran THEN 'running' ELSE 'starting' END WHEN canceled THEN 'canceled' WHEN timed_out THEN 'failed' WHEN controlled THEN 'controlled'
        WHEN code = 0 AND has_output THEN 'succeeded' ELSE 'failed' END AS status, collected, total, message, last_url, csv, rows,
      CASE WHEN timed_out THEN 'workflow timed out after 3600s' WHEN error IS NULL AND code IS NOT NULL AND NOT canceled AND NOT controlled AND NOT (code = 0 AND has_output)
        THEN 'workflow exited with code ' || code ELSE error END AS error, log_lines FROM f LEFT JOIN exits ON exits.run_id = f.run_id""", uses=("run_events", "exits"))
def e02(spark, sf):
    return runs.fold_runs(events(spark, sf), derived(spark, sf, "exits"))


def event_stream(spark, sf, name, parts=6):
    """Run events written as several files, to be streamed file by file out of order."""
    root = shared_dir(spark, name)
    ev = events(spark, sf)
    ev.repartition(parts, F.xxhash64("seq")).write.parquet(f"{root}/in")
    return root, spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")


@query("e03_fold_runs_stream", LIVE, uses=("run_events",))
def e03(spark, sf):
    root, stream = event_stream(spark, sf, "run-fold")
    live.fold_runs_stream(stream, f"{root}/folds", f"{root}/check").awaitTermination()
    return live.read_run_state(spark, f"{root}/folds")


@query("e03_live_run_state", LIVE, uses=("run_events",))
def e03b(spark, sf):
    """The stateful form; the last update of each run is its state."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    try:
        root, stream = event_stream(spark, sf, "run-live")
        q = (live.live_run_state(stream).writeStream.outputMode("update").foreachBatch(store)
             .option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if before:
            spark.conf.set(provider, before)
        else:
            spark.conf.unset(provider)
    updates = spark.read.parquet(f"{root}/out")
    rest = [c for c in updates.columns if c not in ("run_id", "batch")]
    return updates.groupBy("run_id").agg(F.max_by(F.struct(*rest), "batch").alias("s")).select("run_id", "s.*")


@query("e04_log_lines", """
    SELECT run_id, seq, line FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS k FROM (SELECT run_id, seq,
      CASE WHEN hb_event = 'progress' THEN '[progress] ' || collected || '/' || total || ' ' || message ELSE message END AS line FROM run_events WHERE hb_event IN ('progress', 'log'))) WHERE k <= 600""", uses=("run_events",))
def e04(spark, sf):
    return runs.log_lines(events(spark, sf))


@query("e05_runs_by_activity", """
    SELECT id, status, row_number() OVER (ORDER BY status NOT IN ('succeeded', 'failed', 'canceled') DESC, coalesce(finished_at, started_at, created_at, 0) DESC, id DESC) AS place FROM run_table""", uses=("run_table",))
def e05(spark, sf):
    return place_of(runs.runs_by_activity(derived(spark, sf, "run_table")).select("id", "status"))


@query("e06_interrupted_runs", """
    SELECT id, CASE WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit AND error IS NULL THEN 'interrupted (backend restarted)' ELSE error END AS error,
      CASE WHEN hit THEN coalesce(finished_at, 2e9) ELSE finished_at END AS finished_at FROM (SELECT *, status NOT IN ('succeeded', 'failed', 'canceled', 'scheduled') AS hit FROM run_table)""", uses=("run_table",))
def e06(spark, sf):
    return runs.interrupted_runs(derived(spark, sf, "run_table"), F.lit(2e9)).select("id", "status", "error", "finished_at")


@query("e07_overdue_runs", """
    SELECT id, 'workflow timed out after ' || lim || 's' AS error FROM (SELECT *, CASE o.timeout_sec WHEN '5' THEN 30 WHEN '1800' THEN 1800 WHEN 'soon' THEN 3600 ELSE 86400 END AS lim FROM run_table o)
    WHERE status IN ('starting', 'running') AND 9.15e8 - started_at > lim""", uses=("run_table",))
def e07(spark, sf):
    return runs.overdue_runs(derived(spark, sf, "run_table"), F.lit(9.15e8)).select("id", "error")


@query("e08_expand_schedule", """
    SELECT id, i AS occurrence, start_at + i * every_seconds AS fire_at FROM schedules, LATERAL (SELECT unnest(generate_series(0, CASE WHEN every_seconds > 0 THEN CAST(floor((1.70001e9 - start_at) / every_seconds) AS BIGINT) ELSE 0 END)) AS i)
    WHERE start_at <= 1.70001e9""", uses=("schedules",))
def e08(spark, sf):
    return runs.expand_schedule(derived(spark, sf, "schedules"), 1.70001e9).select("id", "occurrence", "fire_at")


@query("e08_due_and_next", """
    SELECT id, CASE WHEN every_seconds > 0 THEN start_at + greatest(floor((1.70005e9 - start_at) / every_seconds) + 1, 1) * every_seconds END AS next_at FROM schedules WHERE start_at <= 1.70005e9""", uses=("schedules",))
def e08b(spark, sf):
    return runs.due(derived(spark, sf, "schedules"), 1.70005e9).select("id", "next_at")


@query("e09_missing_params", """
    SELECT o_orderkey AS run_id, p.name, 'missing required parameter: ' || p.label AS error FROM orders JOIN (VALUES ('F', 'query', 'Search query'), ('F', 'limit', 'Limit'), ('O', 'url', 'Address')) AS p(workflow, name, label) ON p.workflow = o_orderstatus
    WHERE NOT (p.name = 'query' AND o_orderkey % 3 = 0) AND NOT (p.name = 'limit' AND o_orderkey % 2 = 0)""")
def e09(spark, sf):
    o = table(spark, sf, "orders")
    params = F.create_map(F.lit("query"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(""), F.lit("other"), F.lit("y"),
                          F.lit("limit"), F.when(F.col("o_orderkey") % 2 == 0, "5"))
    defs = spark.createDataFrame([("F", "query", "Search query", True), ("F", "limit", "Limit", True), ("O", "url", "Address", True), ("O", "note", "Note", False)],
                                 "workflow string, name string, label string, required boolean")
    return runs.missing_params(o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("workflow"), params.alias("params")), defs).select("run_id", "name", "error")


@query("e10_capture_run", """
    WITH t AS (SELECT DISTINCT p_brand FROM part WHERE p_size < 10), r AS (SELECT p_brand, min(p_partkey) AS k FROM part WHERE p_size >= 10 GROUP BY 1)
    SELECT p_brand AS brand, CAST(NULL AS VARCHAR) AS kind FROM t UNION ALL SELECT r.p_brand, p.p_type FROM r JOIN part p ON p.p_partkey = r.k WHERE r.p_brand NOT IN (SELECT p_brand FROM t)""")
def e10(spark, sf):
    p = table(spark, sf, "part")
    target = model.as_dataset(p.where("p_size < 10").groupBy(F.col("p_brand").alias("Brand")).agg(F.min("p_partkey").alias("_rid")))
    result = p.where("p_size >= 10").select(F.col("p_partkey").alias("_seq"), F.col("p_brand").alias("BRAND"), F.col("p_type").alias("Kind"))
    captured, _ = runs.capture_run(result, target, "run1", "search", ["Brand"])
    return captured.rows.select("brand", "kind")


WINDOWS = """
    SELECT run_id, CAST(epoch(time_bucket(INTERVAL '6 hours', ts)) AS BIGINT) AS start, max(collected) AS high, min(collected) AS low, count(*) AS reports FROM run_events WHERE hb_event = 'progress' GROUP BY 1, 2"""


def _window_rows(df):
    return df.select("run_id", F.unix_seconds("w.start").alias("start"), "high", "low", "reports")


def with_timestamp(ev):
    return ev.withColumn("ts", F.timestamp_seconds("t"))


@query("e11_progress_rate", WINDOWS, uses=("run_events",))
def e11(spark, sf):
    ev = with_timestamp(events(spark, sf)).where("hb_event = 'progress'")
    return _window_rows(runs.progress_rate(ev, "6 hours"))


@query("e11_progress_rate_stream", WINDOWS, uses=("run_events",))
def e11b(spark, sf):
    """Windows of a stream; lateness covers the whole shuffled input, so complete mode equals the batch."""
    root, stream = event_stream(spark, sf, "progress")
    out = live.progress_windows(with_timestamp(stream), "6 hours", "60 days")
    def store(batch, batch_id):
        _window_rows(batch).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{root}/out")
    out.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(f"{root}/out")
    return updates.groupBy("run_id", "start").agg(F.max_by(F.struct("high", "low", "reports"), "batch").alias("s")).select("run_id", "start", "s.*")
